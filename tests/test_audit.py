"""Completeness audit: aliases, sentinels, skips, scores, drill-down."""

import re

import pytest
from pyspark.sql import functions as F

from claimlens.operators import audit, scoreboard
from claimlens.operators.catalogue import lookup_list
from claimlens.operators.fdh import fdh_opd
from claimlens.operators.inpatient import cipn_group46
from claimlens.plans.audit_rules import Rule, parse_rules
from claimlens.plans.registry import QUERIES, WHOLE
from claimlens.sources.binding import bind
from claimlens.sources.tables import Tables


@pytest.fixture
def tables(spark, make):
    item = "code string, name string, price decimal(10,2), is_active string, kind int"
    return Tables(
        spark,
        {
            "thing": make(
                item, ("1", "a", 5, "Y", 1), ("2", "", 0, "Y", 2), ("3", None, None, "Y", None), ("4", "d", 1, "N", 2)
            ),
            "other": make("kind int", (2,)),
        },
    )


def test_resolve_column():
    assert audit.resolve_column(["A", "Is_Active"], "active") == "Is_Active"
    assert audit.resolve_column(["active", "is_active"], "active") == "active"
    assert audit.resolve_column(["a"], "active") is None
    assert audit.resolve_column(["x", "abc_clinic_type_id"], "clinic_type_id") == "abc_clinic_type_id"


def test_rules_are_counted(tables):
    rules = parse_rules("""
s | thing | active=Y | name price!0!0.00 ename
s | thing | nothere=Y | name
s | thing | nothere IN (1) | name
s | thing | kind NOT IN other.kind WHERE kind > 0 | name
s | absent | | x
""")
    rows = audit.audit_columns(tables, rules).collect()
    got = sorted((r.rule, r.tot, r.ok, r.status) for r in rows)
    assert got == [
        ("absent.x", 0, 0, "skip"),
        ("thing.ename", 0, 0, "skip"),
        ("thing.name", 0, 0, "error"),
        ("thing.name", 1, 1, "ok"),
        ("thing.name", 3, 1, "ok"),
        ("thing.name", 4, 2, "ok"),
        ("thing.price", 3, 1, "ok"),
    ]
    strict = audit.audit_columns(tables, parse_rules("s | thing | active=Y | name"), aliases={}, strict=True).first()
    assert strict.status == "skip"


def test_scores(make):
    results = make(
        "section string, rule string, tot bigint, ok bigint, status string, info string",
        ("a", "1", 200, 199, "ok", "N"), ("a", "2", 4, 4, "ok", "N"), ("a", "3", 9, 0, "ok", "Y"), ("a", "4", 0, 0, "skip", "N"),
        ("b", "1", 8, 1, "ok", "N"), ("c", "1", 0, 0, "ok", "N"),
    )
    by_rule = {r.section: (r.pct, r.n_full, r.n_short) for r in audit.section_score(results).collect()}
    assert by_rule == {"a": (100, 1, 1), "b": (13, 0, 1), "c": (0, 0, 0)}
    by_record = {r.section: (r.pct, r.missing) for r in audit.section_score_weighted(results).collect()}
    assert by_record == {"a": (95, 10), "b": (13, 7), "c": (None, 0)}
    overall = audit.overall_score(results).first()
    assert (overall.overall_pct, overall.complete, overall.incomplete) == (71, 1, 2)


@pytest.mark.parametrize(
    ("pct", "rules", "records"),
    [(100, "green", "perfect"), (90, "green", "good"), (89, "amber", "warning"), (60, "amber", "danger"), (59, "red", "danger"), (None, "red", "skip-all")],
)
def test_bands(spark, pct, rules, records):
    row = spark.range(1).select(
        audit.score_band(F.lit(pct).cast("int")).alias("a"), audit.score_band(F.lit(pct).cast("int"), "records").alias("b")
    )
    assert tuple(row.first()) == (rules, records)


def test_missing_rows_come_in_order(tables):
    rows = audit.audit_missing_rows(tables, Rule("s", "thing", "name")).collect()
    assert [r.code for r in rows][:2] == ["2", "3"]
    with pytest.raises(ValueError):
        audit.audit_missing_rows(tables, Rule("s", "thing", "nothere"))


def test_missing_linked_rows(spark, make):
    main = make("k string, name string, missing string", ("a", "x", "m"), ("b", "y", "m"), ("c", "z", "m"), (None, "n", "m"))
    other = make("k string, code string, price string", ("a", "1", ""), ("a", None, "0"), ("b", "", None))

    def failing(*rows):
        t = Tables(spark, {"main": main.drop("missing"), "other": make("k string, code string, price string", *rows)})
        found = audit.audit_missing_linked_rows(t, "main", "other", "k", ("code", "price!0"), "name <> 'none'").collect()
        return sorted((r.missing, r.k or "") for r in found)

    rows = [tuple(r) for r in other.collect()]
    every = ["", "a", "b", "c"]
    assert failing(*rows) == sorted(
        [("other", "c"), ("other.code", "b"), ("other.code", "c")] + [("other.price", k) for k in every]
    )
    # a filled row without a key: nothing is known to fail the rules it meets
    assert failing(*rows, (None, "2", None)) == [("other.price", k) for k in every]
    assert failing() == sorted((rule, k) for rule in ("other", "other.code", "other.price") for k in every)


def test_charge_categories_without_a_category_table(spark, sf):
    t = bind(spark, sf, long_lists=True)
    rows = audit.bill_sections(t.without("income"))
    sections = {r.section for r in rows.select("section").distinct().collect()}
    assert "bill01" in sections and "bill04" not in sections


def test_contract_and_counts(tables):
    rows = {r.required: (r.present, r.n_rows) for r in audit.table_contract(tables, ("thing.name", "thing.x", "gone")).collect()}
    assert rows == {"thing.name": ("Y", 4), "thing.x": ("N", 4), "gone": ("N", -1)}


def test_scoreboard_adds_up(spark, sf):
    rows = QUERIES["fund_scoreboard"].run(spark, sf).collect()
    assert all(r.passed + r.needfix == r.total for r in rows)
    files = [r for r in rows if r.file != scoreboard.ALL]
    whole = next(r for r in rows if r.file == scoreboard.ALL)
    assert sum(r.total for r in files) == whole.total and sum(r.needfix for r in files) == whole.needfix
    assert "check_hcode" in next(r for r in files if r.file == "billtran_SSS").ignored


def test_errors_only_and_breakdown_agree(spark, sf):
    t = bind(spark, sf)
    file = fdh_opd(t, WHOLE)
    failed = {r.check_name: r.failed for r in scoreboard.check_breakdown(file).collect()}
    for name in ("check_uuc", "check_btemp"):
        assert scoreboard.errors_only(file, [name]).count() == failed[name]
    assert scoreboard.errors_only(file).count() >= max(failed.values())
    assert scoreboard.check_columns(cipn_group46(t, WHOLE)) == ["auth_code_check"]


def test_one_scan_per_table(spark, sf):
    t = bind(spark, sf)
    rules = [Rule("s", "part", c) for c in ("p_name", "p_brand", "p_type")] + [Rule("s", "part", "p_size", ("p_size > 3",))]
    plan = audit.audit_columns(t, rules)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1


def test_lookup_list_is_ordered(spark, sf):
    t = bind(spark, sf)
    rows = [r.pttype for r in lookup_list(t, "schemes", groups=("UCS", "WEL")).collect()]
    assert rows == sorted(rows) and len(rows) > 0
