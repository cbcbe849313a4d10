"""What one task holds must not grow with the input."""

import datetime as dt

import pytest

from claimlens.operators import fdh, outpatient
from claimlens.params import Params
from claimlens.plans.registry import SCAN_BYTES, SKEW_BYTES, SLICE_BYTES, TASK_BYTES, tune
from claimlens.sources.binding import bind
from claimlens.sources.tables import Tables

WHOLE = Params("1990-01-01", "2029-12-31")


@pytest.mark.parametrize("operator", [outpatient.opdx, outpatient.opservice, outpatient.dispensing, outpatient.billitems])
def test_billed_visits_are_found_once(spark, sf, operator):
    """The tables cut to them read the result and do not look for them again."""
    plan = operator(bind(spark, sf), WHOLE)._jdf.queryExecution().optimizedPlan().toString()
    assert "_billed" not in plan


def test_shuffle_partitions_follow_the_input(spark, tmp_path):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = {k: spark.conf.get(k, None) for k in (initial, advisory)}
    try:
        spark.conf.unset(advisory)
        for slices in (0, 3 * least):
            with open(tmp_path / "lineitem.parquet", "wb") as f:
                f.truncate(slices * SLICE_BYTES)
            tune(spark, str(tmp_path))
            assert spark.conf.get(initial) == str(max(least, slices))
            assert spark.conf.get(advisory) == str(TASK_BYTES)
        spark.conf.set(advisory, "8m")
        tune(spark, str(tmp_path))
        assert spark.conf.get(advisory) == "8m"
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_scans_and_hot_keys_have_a_size(spark, tmp_path):
    """A piece of a file and a hot key that is not split are no larger when the input is."""
    sizes = {
        "spark.sql.files.maxPartitionBytes": SCAN_BYTES,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": SKEW_BYTES,
    }
    kept = {key: spark.conf.get(key, None) for key in sizes}
    try:
        for key, size in sizes.items():
            spark.conf.unset(key)
            tune(spark, str(tmp_path))
            assert spark.conf.get(key) == str(size)
            spark.conf.set(key, "5m")
            tune(spark, str(tmp_path))
            assert spark.conf.get(key) == "5m"
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_drug_lines_do_not_go_to_what_a_visit_adds(spark, sf):
    """Visits meet admissions and the summary before the lines; the last grouping needs no shuffle of its own."""
    kept = {key: spark.conf.get(key, None) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = fdh.fdh_dru(bind(spark, sf), WHOLE)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "Exchange hashpartitioning(hn#" not in plan  # grouped where the rows lie by visit


def test_drug_lines_of_repeated_and_missing_visits(spark, make):
    """Repeated visits and summaries repeat their rows; visits without a number or a line keep an empty one."""
    visits = make(
        "vn string, hn string, vstdate date, pttype string, spclty string, an string",
        *[(vn, "7", dt.date(2020, 1, 1), "10", "01", an) for vn, an in (("1", "A1"), ("1", "A1"), ("2", None), (None, None), ("3", "A3"))],
    )
    money = "qty decimal(12,2), unitprice decimal(12,2), cost decimal(12,2), sum_price decimal(12,2)"
    lines = make(
        f"vn string, icode string, {money}, paidst string, doctor string, vstdate date",
        *[(vn, icode, "2", "5", "4", "10", "02", "d", dt.date(2020, 1, 1)) for vn, icode in (("1", "i"), ("1", "j"), (None, "i"), ("2", "k"))],
    )
    items = [(i, None, "same", "1 mg", "tab", None, 1) for i in ("i", "j")]
    t = {
        "ovst": visits, "opitemrece": lines,
        "pttype": make("pttype string, hipdata_code string, isuse string", ("10", "UCS", "Y")),
        "ipt": make("an string", ("A1",), (None,)),
        "vn_stat": make("vn string, cid string", ("1", "c"), ("3", "e"), ("3", "e")),
        "ovst_presc_ned": make("vn string, icode string, doctor string, presc_reason string, nhso_authorize_code string"),
        "drugitems": make("icode string, did string, name string, strength string, units string, tmt_tp_code string, packqty long", *items),
        "opdconfig": make("hospitalcode string", ("10000",)),
    }
    rows = fdh.fdh_dru(Tables(spark, {name: (lambda df=df: df) for name, df in t.items()}), WHOLE).collect()
    found = sorted((r.vn or "", r.an or "", r.person_id or "", r.didname or "", str(r.total)) for r in rows)
    # visit 1 stands twice, with two items that look the same: 2 * 2 * 2 * 5
    assert found == [
        ("", "", "", "", "0.0000"),
        ("1", "A1", "c", "same 1 mg tab", "40.0000"),
        ("2", "", "", "", "10.0000"),
        ("3", "", "e", "", "0.0000"),
    ]


def test_charge_lines_lie_by_visit_where_asked(spark, tmp_path):
    """The same rows, and a grouping by visit moves nothing after lines have met their orders."""
    day = dt.datetime(2020, 1, 1)
    orders = [(k, 7, "O", 1.0, day, "1-URGENT") for k in (1, 2, 2, 30, None)]
    lines = [(k, 3, 4, n, 2.0, 5.0, 0.0, 0.0, "A", "O", day) for k in (1, 2, 30, 30, None, 99) for n in (1, 2)]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain, by_visit = (bind(spark, str(tmp_path), by_visit=v)["opitemrece"] for v in (False, True))
        assert sorted(map(str, plain.collect())) == sorted(map(str, by_visit.collect())) and plain.count() == 10
        moves = [t.groupBy("vn").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") for t in (plain, by_visit)]
        assert moves == [3, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
