"""Batch corrections on small tables."""

import pytest
from pyspark.sql import functions as F

from claimlens.operators import corrections as c
from claimlens.sources.tables import Tables


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_field_edits(make):
    schemes = make("pttype string, name string, round_money string, pttype_upp_type_id int", ("1", "a", "Y", 5), ("2", "b", "N", None))
    edits = make(
        "pttype string, field string, value string, _pos int",
        ("1", "pttype_name", "  new ", 1), ("1", "round_money", "no", 2), ("2", "pttype_name", "old", 3), ("2", "pttype_name", "", 4),
        ("1", "pttype_upp_type_id", "x", 5), ("2", "pttype_upp_type_id", "9", 6), ("1", "secret", "z", 7), ("9", "pttype_name", "q", 8),
        ("1", "round_money", None, 9),
    )
    changed = c.apply_field_edits(schemes, edits, c.EDIT_POLICIES["pttype"])
    assert rows(changed.table, "pttype", "name", "round_money", "pttype_upp_type_id") == [
        ("1", "new", "", 5), ("2", "", "N", 9),
    ]
    assert changed.report.first().asDict() == {"accepted": 6, "unknown_field": 1, "bad_value": 1, "unknown_key": 1}


def test_blank_becomes_null_where_the_table_says_so(make):
    income = make("income string, name string, group2 string", ("01", "a", "g"))
    edits = make("income string, field string, value string, _pos int", ("01", "group2", "", 1), ("01", "income_name", " b ", 2))
    changed = c.apply_field_edits(income, edits, c.EDIT_POLICIES["income"])
    assert rows(changed.table, "name", "group2") == [(" b ", None)]


def test_general_policy():
    assert len(c.GENERAL_FIELDS) == 25
    assert c.general_policy("sex").fields == {"name": "name"}
    with pytest.raises(ValueError):
        c.general_policy("officer")


def test_keyed_updates(make):
    debts = make("debt_id int, sss_approval_code string", (1, "a"), (2, "b"))
    updates = make("debt_id int, sss_approval_code string, _pos int", (1, "x", 1), (1, None, 2), (7, "z", 3))
    changed = c.apply_keyed_updates(debts, updates, c.KEYED_UPDATES["debt_approval"])
    assert rows(changed.table, "debt_id", "sss_approval_code") == [(1, ""), (2, "b")]
    assert changed.report.first().asDict() == {"matched": 1, "unmatched": 1}
    labs = make("icode string, no_lab_catalog string", ("a", None), ("b", "Y"))
    switch = make("icode string, no_lab_catalog string", ("a", "Y"), ("b", "N"))
    changed = c.apply_keyed_updates(labs, switch, c.KEYED_UPDATES["lab_opt_out"])
    assert rows(changed.table, "icode", "no_lab_catalog") == [("a", "Y"), ("b", None)]


def test_insert_missing(make):
    changed = c.insert_missing(make("code string", ("a",)), make("code string", ("a",), ("b",), ("b",), (None,)), "code")
    assert rows(changed.table, "code") == [("a",), ("b",)]
    assert changed.report.first().inserted == 1


def test_upsert_is_idempotent(make):
    drugs = make("icode string, name string, units string", ("1", "a", "u"), ("2", "b", "u"))
    new = make("icode string, name string, units string, _pos int", (" 2 ", "c", "", 1), ("3", "d", "v", 2), ("3", "e", "w", 3))
    once = c.upsert_by_key(drugs, new, "icode")
    expected = [("1", "a", "u"), ("2", "c", None), ("3", "e", "w")]
    assert rows(once.table, "icode", "name", "units") == expected
    assert once.report.first().asDict() == {"inserted": 1, "updated": 2}
    twice = c.upsert_by_key(once.table, new, "icode")
    assert rows(twice.table, "icode", "name", "units") == expected
    assert twice.report.first().asDict() == {"inserted": 0, "updated": 3}


def test_append_numbered_continues(make):
    table = make("id int, icode string, name string", (4, "a", "x"))
    changed = c.append_numbered(table, make("icode string, name string, _pos int", ("c", "", 1), ("b", "y", 2)), "id")
    assert rows(changed.table, "id", "icode", "name") == [(4, "a", "x"), (5, "c", None), (6, "b", "y")]
    empty = c.append_numbered(table.where("false"), make("icode string, name string, _pos int", ("c", "z", 1)), "id")
    assert rows(empty.table, "id", "icode") == [(1, "c")]


def test_delete_by_key(make):
    changed = c.delete_by_key(make("k int", (1,), (2,), (None,)), make("k int", (2,), (5,)), "k")
    assert rows(changed.table, "k") == [(1,), (None,)] and changed.report.first().deleted == 1


def test_new_diagnoses_fill_empty_slots(spark, make):
    stat = make(
        "vn string, dx0 string, dx1 string, dx2 string, dx3 string, dx4 string, dx5 string",
        ("a", "J1", None, " ", "J2", "", "J3"), ("b", "1", "2", "3", "4", "5", "6"), ("c", None, None, None, None, None, None),
    )
    diagnoses = make("vn string, ovst_diag_id bigint, icd10 string, diagtype string, doctor string, hn string, vstdate date, vsttime string")
    records = make(
        "vn string, icd10_add string, hn string, vsttime string, vstdate string, diagtype string, doctor_code string, _pos int",
        ("a", "Z510", "h", "08:00:00", "2026-03-01T00:00:00", None, "d", 2), ("a", "Z511", "h", "08:00:00", "2026-03-01 08:00", "2", "d", 1),
        ("b", "Z510", "h", "08:00:00", "2026-03-01", "", "d", 3), ("c", "Z510", "h", "08:00:00", "2026-03-01", "4", "d", 4),
        ("gone", "Z510", "h", "08:00:00", "2026-03-01", "4", "d", 5),
    )
    t = Tables(spark, {"vn_stat": stat, "ovstdiag": diagnoses})
    done = c.add_diagnoses(t, records, staff="me", now=F.lit("2026-03-02 00:00:00").cast("timestamp_ntz"))
    slots = {r.vn: [r[d] for d in c.DIAGNOSIS_SLOTS] for r in done["vn_stat"].collect()}
    assert slots == {
        "a": ["J1", "Z511", "Z510", "J2", "", "J3"], "b": list("123456"), "c": ["Z510", None, None, None, None, None],
    }
    added = rows(done["ovstdiag"], "ovst_diag_id", "vn", "icd10", "diagtype", "staff")
    assert added[:3] == [(1, "a", "Z511", "2", "me"), (2, "a", "Z510", "4", "me"), (3, "b", "Z510", "4", "me")]
    assert {str(r.vstdate) for r in done["ovstdiag"].collect()} == {"2026-03-01"}
