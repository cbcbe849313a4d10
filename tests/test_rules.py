"""NOT IN with NULL, membership, and charges that exclude one another."""

import pytest

from claimlens.operators.corrections import delete_charge_lines
from claimlens.operators.rules import not_in, walkin_with_cancer, with_membership
from claimlens.params import Params
from claimlens.plans.registry import WHOLE
from claimlens.sources.binding import bind

LISTS = {
    "plain": ("a", "b"),
    "with_null": ("a", None),
    "empty": (),
}


@pytest.mark.parametrize(
    ("listed", "kept", "truth"),
    [
        ("plain", {"c"}, {"a": True, "c": False, None: None}),
        ("with_null", set(), {"a": True, "c": None, None: None}),
        ("empty", {"a", "c", None}, {"a": False, "c": False, None: False}),
    ],
)
def test_in_and_not_in_follow_sql(make, listed, kept, truth):
    df = make("x string", ("a",), ("c",), (None,))
    other = make("y string", *[(v,) for v in LISTS[listed]])
    assert {r.x for r in not_in(df, "x", other, "y").collect()} == kept
    assert {r.x: r.m for r in with_membership(df, "x", other, "y", "m").collect()} == truth


def test_deleting_ends_the_conflict(spark, sf):
    t = bind(spark, sf)
    visits = walkin_with_cancer(t, WHOLE)
    assert visits.count() > 0
    changed = delete_charge_lines(t, visits.selectExpr("VN AS vn"), "WALKIN")
    after = t.with_tables(opitemrece=changed.table)
    assert walkin_with_cancer(after, WHOLE).count() == 0
    assert changed.table.count() + changed.report.first().deleted == t["opitemrece"].count()


def test_conflicts_respect_the_window(spark, sf):
    t = bind(spark, sf)
    p = Params("1996-01-01", "1996-12-31")
    days = [r[0] for r in walkin_with_cancer(t, p).select("วันที่รับบริการ").collect()]
    assert all(p.date_from <= d <= p.date_to for d in days)
