"""Every registered query against its SQL."""

import pytest
from harness import QUERIES, compare

from claimlens.operators import fdh
from claimlens.params import Params
from claimlens.plans.registry import WHOLE

WINDOWED = [
    "billtran", "billtran_funnel", "billitems", "opservice", "dispenseditem", "fdh_ins", "fdh_odx", "fdh_cha", "fdh_dru",
    "fdh_phdb", "cipn_ipdx", "cancer_missing_z", "walkin_with_cancer", "invoice_debt",
]


# Rows must not pass through Python, and no join may be a product.
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, con, sf, name):
    result = compare(spark, con, name, sf)
    assert result["ok"], result
    plan = result["df"]._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in FORBIDDEN if operator in plan]


@pytest.mark.parametrize("name", WINDOWED)
def test_query_matches_its_sql_in_a_narrow_window(spark, con, sf, name):
    result = compare(spark, con, name, sf, Params("1996-03-01", "1997-02-28"))
    assert result["ok"], result


def test_every_query_has_sql_and_reads_the_whole_window():
    assert all(q.sql is not None for q in QUERIES.values())
    assert all(q.params == WHOLE for q in QUERIES.values())


def test_a_wrong_presence_rule_is_noticed(spark, con, sf, monkeypatch):
    monkeypatch.setattr(fdh, "filled", fdh.known)
    assert not compare(spark, con, "fdh_opd", sf)["ok"]
