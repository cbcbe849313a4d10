"""The same answers when a third of all rows share one visit or one patient."""

import duckdb
import pytest
from harness import bag, duck

from claimlens.plans.registry import QUERIES
from claimlens.sources.binding import DRIVER_TABLES

HOT = [
    "billtran", "billitems", "opservice", "dispensing", "opdx", "fdh_orf", "fdh_cha", "fdh_dru", "fdh_phdb", "fdh_idx",
    "cipn_ipdx", "cipn_invoices", "cipn_billitems", "walkin_with_cancer", "fill_diagnosis_slots", "invoice_transfer_detail",
]


@pytest.fixture(scope="module")
def skewed(sf, tmp_path_factory):
    """The driver tables with a third of the lines on one admitted order and a third of the orders on one customer."""
    target = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        source = f"'{sf}/{name}.parquet'"
        change = ""
        if name == "orders":
            change = "REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)"
        if name == "lineitem":
            hot = f"(SELECT min(o_orderkey) FROM '{sf}/orders.parquet' WHERE o_orderstatus = 'P' AND o_orderkey % 12 = 2 AND o_orderkey % 3 <> 0)"
            change = f"REPLACE (CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN {hot} ELSE l_orderkey END AS l_orderkey)"
        con.execute(f"COPY (SELECT * {change} FROM {source}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.mark.parametrize("name", HOT)
def test_hot_keys(spark, skewed, name):
    con = duck(skewed)
    query = QUERIES[name]
    df = query.run(spark, skewed)
    cursor = con.execute(query.oracle())
    expected = bag(cursor.fetchall(), [d[0] for d in cursor.description])
    assert bag(df.collect(), df.columns) == expected
