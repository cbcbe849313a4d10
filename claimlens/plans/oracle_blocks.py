"""SQL for the shared blocks."""

from claimlens.plans.sqltext import FROM_TO, scope

_ROWS = "SELECT vn, pttype, pttype_number FROM visit_pttype WHERE pttype IN"

SQL = {
    "payer_scope_override": f"{_ROWS} ('10', '14')",
    "payer_scope_intersect": f"{_ROWS} {scope('ECLAIM')} AND pttype IN ('10', '14')",
    "payer_scope_groups": f"""
{_ROWS} (SELECT pttype FROM pttype WHERE isuse = 'Y' AND hipdata_code IN ('OFC', 'LGO')) AND pttype IN ('12', '14', '18')""",
    "billed_visits": f"SELECT DISTINCT vn FROM opitemrece WHERE vstdate {FROM_TO} AND paidst = '02'",
    "dense_ids": """
SELECT o_orderkey, o_custkey, 99 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders""",
    "number_within": """
SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sequence
FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""",
}
