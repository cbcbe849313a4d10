"""Invoice sums, links and the all-or-nothing write."""

import pytest
from pyspark.sql import functions as F

from claimlens.operators.invoice import Invoices, load_together, next_debt_id, save_together
from claimlens.sources.binding import bind


@pytest.fixture(scope="module")
def built(spark, sf):
    t = bind(spark, sf)
    invoices = Invoices(t, t["ovst"].select("vn"), now="12:00:00", first_ids={"debt_id": next_debt_id(t)})
    return t, invoices, invoices.tables()


def test_sums_agree_across_tables(built):
    t, invoices, tables = built
    lines = t["opitemrece"].join(invoices.visits.select("vn"), "vn", "left_semi")
    owed = lines.where("paidst = '02'").agg(F.sum("sum_price")).first()[0]
    assert tables["rcpt_debt"].agg(F.sum("amount")).first()[0] == owed
    assert tables["rcpt_debt_detail"].agg(F.sum("amount")).first()[0] == owed
    assert tables["opd_opi_fn_cr_detail"].agg(F.sum("total_amount")).first()[0] == owed
    total = lines.agg(F.sum("sum_price")).first()[0]
    assert tables["opd_opi_fn_tr_detail"].agg(F.sum("total_amount")).first()[0] == total


def test_ids_are_dense_and_links_hold(built):
    t, invoices, tables = built
    for name, column in {"opd_opi_fn_tr_list": "opd_opi_fn_tr_list_id", "opd_opi_fn_cr_list": "finance_number"}.items():
        row = tables[name].agg(F.min(column).alias("a"), F.max(column).alias("b"), F.countDistinct(column).alias("n")).first()
        assert row.b - row.a + 1 == row.n == tables[name].count()
    known = tables["opd_opi_fn_cr_list"].select("opd_opi_fn_cr_list_id")
    assert tables["opd_opi_fn_cr_detail"].join(known, "opd_opi_fn_cr_list_id", "left_anti").count() == 0
    stamped = tables["opitemrece"].where("finance_number IS NOT NULL").select("vn").distinct()
    assert stamped.count() == invoices.visits.count()
    assert invoices.rejected.count() + invoices.visits.count() == t["ovst"].count()


def test_a_run_is_complete_or_absent(spark, built, tmp_path):
    t, _, tables = built
    root = str(tmp_path / "invoices")
    part = {n: tables[n] for n in ("rcpt_debt", "rcpt_debt_detail")}
    save_together(part, root, "run1")
    loaded = load_together(t, root, "run1")
    assert {n: df.count() for n, df in loaded.items()} == {n: df.count() for n, df in part.items()}
    with pytest.raises(Exception, match="(?i)exist"):
        save_together(part, root, "run1")
    broken = dict(part, bad=spark.range(1).select(F.raise_error(F.lit("stop")).alias("x")))
    with pytest.raises(Exception, match="stop"):
        save_together(broken, root, "run2")
    with pytest.raises(Exception, match="(?i)path"):
        load_together(t, root, "run2")
