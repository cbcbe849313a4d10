"""Invoices for a set of visits, built together.

For each visit: a transfer with its lines and sums, a credit with its sums, and
debts with their sums; the charge lines receive the credit's finance number.
Charge lines are aggregated once; every sum below is a roll-up of that
aggregate.  Ids are assigned up front as dense runs, so no table has to be
written before another can be built.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.flags import constants, join_text, money
from claimlens.functions.numbering import dense_ids, durable
from claimlens.sources.tables import Tables

_DEBT_KEYS = ["vn", "hn", "vstdate", "vsttime", "staff", "pttype"]
_STATES = ("01", "02", "03")
_AMOUNTS = [*[f"s{s}" for s in _STATES], "total", "discount"]


class Invoices:
    """The tables that invoicing ``visits`` (a DataFrame with ``vn``) adds or changes.

    ``visits`` may carry a ``vercode`` for the debt.  A visit is invoiced only
    if it can be invoiced completely: it has a visit row, a summary, a payer row
    and a charge line.  The others are in ``rejected``.  ``now`` is the time put
    on the debts; ``first_ids`` gives the first free number of an id, 1 if absent.
    """

    def __init__(
        self, t: Tables, visits: DataFrame, now: str = "00:00:00", first_ids: Mapping[str, int | Column] | None = None
    ):
        self.t, self.now = t, now
        self.first_ids = dict(first_ids or {})
        self._shared = False
        # a visit asked for twice takes the largest code, whatever the order of the rows
        codes = [F.max("vercode").alias("vercode")] if "vercode" in visits.columns else []
        self.asked = visits.groupBy("vn").agg(*codes) if codes else visits.select("vn").distinct()

    def _first(self, name: str) -> int | Column:
        return self.first_ids.get(name, 1)

    @cached_property
    def visits(self) -> DataFrame:
        """Visits that can be invoiced, with the columns of their headers.

        Kept on disk: transfers, credits and sums all start from it, and finding
        it takes a pass over the charge lines.
        """
        t = self.t
        rows = self.asked.join(t["ovst"].select("vn", "vstdate", "vsttime", "staff"), "vn")
        rows = rows.join(t["vn_stat"].select("vn", "uc_money"), "vn")
        rows = rows.join(t["visit_pttype"].select("vn").distinct(), "vn", "left_semi")
        return durable(rows.join(t["opitemrece"].select("vn").distinct(), "vn", "left_semi"))

    @property
    def rejected(self) -> DataFrame:
        """Visits asked for that lack something an invoice needs."""
        return self.asked.join(self.visits.select("vn"), "vn", "left_anti")

    @cached_property
    def charges(self) -> DataFrame:
        """What the visits' lines add to each paid state, the total and the discount.

        When all tables are built together the lines are summed once per visit,
        staff, payer and income and kept on disk, since five tables roll that up.
        A single table sums the lines directly.
        """
        price = F.col("sum_price")
        by_state = [F.when(F.col("paidst") == s, price).otherwise(0).alias(f"s{s}") for s in _STATES]
        lines = self.t["opitemrece"].join(self.visits.select("vn"), "vn", "left_semi")
        rows = lines.select(*_DEBT_KEYS, "income", *by_state, price.alias("total"), "discount")
        if not self._shared:
            return rows
        return durable(rows.groupBy(*_DEBT_KEYS, "income").agg(*[F.sum(c).alias(c) for c in _AMOUNTS]))

    def _rolled(self, *keys: str) -> DataFrame:
        return self.charges.groupBy(*keys).agg(*[money(F.sum(c)).alias(c) for c in _AMOUNTS])

    # -- transfer ----------------------------------------------------------

    @cached_property
    def _transfers(self) -> DataFrame:
        return dense_ids(self.visits, ["vn"], "opd_opi_fn_tr_list_id", self._first("opd_opi_fn_tr_list_id"))

    def transfer_list(self) -> DataFrame:
        """One header per visit."""
        return self._transfers.select(
            "opd_opi_fn_tr_list_id",
            F.col("vstdate").alias("opd_opi_fn_tr_date"),
            F.col("vsttime").alias("opd_opi_fn_tr_time"),
            "vn",
            F.col("uc_money").alias("transfer_amount"),
            F.col("staff").alias("opd_opi_fn_tr_staff"),
        )

    def _transfer_ids(self) -> DataFrame:
        return self._transfers.select("vn", "opd_opi_fn_tr_list_id")

    def transfer_links(self, existing: DataFrame | None = None) -> DataFrame:
        """One row per charge line; rows of ``existing`` for the same lines are replaced."""
        lines = self.t["opitemrece"].select("vn", "hos_guid").join(self._transfer_ids(), "vn")
        new = lines.select(F.col("hos_guid").alias("opi_guid"), "hos_guid", "vn", "opd_opi_fn_tr_list_id")
        if existing is None:
            return new
        kept = existing.join(lines.select("hos_guid").distinct(), "hos_guid", "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)

    def transfer_detail(self) -> DataFrame:
        """Sums by income and payer with the paid states side by side, linked to the credit."""
        rows = self._rolled("vn", "income", "pttype").join(self._transfer_ids(), "vn").join(self._credit_ids(), "vn")
        rows = dense_ids(rows, ["vn", "income", "pttype"], "opd_opi_fn_tr_detail_id", self._first("opd_opi_fn_tr_detail_id"))
        return rows.select(
            "opd_opi_fn_tr_detail_id",
            "opd_opi_fn_tr_list_id",
            "opd_opi_fn_cr_list_id",
            "income",
            "pttype",
            *[F.col(f"s{s}").alias(f"amount_paidst_{s}") for s in _STATES],
            F.col("total").alias("total_amount"),
            *constants(amount_paidst_04="0", process_order="1000", amount_paidst_04a="0", amount_paidst_04b="0"),
        )

    def finance_summary(self) -> DataFrame:
        """The same sums as totals and balances."""
        rows = dense_ids(
            self._rolled("vn", "income", "pttype"), ["vn", "income", "pttype"], "opd_opi_finance_summary_id",
            self._first("opd_opi_finance_summary_id"),
        )
        return rows.select(
            "opd_opi_finance_summary_id",
            "vn",
            "income",
            "pttype",
            *[F.col(f"s{s}").alias(f"total_paidst_{s}") for s in _STATES],
            *[F.col(f"s{s}").alias(f"total_balance_{s}") for s in _STATES],
            F.col("total").alias("total_amount"),
            F.col("total").alias("balance_amount"),
            F.col("s02").alias("total_balance_04a"),
            F.col("s02").alias("total_amount_a"),
            *constants(
                total_paidst_04="0", clear_amount="0", total_balance_04="0", status_ok="N", total_paidst_04a="0",
                total_paidst_04b="0",
            ),
        )

    # -- credit ------------------------------------------------------------

    @cached_property
    def _credits(self) -> DataFrame:
        payers = self.t["visit_pttype"].select("vn", "pttype", "pttype_number")
        rows = self.visits.join(payers, "vn")
        rows = dense_ids(rows, ["vn", "pttype_number", "pttype"], "_n", 0)
        return rows.withColumns(
            {c: (F.col("_n") + _as_column(self._first(c))).cast("bigint") for c in ("opd_opi_fn_cr_list_id", "finance_number")}
        )

    def credit_list(self) -> DataFrame:
        """One credit header per visit and payer, with its finance number."""
        return self._credits.select(
            "opd_opi_fn_cr_list_id",
            "vn",
            "pttype",
            F.col("vstdate").alias("opd_opi_fn_cr_date"),
            F.col("vsttime").alias("opd_opi_fn_cr_time"),
            F.col("staff").alias("opd_opi_fn_cr_staff"),
            F.col("uc_money").alias("clear_amount"),
            "finance_number",
            *constants(status_ok="Y"),
        )

    def _latest_credits(self) -> DataFrame:
        """The last credit of each visit, which the following tables refer to."""
        return self._credits.groupBy("vn").agg(
            F.max("opd_opi_fn_cr_list_id").alias("opd_opi_fn_cr_list_id"),
            F.max_by("finance_number", "opd_opi_fn_cr_list_id").alias("finance_number"),
        )

    def _credit_ids(self) -> DataFrame:
        return self._latest_credits().select("vn", "opd_opi_fn_cr_list_id")

    def credit_detail(self) -> DataFrame:
        """What the payer owes by income."""
        rows = self._rolled("vn", "income").join(self._credit_ids(), "vn")
        rows = dense_ids(rows, ["vn", "income"], "opd_opi_fn_cr_detail_id", self._first("opd_opi_fn_cr_detail_id"))
        return rows.select(
            "opd_opi_fn_cr_detail_id",
            "opd_opi_fn_cr_list_id",
            "income",
            F.col("s02").alias("amount_paidst_02"),
            F.col("s02").alias("total_amount"),
            F.col("s02").alias("original_total_amount"),
            *constants(amount_paidst_04="0"),
        )

    # -- debt --------------------------------------------------------------

    @cached_property
    def _debts(self) -> DataFrame:
        order = ["vn", "pttype", "staff", "hn", "vstdate", "vsttime"]
        return dense_ids(self._rolled(*_DEBT_KEYS), order, "debt_id", self._first("debt_id"))

    def debt(self) -> DataFrame:
        """One debt per visit, payer, staff and time, with a document number per visit."""
        first = self._debts.groupBy("vn").agg(F.min("debt_id").alias("_first"))
        finance = self._latest_credits().select("vn", "finance_number")
        rows = self._debts.join(first, "vn").join(finance, "vn")
        vercode = F.lit("")
        if "vercode" in self.asked.columns:
            rows = rows.join(self.asked, "vn")
            vercode = F.coalesce("vercode", F.lit(""))
        rank = (F.col("debt_id") - F.col("_first") + 1).cast("string")
        return rows.select(
            "debt_id",
            "vn",
            "hn",
            F.col("vstdate").alias("debt_date"),
            "staff",
            F.col("s02").alias("amount"),
            F.col("s02").alias("total_amount"),
            F.col("discount").alias("discount_amount"),
            "finance_number",
            "pttype",
            F.expr("try_cast(concat(cast(vstdate AS STRING), ' ', vsttime) AS TIMESTAMP_NTZ)").alias("debt_date_time"),
            join_text(F.col("pttype"), F.lit("/"), rank).alias("debt_doc_id"),
            vercode.alias("sss_approval_code"),
            *constants(
                debt_time=self.now, pt_type="OPD", computer="App precheck export", department="OPD",
                special_discount_amount="0", ofc_paid_amount="0",
            ),
        )

    def debt_detail(self) -> DataFrame:
        """What the payer owes by income, on the last debt of the visit."""
        last = self._debts.groupBy("vn").agg(F.max("debt_id").alias("debt_id"))
        rows = self._rolled("vn", "income").join(last, "vn")
        return rows.select(
            "debt_id",
            "income",
            F.col("s02").alias("amount"),
            "discount",
            F.col("s02").alias("total_amount"),
            *constants(special_discount="0"),
        )

    def stamped_lines(self) -> DataFrame:
        """All charge lines; those of invoiced visits carry the finance number."""
        lines = self.t["opitemrece"]
        old = F.col("finance_number") if "finance_number" in lines.columns else F.lit(None).cast("bigint")
        numbers = self._latest_credits().select(F.col("vn").alias("_vn"), F.col("finance_number").alias("_number"))
        rows = lines.join(numbers, F.col("vn") == F.col("_vn"), "left")
        return rows.withColumn("finance_number", F.coalesce("_number", old)).drop("_vn", "_number")

    def tables(self) -> dict[str, DataFrame]:
        """Everything one run adds or changes."""
        self._shared = True
        return {
            "opd_opi_fn_tr_list": self.transfer_list(),
            "opd_opi_hos_guid_transfer": self.transfer_links(),
            "opd_opi_fn_tr_detail": self.transfer_detail(),
            "opd_opi_finance_summary": self.finance_summary(),
            "opd_opi_fn_cr_list": self.credit_list(),
            "opd_opi_fn_cr_detail": self.credit_detail(),
            "rcpt_debt": self.debt(),
            "rcpt_debt_detail": self.debt_detail(),
            "opitemrece": self.stamped_lines(),
        }


def _as_column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def next_debt_id(t: Tables) -> Column:
    """The first free debt number."""
    return F.coalesce(t["rcpt_debt"].agg(F.max("debt_id")).scalar(), F.lit(0)) + 1


COMPLETE = "_complete"


def save_together(frames: Mapping[str, DataFrame], root: str, run: str) -> str:
    """Write all frames under ``root/run`` and, last, a marker that makes them valid.

    A run that fails half-way leaves no marker and is ignored by readers; the
    earlier runs stay untouched.  ``run`` must be new.
    """
    target = f"{root.rstrip('/')}/{run}"
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
    spark = next(iter(frames.values())).sparkSession
    marker = spark.createDataFrame([(name,) for name in frames], "table_name string")
    marker.coalesce(1).write.mode("errorifexists").json(f"{target}/{COMPLETE}")
    return target


def load_together(t: Tables, root: str, run: str) -> dict[str, DataFrame]:
    """The tables of a completed run."""
    target = f"{root.rstrip('/')}/{run}"
    names = [r.table_name for r in t.spark.read.schema("table_name string").json(f"{target}/{COMPLETE}").collect()]
    return {name: t.spark.read.parquet(f"{target}/{name}") for name in names}
