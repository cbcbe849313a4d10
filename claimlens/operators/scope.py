"""Building blocks shared by the claim files: window, payer scope, joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.params import Params
from claimlens.sources.tables import Tables

# The scheme groups a fund code stands for.
FUND_GROUPS = {
    "FDH": ("UCS", "WEL"),
    "ECLAIM": ("UCS", "WEL", "LGO", "OFC", "STP", ""),
}
PAYER_PAYS = "02"
PATIENT_PAYS = ("01", "03")


def fund_groups(fund: str) -> tuple[str, ...]:
    return FUND_GROUPS.get(fund, (fund,))


def fund_filter(fund: str, column: str = "hipdata_code") -> Column:
    """Schemes that belong to a fund."""
    return F.col(column).isin(*fund_groups(fund))


def date_window(column: str, p: Params) -> Column:
    """Inclusive date window on the raw column, so that it reaches the scan."""
    return F.col(column).between(F.lit(p.date_from), F.lit(p.date_to))


def of_dates(t: Tables, table: str, p: Params) -> DataFrame:
    """Charge lines or diagnoses that can belong to visits of the window, by their date rule if there is one."""
    rule = t.dates.get(table)
    return t[table].where(rule.condition(p)) if rule else t[table]


def children_of(stays: DataFrame, t: Tables, table: str, p: Params, key: str = "vn") -> DataFrame:
    """The rows of ``table`` whose key is among ``stays``, before anything is grouped.

    The rows kept are partitioned by the key, which serves the grouping and the join back.
    """
    return of_dates(t, table, p).join(stays.select(key), key, "left_semi")


def active_schemes(t: Tables, groups: Sequence[str], only_in_use: bool = True) -> DataFrame:
    schemes = t["pttype"].where(F.col("hipdata_code").isin(*groups))
    return schemes.where("isuse = 'Y'") if only_in_use else schemes


def keep_schemes(df: DataFrame, column: str, schemes: DataFrame) -> DataFrame:
    listed = schemes.select(F.col("pttype").alias("_scheme"))
    return df.join(listed, F.col(column) == F.col("_scheme"), "left_semi")


def payer_scope(
    df: DataFrame,
    column: str,
    t: Tables,
    p: Params,
    mode: str,
    fund: str,
    payer_column: str | None = None,
) -> DataFrame:
    """Rows whose scheme is in scope.

    *override*: ticked payers replace the fund; *intersect*: they narrow it;
    *groups*: ticked scheme groups replace the fund's own, and ticked payers
    narrow ``payer_column``.
    """
    fund = p.fund or fund
    if mode == "override":
        if p.payers:
            return df.where(F.col(column).isin(*p.payers))
        return keep_schemes(df, column, active_schemes(t, fund_groups(fund)))
    if mode == "intersect":
        kept = keep_schemes(df, column, active_schemes(t, fund_groups(fund)))
        return kept.where(F.col(column).isin(*p.payers)) if p.payers else kept
    if mode == "groups":
        kept = keep_schemes(df, column, active_schemes(t, p.groups or fund_groups(fund)))
        return kept.where(F.col(payer_column or column).isin(*p.payers)) if p.payers else kept
    raise ValueError(f"unknown payer scope mode: {mode}")


def billed_visits(t: Tables, p: Params) -> DataFrame:
    """Visits with a charge line for the payer in the window, one row each."""
    lines = t["opitemrece"].where(date_window("vstdate", p) & (F.col("paidst") == PAYER_PAYS))
    return lines.select("vn").distinct()


def keep_billed(df: DataFrame, column: str, t: Tables, p: Params) -> DataFrame:
    billed = billed_visits(t, p).select(F.col("vn").alias("_billed"))
    return df.join(billed, F.col(column) == F.col("_billed"), "left_semi")


def hospital_code(t: Tables) -> Column:
    """The hospital's own code; the smallest one where several are configured."""
    return t["opdconfig"].agg(F.min("hospitalcode")).scalar()


def link(df: DataFrame, right: DataFrame, alias: str, on: str, how: str = "left") -> DataFrame:
    """Join ``right`` under ``alias`` on an equality such as ``"p.hn = ov.hn"``."""
    return df.join(right.alias(alias), F.expr(on), how)


def with_children(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """``parent`` left-joined to ``child`` on ``key``, safe for a huge child group.

    An outer join cannot be split on its nullable side, so one parent with very
    many children would be one task.  The matched rows come from an inner join,
    which adaptive execution splits, and childless parents are added to them.
    Apart from the key, column names must differ.
    """
    matched = parent.join(child, key)
    childless = parent.join(child.select(key).distinct(), key, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def union_branches(p: Params, opd: DataFrame | None, ipd: DataFrame | None) -> DataFrame:
    """The outpatient and inpatient halves that are switched on."""
    halves = [df for on, df in zip(p.branches, (opd, ipd)) if on and df is not None]
    return reduce(DataFrame.unionByName, halves)
