"""Date rules: how far the dates of child rows lie from the date of their visit.

A file of one month needs the charge lines and diagnoses of that month's visits only, but a
line may carry another date than its visit.  ``measure`` finds, per month of the visit, the
smallest and largest distance; ``write_rules`` stores it beside the tables with the names of
the files it was measured on.  ``with_rules`` attaches rules to tables after checking that
the files are still the same, so a stale rule is not used and the whole table is read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.params import Params
from claimlens.sources.tables import Tables


@dataclass(frozen=True)
class DateRule:
    """Distances in days by visit month (its first day); ``undated``: some child rows have no date."""

    column: str
    parent: str
    months: Mapping[dt.date, tuple[int, int]]
    undated: bool

    def condition(self, p: Params) -> Column:
        """Which child rows can belong to visits of the window."""
        near = [d for month, d in self.months.items() if p.date_from.replace(day=1) <= month <= p.date_to]
        column, undated = F.col(self.column), F.col(self.column).isNull() if self.undated else F.lit(False)
        if not near:
            return undated
        low, high = min(lo for lo, _ in near), max(hi for _, hi in near)
        days = dt.timedelta(days=1)
        return column.between(F.lit(p.date_from + low * days), F.lit(p.date_to + high * days)) | undated


def measure(t: Tables, child: str, parent: str, key: str = "vn", child_date: str = "vstdate", parent_date: str = "vstdate") -> DataFrame:
    """(month, low, high, undated) of the child rows that have a dated parent."""
    rows = t[child].select(key, F.col(child_date).alias("_child"))
    parents = t[parent].where(F.col(parent_date).isNotNull()).select(key, F.col(parent_date).alias("_parent"))
    distance = F.datediff("_child", "_parent")
    return rows.join(parents, key).groupBy(F.trunc("_parent", "month").alias("month")).agg(
        F.min(distance).alias("low"), F.max(distance).alias("high"), F.bool_or(F.col("_child").isNull()).alias("undated")
    )


def _files(t: Tables, *names: str) -> str:
    listed = sorted(f for n in names for f in t[n].inputFiles())
    return hashlib.sha256("\n".join(listed).encode()).hexdigest()


def write_rules(t: Tables, path: str, children: Mapping[str, str], key: str = "vn", column: str = "vstdate") -> None:
    """Measure the ``children`` (child table to parent table) and store the result, a row per child and month."""
    frames = [
        measure(t, child, parent, key, column, column).select(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(column).alias("column"),
            F.lit(_files(t, child, parent)).alias("files"), "month", "low", "high", "undated",
        )
        for child, parent in children.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    out.coalesce(1).write.mode("overwrite").parquet(path)


def with_rules(t: Tables, path: str) -> Tables:
    """``t`` with the stored rules of tables whose files have not changed (a few rows per month are read)."""
    rules: dict[str, DateRule] = {}
    rows = t.spark.read.parquet(path).collect()
    for child, parent in {(r.child, r.parent) for r in rows}:
        mine = [r for r in rows if r.child == child]
        if child not in t or parent not in t or mine[0].files != _files(t, child, parent):
            continue
        # a month whose children all lack a date has no distance
        months = {r.month: (r.low, r.high) for r in mine if r.low is not None}
        rules[child] = DateRule(mine[0].column, parent, months, any(r.undated for r in mine))
    return t.with_dates(rules)
