"""Dense numbers over distributed rows.

A window without a partition, or over one very large group, puts every row in
one task.  Here the rows are range-partitioned by their order, numbered inside
each partition, and shifted by what the earlier partitions hold.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SLOT, _PART, _ROW, _BASE = "_slot", "_slice", "_row", "_base"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder: the one the session names, shared by all machines.

    Only a local session, as in tests, may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every machine can read")
        folder = tempfile.mkdtemp(prefix="claimlens-checkpoint-")
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that two passes see the same ones."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def _ascending(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def _sliced(df: DataFrame, order: list[Column]) -> DataFrame:
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(rows.withColumn(_SLOT, F.monotonically_increasing_id()))
    return (
        rows.withColumn(_PART, F.shiftright(_SLOT, _ROW_BITS))
        .withColumn(_ROW, F.col(_SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop(_SLOT)
    )


def dense_ids(
    df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int | Column = 1
) -> DataFrame:
    """Number all rows start, start+1, ... in ``order`` without gaps.

    ``order`` should be total.  The only unpartitioned window runs over one row
    per range slice, so its size and that of the broadcast are bounded by the
    number of shuffle partitions.
    """
    rows = _sliced(df, _ascending(order))
    sizes = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(_PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(_BASE))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        rows.join(F.broadcast(bases), _PART)
        .withColumn(name, (first + F.col(_BASE) + F.col(_ROW)).cast("bigint"))
        .drop(_PART, _ROW, _BASE)
    )


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "sequence"
) -> DataFrame:
    """Number the rows of each key group 1, 2, ... in ``order``.

    The same numbers as ``row_number`` over the keys, but a group larger than a
    slice stays spread over several: its later pieces are shifted by the rows
    in the earlier ones.  At most one group crosses each slice border, which
    bounds the broadcast shifts.
    """
    rows = _sliced(df, _ascending([*keys, *order]))
    pieces = rows.groupBy(_PART, *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        pieces.withColumn(_BASE, F.sum("_n").over(earlier))
        .where(F.col(_BASE) > 0)
        .select(F.col(_PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], _BASE)
    )
    same = F.col(_PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy(_PART, *keys).orderBy(_ROW))
    return (
        rows.withColumn(name, local)
        .join(F.broadcast(shifts), same, "left")
        .withColumn(name, (F.col(name) + F.coalesce(F.col(_BASE), F.lit(0))).cast("bigint"))
        .drop(_PART, _ROW, _BASE, "_p", *[f"_k{i}" for i in range(len(keys))])
    )
