"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` equal cells; every shard owns ``virtual`` nodes at hashed cells.
A row lies in the cell of its id's hash and belongs to the first node clockwise.  Loads
are bounded: going round the ring, what finds its shard full continues clockwise to the
next shard with room, so only the overflow moves.  ``load_factor`` 1 gives every shard
its exact share (counts at most one apart); more slack means fewer moves.

Only the row count of each cell (``cells`` numbers) reaches the driver, where the walk
round the ring is planned; the rows are ranked within their cell and take their shard
and slot from the plan by a join.  The plan has at most ``cells + shards`` spans.

Defined cases: a null text has size 1 and the CRC of no bytes; a null id is hashed by
its text; rows that agree in id and text are ranked in any order, as nothing tells them
apart; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import id_text


@dataclass(frozen=True)
class Params:
    shards: int = 16
    virtual: int = 128
    cells: int = 1 << 14
    load_factor: float = 1.0


def ring(p: Params) -> list[list[int]]:
    """For each cell, the order in which shards are met clockwise from it."""
    owner = np.full(p.cells, -1)
    for shard in range(p.shards):  # a node's cell depends on its shard alone; a later shard never moves an earlier node
        for cell in np.random.default_rng([shard, 17]).integers(0, p.cells, p.virtual):
            if owner[cell] < 0:
                owner[cell] = shard
    nodes = [c for c in range(p.cells) if owner[c] >= 0]
    orders: list[list[int]] = [[]] * p.cells
    for k, node in enumerate(nodes):
        met: list[int] = []
        for step in range(len(nodes)):
            shard = int(owner[nodes[(k + step) % len(nodes)]])
            if shard not in met:
                met.append(shard)
                if len(met) == p.shards:
                    break
        met += [s for s in range(p.shards) if s not in met]
        for cell in range(nodes[k - 1] + 1 if k else nodes[-1] + 1 - p.cells, node + 1):
            orders[cell] = met
    return orders


def capacities(total: int, p: Params) -> list[int]:
    if p.load_factor <= 1:
        return [total // p.shards + (s < total % p.shards) for s in range(p.shards)]
    return [-int(-total * p.load_factor // p.shards)] * p.shards


def spans(counts: dict[int, int], p: Params) -> Iterator[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank), going round the ring once."""
    orders, room = ring(p), capacities(sum(counts.values()), p)
    used = [0] * p.shards
    for cell in sorted(counts):
        rank = 0
        for shard in orders[cell]:
            take = min(counts[cell] - rank, room[shard] - used[shard])
            if take > 0:
                yield cell, rank, rank + take, shard, used[shard]
                used[shard] += take
                rank += take
            if rank == counts[cell]:
                break


def assign(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark, text_col = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = id_text(docs, doc_id, text).select(
        "doc_id",
        (F.octet_length(text_col) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_col.cast("binary")).alias("text_crc32"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("point"),
    )
    rows = rows.withColumn("cell", F.pmod(F.col("point"), F.lit(p.cells)).cast("int"))
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    plan = spark.createDataFrame(
        list(spans(counts, p)), "at int, from_rank long, end_rank long, shard int, from_slot long"
    )
    order = Window.partitionBy("cell").orderBy("point", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    here = (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(plan), here)  # bounded by cells + shards
    slot = F.col("from_slot") + F.col("rank") - F.col("from_rank")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
