"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

Build, over every usable vector (equal vectors are one node, named by their smallest id):

1. Start: for each of ``trees`` random orders (signs of random projections of the centred
   vectors, then one more projection) the nodes are range-partitioned and sorted; blocks of
   ``block`` consecutive nodes are compared, each node keeps its ``seeds`` best of a block.
   Blocks are runs of an order, so no key makes one larger.
2. Rounds: every node w gathers its neighbours and nodes that name it as a neighbour (of
   those that it does not name itself at most ``reverse``, fresh ones first, as NN-descent
   samples them); members meet if one of them is fresh; each takes its best ``partners``
   that beat the worst of its list.  Lists of ``neighbours`` are merged.  All steps are joins
   and groupings by node; rounds end when less than ``settled`` of the list entries are fresh.

Search: a query's pool starts from the lists of its start nodes; in each hop its best
``expand`` nodes not yet expanded bring their lists.  The best of the pool are scored in
double precision on the original vectors.

In joins a vector travels as half-precision numbers and a scale.  Memory of a task is
bounded by its batches: lists are cut while rows stream by, whatever the group's size.

Defined cases: vectors null, empty, zero or with null or non-finite components, of a length
other than the most common one (of several the largest), and rows without an id take no part;
rows with the same id count once, with the smallest vector in array order; ties go to the
smaller id; with at most k candidates all that the walk reaches are returned; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import discard, each_batch, map_arrow, store

EDGE = "u long, v long, s float, fresh boolean"


@dataclass(frozen=True)
class Params:
    neighbours: int = 60
    reverse: int = 36
    trees: int = 8
    block: int = 512
    seeds: int = 15
    partners: int = 3
    settled: float = 0.2
    rounds: int = 8
    expand: int = 12
    hops: int = 2
    spare: int = 10
    """Pool entries beyond k that are scored exactly."""
    bits: int = 20
    seed: int = 41


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = rows.filter("vec_id is not null and size(vector) > 0")
    rows = rows.filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.agg(F.max(F.struct("rows", "n"))["n"]).first()[0]
    return rows.filter(F.size("vector") == F.lit(common)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    """Scale (float64) and half-precision components of every row."""
    scale = np.abs(x).max(axis=1)
    out = np.zeros(len(x), np.dtype([("scale", "<f8"), ("x", "<f2", x.shape[1:])]))
    out["scale"], out["x"] = scale, x / scale[:, None]
    return pa.array([row.tobytes() for row in out], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    size = len(raw) // len(column)
    rows = np.frombuffer(raw, np.dtype([("scale", "<f8"), ("x", "<f2", ((size - 8) // 2,))]))
    return rows["x"].astype(np.float32) * rows["scale"].astype(np.float32)[:, None]


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each_batch(batches):
        columns = [batch.column("node"), _packed(_matrix(batch.column("vector")))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "vec"])


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, count = None, 0
    for batch in each_batch(batches):
        x = _unpacked(batch.column("vec")).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        total, count = x.sum(axis=0) if total is None else total + x.sum(axis=0), count + len(x)
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tolist()])], names=["n", "sums"])


def _orders(mean: np.ndarray, p: Params) -> Callable:
    rng = np.random.default_rng(p.seed)
    planes = rng.normal(size=(len(mean), p.trees * (p.bits + 1)))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            x = _unpacked(batch.column("vec")).astype(np.float64)
            x = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
            y = (x @ planes).reshape(len(x), p.trees, p.bits + 1)
            code = ((y[:, :, :-1] > 0) << np.arange(p.bits - 1, -1, -1)).sum(axis=2)
            row = np.repeat(np.arange(len(x)), p.trees)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(p.trees, dtype=np.int32), len(x))),
                    pa.array(code.ravel().astype(np.int64)),
                    pa.array(y[:, :, -1].ravel()),
                    batch.column("node").take(pa.array(row)),
                    batch.column("vec").take(pa.array(row)),
                ],
                names=["tree", "code", "along", "node", "vec"],
            )

    return place


def _best(sims: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (last axis) and values of the ``count`` largest."""
    count = min(count, sims.shape[-1])
    at = np.argpartition(-sims, count - 1, axis=-1)[..., :count]
    return at, np.take_along_axis(sims, at, -1)


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: bool = True) -> pa.RecordBatch:
    columns = [pa.array(u), pa.array(v), pa.array(s.astype(np.float32)), pa.array(np.full(len(u), fresh))]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v", "s", "fresh"])


def _blocks(p: Params) -> Callable:
    def compare(rows: pa.Table) -> pa.RecordBatch:
        node, x = rows.column("node").to_numpy(), _unpacked(rows.column("vec").combine_chunks())
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        at, s = _best(sims, p.seeds)
        good = s > -np.inf
        return _edges(np.repeat(node, at.shape[1]).reshape(at.shape)[good], node[at][good], s[good])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in each_batch(batches):
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while True:
                tree = held.column("tree").to_numpy()
                end = min(p.block, int(np.searchsorted(tree, tree[0], "right")))
                if end == len(held):
                    break
                yield compare(held.slice(0, end))
                held = held.slice(end)
        if held is not None:
            yield compare(held)

    return run


def _cut(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The best ``size`` different v of every u, by u; a pair known before is not fresh."""
    order = np.lexsort((fresh, v, u))
    first = np.ones(len(order), bool)
    first[1:] = (u[order[1:]] != u[order[:-1]]) | (v[order[1:]] != v[order[:-1]])
    order = order[first]
    order = order[np.lexsort((v[order], -s[order], u[order]))]
    mine = u[order]
    rank = np.arange(len(order)) - np.searchsorted(mine, mine)
    order = order[rank < size]
    return u[order], v[order], s[order], fresh[order]


def _merge(size: int) -> Callable:
    """Lists of the best from rows sorted by u; only the unfinished list of the last u waits for the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in each_batch(batches):
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "s", "fresh"))
            if held is not None:
                rows = tuple(np.concatenate(pair) for pair in zip(held, rows, strict=True))
            rows = _cut(*rows, size)
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(c[:end]) for c in rows], names=["u", "v", "s", "fresh"])
            held = tuple(c[end:] for c in rows)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["u", "v", "s", "fresh"])

    return run


def _lists(edges: DataFrame, p: Params) -> DataFrame:
    """The graph: at most ``neighbours`` rows for each u."""
    # part of each input first, so that a node in many groups sends few rows
    rows = edges.repartition("u").sortWithinPartitions("u")
    return store(map_arrow(rows, _merge(p.neighbours), EDGE), "graph")


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, regrouped so that no key spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in each_batch(batches):
        keys = batch.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            before = [*held, batch.slice(0, end)] if end else held
            yield pa.Table.from_batches(before).combine_chunks()
            held = []
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _meet(p: Params, at_once: int = 256) -> Callable:
    """Members of each w meet; rows are sorted by w."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "w"):
            w, v = table.column("w").to_numpy(), table.column("v").to_numpy()
            fresh, least = (table.column(c).to_numpy(zero_copy_only=False) for c in ("fresh", "least"))
            x = _unpacked(table.column("vec").combine_chunks())
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            sizes = np.diff(np.append(starts, len(w)))
            for first in range(0, len(starts), at_once):
                n = sizes[first : first + at_once]
                if n.max() < 2:
                    continue
                at = starts[first : first + at_once, None] + np.arange(n.max())
                there = np.arange(n.max()) < n[:, None]
                at = np.where(there, at, starts[first])
                sims = np.matmul(x[at], x[at].transpose(0, 2, 1))
                new, worst = fresh[at] & there, np.where(there, least[at], np.inf)
                sims[~(new[:, :, None] | new[:, None, :]) | ~there[:, None, :] | (sims <= worst[:, :, None])] = -np.inf
                diagonal = np.arange(n.max())
                sims[:, diagonal, diagonal] = -np.inf
                best, s = _best(sims, p.partners)
                good = s > -np.inf
                members = v[at]
                partner = np.take_along_axis(np.broadcast_to(members[:, None, :], sims.shape), best, -1)
                u = np.broadcast_to(members[:, :, None], best.shape)[good]
                yield _edges(u, partner[good], s[good])

    return run


def _members(graph: DataFrame, p: Params, turn: int) -> DataFrame:
    """(w, v, fresh): whom every node names, and a bounded part of those that only name it."""
    pair = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    both = graph.groupBy(*pair).agg(
        F.bool_or("fresh").alias("fresh"), F.bool_or(F.col("u") < F.col("v")).alias("down"), F.bool_or(F.col("u") > F.col("v")).alias("up")
    )
    ends = F.array(
        F.struct(F.col("a").alias("w"), F.col("b").alias("v"), F.col("down").alias("named")),
        F.struct(F.col("b").alias("w"), F.col("a").alias("v"), F.col("up").alias("named")),
    )
    rows = both.select("fresh", F.explode(ends).alias("e")).select("e.w", "e.v", "fresh", "e.named")
    order = Window.partitionBy("w").orderBy(F.col("fresh").desc(), F.xxhash64("w", "v", F.lit(turn)), "v")
    callers = rows.filter("not named").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= p.reverse)
    return rows.filter("named").select("w", "v", "fresh").union(callers.select("w", "v", "fresh"))


def build(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """The graph (u, v, s, fresh) over ``vectors`` (node, vec)."""
    sums = map_arrow(vectors, _sums, "n long, sums array<double>").collect()  # a row for each partition
    if not sums:
        return vectors.sparkSession.createDataFrame([], EDGE)
    mean = np.sum([r.sums for r in sums], axis=0) / sum(r.n for r in sums)
    placed = store(map_arrow(vectors, _orders(mean, p), "tree int, code long, along double, node long, vec binary"), "orders")
    order = ["tree", "code", "along", "node"]
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "node", "vec")
    graph = _lists(map_arrow(blocks, _blocks(p), EDGE), p)
    discard(placed)
    for turn in range(p.rounds):
        full = F.when(F.count("*") >= p.neighbours, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float")
        least = graph.groupBy("u").agg(full.alias("least")).withColumnRenamed("u", "v")
        known = vectors.withColumnRenamed("node", "v").join(least, "v", "left").fillna(float("-inf"), ["least"])
        members = _members(graph, p, turn).join(known, "v").select("w", "v", "fresh", "least", "vec")
        met = map_arrow(members.repartition("w").sortWithinPartitions("w"), _meet(p), EDGE)
        before, graph = graph, _lists(graph.withColumn("fresh", F.lit(False)).union(met), p)
        discard(before)
        share = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if share is None or share < p.settled:
            break
    return graph


def _rate(keep: int) -> Callable:
    """Pools from rows sorted by q: the query's vector, old entries with their score, new ones with a vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "q"):
            q, c = table.column("q").to_numpy(), table.column("c").to_numpy(zero_copy_only=False)
            kind, s = (table.column(k).to_numpy(zero_copy_only=False).copy() for k in ("kind", "s"))
            own, new = np.flatnonzero(kind == 0), np.flatnonzero(kind == 2)
            vec = table.column("vec").combine_chunks()
            if len(new):
                mine, theirs = _unpacked(vec.take(pa.array(own))), _unpacked(vec.take(pa.array(new)))
                s[new] = np.einsum("ij,ij->i", mine[np.searchsorted(q[own], q[new])], theirs)
            rows = np.flatnonzero(kind > 0)
            u, v, score, fresh = _cut(q[rows], c[rows].astype(np.int64), s[rows], kind[rows] == 2, keep)
            yield _edges(u, v, score).set_column(3, "fresh", pa.array(fresh))

    return run


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """(q, c, s): the best nodes c found for ``queries`` (q, vec, starts: nodes to begin with), k + spare of each, roughly scored."""
    lists = store(graph.groupBy("u").agg(F.collect_list("v").alias("ids")), "lists")  # bounded by neighbours
    keep = max(k + p.spare, 2 * p.expand)
    own = queries.select("q", F.lit(None).cast("long").alias("c"), F.lit(0).alias("kind"), F.lit(None).cast("float").alias("s"), "vec")
    begin = queries.select("q", F.explode("starts").alias("node"))
    pool: DataFrame | None = None
    visited: DataFrame | None = None
    for _ in range(p.hops + 1):
        if pool is None:
            frontier = begin
        else:
            left = pool.join(visited, ["q", "c"], "left_anti")
            order = Window.partitionBy("q").orderBy(F.col("s").desc(), "c")
            left = left.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= p.expand)
            frontier = store(left.select("q", F.col("c").alias("node")), "frontier")
        seen = frontier.select("q", F.col("node").alias("c"))
        visited = seen if visited is None else visited.union(seen)
        found = frontier.join(lists, frontier.node == lists.u, "left")
        found = found.select("q", F.explode(F.concat(F.array("node"), F.coalesce("ids", F.array().cast("array<long>")))).alias("c")).distinct()
        if pool is not None:
            found = found.join(pool.select("q", "c"), ["q", "c"], "left_anti")
        new = found.join(vectors.select(F.col("node").alias("c"), "vec"), "c")
        rows = own.union(new.select("q", "c", F.lit(2).alias("kind"), F.lit(None).cast("float").alias("s"), "vec"))
        if pool is not None:
            rows = rows.union(pool.select("q", "c", F.lit(1).alias("kind"), "s", F.lit(None).cast("binary").alias("vec")))
        rated = map_arrow(rows.repartition("q").sortWithinPartitions("q"), _rate(keep), EDGE)
        pool = store(rated.select(F.col("u").alias("q"), F.col("v").alias("c"), "s"), "pool")
    return pool


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each_batch(batches):
        score = np.einsum("ij,ij->i", _matrix(batch.column("one")), _matrix(batch.column("two")))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("c"), pa.array(score)], names=["q", "c", "score"])


def _smallest(rows: DataFrame, by: str, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each ``by``; Spark cuts groups before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", rank).filter(F.col("place") <= count).drop("place")


def nearest(rows: DataFrame, query: Column, k: int = 20, p: Params = Params(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id satisfies ``query`` its k nearest other rows found."""
    rows = store(usable(rows, vec_id, vector), "vectors")
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = store(classes, "nodes")
    vectors = store(map_arrow(classes.select("node", "vector"), _pack, "node long, vec binary"), "packed")
    repeated = classes.filter("copies > 1").select("node", "vector")
    copies = rows.join(repeated, "vector").select("node", "vec_id")
    single = classes.filter("copies = 1").select("node", F.col("node").alias("vec_id"))
    members = store(copies.union(single), "members")
    asked = members.filter(query)
    graph = build(vectors, p)
    wanted = vectors.join(asked.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select(F.col("node").alias("q"), "vec", F.array("node").alias("starts"))
    found = search(graph, vectors, wanted, k, p)
    near = _smallest(found, "q", [F.col("s").desc(), F.col("c")], k + p.spare)
    one, two = (classes.select(F.col("node").alias(n), F.col("vector").alias(v)) for n, v in (("q", "one"), ("c", "two")))
    scored = map_arrow(near.join(two, "c").join(one, "q").select("q", "c", "one", "two"), _exact, "q long, c long, score double")
    # of equal vectors only the smallest ids can be among the k nearest, or the k nearest but the query's own
    named = _smallest(members, "node", [F.col("vec_id")], k + 1).withColumnRenamed("node", "c")
    order = [F.col("score").desc(), F.col("vec_id")]
    lists = _smallest(scored.join(named, "c"), "q", order, k + 1)
    entry = F.struct((-F.col("score")).alias("less"), "vec_id", "score")
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    mine = asked.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(others).alias("rank", "found"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "found.vec_id", "found.score")
