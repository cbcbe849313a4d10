"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and a
   signature of minima under random permutations.
2. Texts with the same set are one class; classes are banded, each band hashed to a key.
3. Candidates (classes that share a key) compare their signatures batch by batch.
   With a uniform prior, after m matches in n places the similarity is Beta(m+1, n-m+1);
   a pair is pruned as soon as the chance that it reaches the threshold falls under
   the chosen miss probability.
4. Survivors are verified exactly on the full shingle sets of the whole texts, which are
   written once.  Every class meets one pivot of each of its keys; keys that still hold
   several components are cut into cells of bounded size, in which all pairs meet (steps 3
   and 4) and only the links that connect something are returned.
5. Verified links become components by distributed union-find.

Defined cases: null and empty texts have the empty set and are linked with nothing; a
text with fewer words than a shingle is one shingle of all its words; repeated rows are
one class, and rows with the same doc_id are returned as often as they came; of a group
the text with the smallest doc_id is kept (of several such texts the one with the smallest
hash); a null doc_id is never the smallest of a group that has another; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import wordhash
from claimlens.llm.common import each_batch, id_text, map_arrow, store, text_chunks, with_hash
from claimlens.llm.graph import link


@dataclass(frozen=True)
class Params:
    """``percent``: linked if 100 * intersection >= percent * union of the shingle sets."""

    width: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 20
    batch: int = 32
    batches: int = 4
    miss: float = 1e-6
    """Chance, per batch looked at, of pruning a pair at the threshold."""

    @property
    def places(self) -> int:
        return self.batch * self.batches


def _permutations(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(71)
    return rng.integers(0, 1 << 31, p.places, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(
        0, 1 << 32, p.places, dtype=np.uint32
    )


def least_matches(p: Params) -> list[int]:
    """For each batch, the fewest matches so far with which a pair stays.

    P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t, out = p.percent / 100, []
    for n in range(p.batch, p.places + 1, p.batch):
        chance, m = 0.0, -1
        while chance < p.miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    h, doc, _, _ = wordhash.words(data, at)
    return wordhash.distinct_per_text(*wordhash.shingles(h, doc, len(at) - 1, width))


def _signer(p: Params):
    factor, shift = _permutations(p)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            for first, end, data, at in text_chunks(batch.column("text")):
                n = end - first
                sh, doc = _sets(data, at, p.width)
                size = np.bincount(doc, minlength=n)
                some = np.flatnonzero(size)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                signatures = np.zeros((n, p.places), np.uint32)
                if len(some):
                    starts = (np.cumsum(size) - size)[some]
                    one[some] = np.add.reduceat(sh, starts)
                    two[some] = np.add.reduceat(wordhash.mix(sh ^ np.uint64(0x5DEECE66D)), starts)
                    low = (sh >> np.uint64(32)).astype(np.uint32)
                    for j in range(p.places):
                        signatures[some, j] = np.minimum.reduceat(low * factor[j] + shift[j], starts)
                keys = np.zeros((n, p.bands), np.uint64)
                for b in range(p.bands):
                    key = np.full(n, b + 1, np.uint64)
                    for column in signatures[:, b * p.rows : (b + 1) * p.rows].T:
                        key = wordhash.mix(key * np.uint64(3) + column)
                    keys[:, b] = key
                raw, keys = signatures.astype("<u4"), keys.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        batch.column("text_hash").slice(first, n),
                        pa.array(size, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1, dtype=np.int32) * p.bands), pa.array(keys.ravel())
                        ),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "one", "two", "signature", "keys"],
                )

    return sign


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, text_hash, n_shingles, a 128-bit fingerprint of the set (one, two), signature, band keys."""
    schema = "doc_id long, text_hash long, n_shingles long, one long, two long, signature binary, keys array<long>"
    return map_arrow(docs, _signer(p), schema)


def _likely(p: Params):
    bounds = least_matches(p)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, p.places) for c in ("sa", "sb")
            )
            alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
            for k, bound in enumerate(bounds):
                part = slice(k * p.batch, (k + 1) * p.batch)
                matches[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= bound]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return keep


def _setter(p: Params):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            one = batch.column("one").to_numpy(zero_copy_only=False).view(np.uint64)
            for first, end, data, at in text_chunks(batch.column("text")):
                sh, doc = _sets(data, at, p.width)
                parts = np.split(sh, np.searchsorted(doc, np.arange(1, end - first)))
                if any(x.sum() != y for x, y in zip(parts, one[first:end], strict=True)):
                    raise RuntimeError("two texts of one id share a 64-bit hash")
                rows = batch.slice(first, end - first)
                size = pa.array([len(x) for x in parts], pa.int64())
                raw = pa.array([x.astype("<u8").tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), size, rows.column("signature"), raw], names=["id", "size", "signature", "shingles"]
                )

    return sets


def _exactly(p: Params):
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            good: list[int] = []
            for k, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= p.percent * (len(x) + len(y) - both):
                    good.append(k)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return keep


CELL_ROWS = 256
"""Members of a key that are compared in one place, with as many others."""
CELL_SHINGLES = 1 << 18
"""Shingles that they have together; a larger set is alone."""


def _common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[value] > 1
    row, value = row[shared], value[shared]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    value = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    for first in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        part = slice(*np.searchsorted(value, [first, first + width]))
        marks = np.zeros((n, width), np.float32)  # sums of ones up to 4096 are exact
        marks[row[part], value[part] - first] = 1
        out += (marks @ marks.T).astype(np.int64)
    return out


def _cell(p: Params):
    bounds = least_matches(p)

    def links(rows: pa.Table) -> pa.Table:
        """Of all pairs between components of a cell that are linked, as many as connect what they connect."""
        ids, component, part = (rows.column(c).to_numpy() for c in ("id", "component", "part"))
        sets = [np.frombuffer(v.as_buffer(), "<u8") for v in rows.column("shingles")]
        signed = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u4").reshape(-1, p.places)
        _, group = np.unique(component, return_inverse=True)
        open_ = group[:, None] != group
        if rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py():
            open_ &= part[:, None] != part  # pairs within one part meet in its own cell
        one, two = np.nonzero(np.triu(open_))
        matches = np.zeros(len(one), np.int64)
        for k, bound in enumerate(bounds):
            for at in range(k * p.batch, (k + 1) * p.batch):
                matches += signed[one, at] == signed[two, at]
            alive = matches >= bound
            one, two, matches = one[alive], two[alive], matches[alive]
        if len(one):
            both, size = _common(sets)[one, two], np.array([len(x) for x in sets])
            good = (both > 0) & (100 * both >= p.percent * (size[one] + size[two] - both))
            one, two = one[good], two[good]
        top, found = np.arange(int(group.max()) + 1).tolist(), []
        for x, y in zip(one.tolist(), two.tolist(), strict=True):
            u, v = int(group[x]), int(group[y])
            while top[u] != u:
                top[u] = u = top[top[u]]
            while top[v] != v:
                top[v] = v = top[top[v]]
            if u != v:
                top[u] = v
                found.append((x, y))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return links


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest linked doc_id), kept: one row per document."""
    docs = with_hash(id_text(docs, doc_id, text))
    signed = store(signatures(docs, p), "signatures")
    fingerprint = F.when(F.col("n_shingles") > 0, F.xxhash64("one", "two", "n_shingles"))
    signed = signed.withColumn("id", fingerprint)
    classes = signed.filter("id is not null").groupBy("id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("row"),
        F.min(F.struct("one", "signature", "keys")).alias("same"),
    )
    classes = store(classes.select("id", "row", "same.*"), "classes")

    def side(rows: DataFrame, *names: str) -> DataFrame:
        return rows.toDF(*names)

    sets: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not sets:  # the first pairs name every class that any later pair can name
            wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
            wanted = wanted.join(classes.select("id", "row", "one", "signature"), "id")
            # one whole text of each class: the row that names it, found by its id and text
            texts = docs.join(wanted, (F.col("text_hash") == F.col("row.text_hash")) & docs.doc_id.eqNullSafe(F.col("row.doc_id")))
            texts = texts.groupBy("id", "one", "signature").agg(F.min("text").alias("text"))
            sets.append(store(map_arrow(texts, _setter(p), "id long, size long, signature binary, shingles binary"), "sets"))
        mark, whole = sets[0].select("id", "signature"), sets[0].select("id", "shingles")
        both = pairs.join(side(mark, "a", "sa"), "a").join(side(mark, "b", "sb"), "b")
        likely = store(map_arrow(both.select("a", "b", "sa", "sb"), _likely(p), "a long, b long"), "likely")
        both = likely.join(side(whole, "a", "xa"), "a").join(side(whole, "b", "xb"), "b")
        return map_arrow(both.select("a", "b", "xa", "xb"), _exactly(p), "a long, b long")

    def rest(members: DataFrame) -> DataFrame:
        rows = members.join(sets[0].select("id", "size"), "id")
        parts = F.greatest(F.count("*") / CELL_ROWS, F.sum("size") / CELL_SHINGLES)
        parts = rows.groupBy("key").agg(F.ceil(parts).cast("int").alias("parts"))
        rows = members.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        lo, hi = F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")
        rows = rows.select("key", lo, hi, "id", "component", "part").join(sets[0], "id")
        return rows.groupBy("key", "lo", "hi").applyInArrow(_cell(p), "a long, b long").distinct()

    found = link(classes.select(F.explode("keys").alias("key"), "id"), verify, rest)
    groups = classes.select("id", "row").join(found, "id", "left")
    groups = groups.withColumn("component", F.coalesce("component", "id"))
    least = groups.groupBy("component").agg(F.min("row").alias("stays"))
    groups = groups.join(least, "component").select("id", "stays")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "id").join(groups, "id", "left")
    smallest = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    kept = F.col("id").isNull() | stays
    return rows.select("doc_id", "text_hash", "n_shingles", smallest.alias("component_id"), kept.alias("kept"))
