"""Token ids in binary shard files with a minimal perfect hash index.

Documents are range-partitioned and sorted by id, encoded, and packed into blocks of
about ``block_ids`` ids (a longer document is a block of its own).  A block is one row
of the files: ``payload`` holds the raw ids as little-endian unsigned 32-bit integers;
``index`` finds a document in constant time: its key is hashed to a slot by a minimal
perfect hash, and the slot has the key's fingerprint, its offset and its length.  The
files are written by Spark's committed writer to any file system, so a lost task is
simply written again.

The perfect hash works in levels: a key alone in its cell of a level is placed there,
the others go on to the next level; the slot is the number of placed cells before it,
which the index has for every 64 cells.

``write_keys`` adds the index from a key to its part and block, in hash buckets of the
same kind, and ``get`` reads documents by key through both.

Defined cases: a null or empty text has only the end id; rows are in order of doc_id
(null first), then of the text's hash; rows with the same id are documents of their own,
told apart by their number within the id's run in the block; an empty table gives no
blocks; columns beside id and text are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.llm import wordhash
from claimlens.llm.bpe import Pieces, piece_encoder
from claimlens.llm.common import each_batch, id_text, map_arrow, ship

BLOCK = (
    "part int, block int, n_docs long, n_ids long, keys array<long>, repeats array<int>, nulls array<boolean>, "
    "index binary, payload binary"
)
_LEVELS, _SPACE = 40, 2


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return wordhash.mix(keys ^ wordhash.mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def key_hash(ids: np.ndarray, repeats: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """One 64-bit number per key; different (id, repeat, null) give different ones but for a chance of 2**-64."""
    h = wordhash.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27))
    return wordhash.mix(h ^ wordhash.mix(repeats.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64)))


_ENTRY = np.dtype([("fp", "<u4"), ("length", "<u4"), ("offset", "<u8")])


def build_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """u32 count of levels, u32 cells of each; per level its bits in 64-bit words and, u32 per word, the placed
    keys before it; then per slot fingerprint u32, length u32, offset u64."""
    rest, sizes, levels, slot, placed = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64), 0
    for level in range(_LEVELS):
        if not len(rest):
            break
        size = -(-len(rest) * _SPACE // 64) * 64
        cell = (_hash(keys[rest], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(cell, minlength=size) == 1
        rank = placed + np.cumsum(alone) - alone
        good = alone[cell]
        slot[rest[good]] = rank[cell[good]]
        placed += int(good.sum())
        sizes.append(size)
        levels += [np.packbits(alone, bitorder="little").tobytes(), rank[::64].astype("<u4").tobytes()]
        rest = rest[~good]
    if len(rest):
        raise ValueError("two keys of a block have the same hash")
    entries = np.zeros(len(keys), _ENTRY)
    entries["fp"][slot] = keys >> np.uint64(32)
    entries["length"][slot], entries["offset"][slot] = lengths, offsets
    return struct.pack(f"<{1 + len(sizes)}I", len(sizes), *sizes) + b"".join(levels) + entries.tobytes()


def look_up(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) in ids of every key; -1 where the index does not have it.

    A key costs one word and one rank of each level it is tried at, whatever the index holds.
    """
    (count,) = struct.unpack_from("<I", index)
    sizes = struct.unpack_from(f"<{count}I", index, 4)
    at = 4 + 4 * count
    slot, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, size in enumerate(sizes):
        if len(rest):
            words = np.frombuffer(index, "<u8", size // 64, at)
            ranks = np.frombuffer(index, "<u4", size // 64, at + size // 8)
            cell = _hash(keys[rest], level) % np.uint64(size)
            word, bit = words[cell >> np.uint64(6)], cell & np.uint64(63)
            good = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[rest[good]] = (ranks[cell >> np.uint64(6)] + below)[good]
            rest = rest[~good]
        at += size // 8 + size // 16
    entries = np.frombuffer(index, _ENTRY, -1, at)
    known = slot >= 0
    known[known] = entries["fp"][slot[known]] == (keys[known] >> np.uint64(32))
    offset, length = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
    offset[known], length[known] = entries["offset"][slot[known]], entries["length"][slot[known]]
    return offset, length


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Pieces:
    """The library's byte-level BPE model behind a cache of pieces; texts with a special token go to it whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    class Encoder(Pieces):
        def text(self, text: str) -> bytes:
            if any(s in text for s in special):
                return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return super().text(text)

    return piece_encoder(pattern, lambda mapped: [t.id for t in model.tokenize(mapped)], Encoder)


def _packer(path: str, pattern: str, end_id: int, block_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part = encoder(path, pattern), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size, block = 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.array([k if k is not None else 0 for k, _ in held], np.int64)
            nulls = np.array([k is None for k, _ in held])
            lengths = np.array([len(v) // 4 for _, v in held], np.int64)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
            repeats = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            index = build_index(key_hash(ids, repeats, nulls), np.cumsum(lengths) - lengths, lengths)
            row = {
                "part": part, "block": block, "n_docs": len(ids), "n_ids": int(lengths.sum()), "keys": ids,
                "repeats": repeats.astype(np.int32), "nulls": nulls, "index": index, "payload": b"".join(v for _, v in held),
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row)
            )

        for batch in each_batch(batches):
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                for key, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    ids = pieces.text(text or "") + end
                    if held and size + len(ids) // 4 > block_ids:
                        yield flush()
                        held, size, block = [], 0, block + 1
                    held.append((key, ids))
                    size += len(ids) // 4
        if held:
            yield flush()

    return pack


def write(
    docs: DataFrame,
    folder: str,
    path: str,
    pattern: str,
    end_id: int,
    block_ids: int = 1 << 19,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode with the tokenizer file ``path`` (on every worker) and its split pattern; write the blocks to ``folder``."""
    rows = id_text(docs, doc_id, text).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    map_arrow(rows, _packer(path, pattern, end_id, block_ids), BLOCK).write.parquet(folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``: ids in all blocks before."""
    table = spark.read.schema(BLOCK).parquet(folder)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.select("part", "block", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition written
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sizes.join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("start"))
    return table.join(starts, ["part", "block"])


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """A list of one row, without making Python objects of it."""
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each_batch(batches):
        for row in range(batch.num_rows):
            ids, nulls = _numbers(batch, "keys", row), _numbers(batch, "nulls", row)
            index = batch.column("index")[row].as_buffer()
            offset, length = look_up(index, key_hash(ids, _numbers(batch, "repeats", row), nulls))
            if (offset < 0).any():
                raise RuntimeError("a key of the block is not in its index")
            payload = memoryview(batch.column("payload")[row].as_buffer())
            crc = [zlib.crc32(payload[4 * o : 4 * (o + n)]) for o, n in zip(offset.tolist(), length.tolist(), strict=True)]
            place = [np.full(len(ids), batch.column(c)[row].as_py(), np.int32) for c in ("part", "block")]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, place), pa.array(ids, mask=nulls), pa.array(offset), pa.array(length), pa.array(crc, pa.int64())],
                names=["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, every document found through its block's index."""
    table = spark.read.schema(BLOCK).parquet(folder).select(
        "part", "block", "keys", "repeats", "nulls", "index", "payload"
    )
    schema = "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    found = map_arrow(table, _crc, schema)  # before the join, which then moves no payload
    starts = blocks(spark, folder).select("part", "block", "start")
    rows = found.join(starts, ["part", "block"])
    return rows.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


KEYS = "bucket long, buckets long, index binary"


def _homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each_batch(batches):
        for row in range(batch.num_rows):
            ids, nulls = _numbers(batch, "keys", row), _numbers(batch, "nulls", row)
            new = np.ones(len(ids), bool)  # equal ids of a block stand together
            new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
            place = [np.full(int(new.sum()), batch.column(c)[row].as_py(), np.int32) for c in ("part", "block")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[new], mask=nulls[new]), *map(pa.array, place)], names=["doc_id", "part", "block"]
            )


def _id_arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def _bucket_index(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("block", "ascending")])
    ids, nulls = _id_arrays(rows.column("doc_id"))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(ids)))
    repeats = np.arange(len(ids)) - np.repeat(start, count)
    home = rows.column("part").to_numpy().astype(np.int64) << 32 | rows.column("block").to_numpy().astype(np.int64)
    index = build_index(key_hash(ids, repeats, nulls), home, np.repeat(count, count))
    named = [rows.column(c)[:1].combine_chunks() for c in ("bucket", "buckets")]
    return pa.table([*named, pa.array([index], pa.binary())], names=["bucket", "buckets", "index"])


def write_keys(spark: SparkSession, folder: str, target: str, bucket_keys: int = 1 << 16) -> None:
    """The index from keys to blocks of the store in ``folder``, written to ``target``.

    Keys are hashed to buckets of about ``bucket_keys``; a bucket is one row, a minimal perfect
    hash from a key to the part and block that hold it.  An id that lies in several blocks has
    an entry for each, numbered from 0, and in each their number.  Only the key columns of the
    store are read.  An empty store gives no buckets.
    """
    table = spark.read.schema(BLOCK).parquet(folder)
    buckets = -(-(table.agg(F.sum("n_docs")).first()[0] or 0) // bucket_keys) or 1
    homes = map_arrow(table.select("part", "block", "keys", "nulls"), _homes, "doc_id long, part int, block int")
    homes = homes.withColumn("bucket", _bucket(buckets)).withColumn("buckets", F.lit(buckets).cast("long"))
    homes.groupBy("bucket").applyInArrow(_bucket_index, KEYS).write.parquet(target)


def _locate(wanted: pa.Table, index: pa.Table) -> pa.Table:
    ids, nulls = _id_arrays(wanted.column("doc_id"))
    found = []
    row, repeat = np.arange(len(ids) if index.num_rows else 0), 0
    while len(row):  # once for most; as often as the most spread id has blocks
        home, count = look_up(index.column("index")[0].as_buffer(), key_hash(ids[row], np.full(len(row), repeat), nulls[row]))
        row, home, count = row[home >= 0], home[home >= 0], count[home >= 0]
        found.append((row, home))
        repeat += 1
        row = row[count > repeat]
    rows, homes = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    columns = [pa.array(ids[rows], pa.int64(), mask=nulls[rows])]
    columns += [pa.array((homes >> 32).astype(np.int32)), pa.array((homes & 0xFFFFFFFF).astype(np.int32))]
    return pa.table(columns, names=["doc_id", "part", "block"])


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each_batch(batches):
        for row in range(batch.num_rows):
            held, none = _numbers(batch, "keys", row), _numbers(batch, "nulls", row)
            wanted, blank = _id_arrays(pa.chunked_array([batch.column("wanted")[row].values]))
            # the block's keys stand in order: they say how many documents an id has, none for a mere equal fingerprint
            own = held[~none]
            count = np.searchsorted(own, wanted, "right") - np.searchsorted(own, wanted, "left")
            count = np.where(blank, none.sum(), count)
            ids, blank = np.repeat(wanted, count), np.repeat(blank, count)
            repeats = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
            offset, length = look_up(batch.column("index")[row].as_buffer(), key_hash(ids, repeats, blank))
            payload = batch.column("payload")[row].as_buffer()
            tokens = [np.frombuffer(payload, "<i4", n, 4 * o) for o, n in zip(offset.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=blank), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )


def get(spark: SparkSession, folder: str, index: str, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids of every stored document whose id is in ``keys``, through the index that write_keys() wrote.

    Ids that are not in the store give no rows; a repeated key counts once; a null key finds the
    documents without an id.  Only the blocks that the index names have their payload read out.
    """
    table = spark.read.schema(KEYS).parquet(index)
    head = table.select("buckets").first()
    wanted = keys.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    wanted = wanted.withColumn("bucket", _bucket(head["buckets"] if head else 1))
    ship(spark)
    homes = wanted.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_locate, "doc_id long, part int, block int")
    # collect_list leaves nulls out, a list of structs does not; a block's ids are at most its documents
    homes = homes.groupBy("part", "block").agg(F.collect_list(F.struct("doc_id"))["doc_id"].alias("wanted"))
    stored = spark.read.schema(BLOCK).parquet(folder).select("part", "block", "keys", "nulls", "index", "payload")
    return map_arrow(stored.join(homes, ["part", "block"]), _fetch, "doc_id long, ids array<int>")
