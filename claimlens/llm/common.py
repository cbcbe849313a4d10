"""Reading, storing and naming helpers shared by the text operators."""

from __future__ import annotations

import importlib.util
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.numbering import checkpoint_ready

CHUNK_BYTES = 1 << 20
"""Texts are handled in numpy this many bytes at a time (a longer text alone)."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which every machine can read."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Spark's setting that removes the shuffle files of an execution at its end, not once the driver forgets them."""


def write(df: DataFrame, path: str) -> None:
    """The rows as Parquet; the shuffle files of this write, which no later step reads, go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


def store(df: DataFrame, what: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, a lost executor loses nothing."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, what)
    write(df, path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that store() wrote and no later step reads."""
    context = df.sparkSession.sparkContext
    folder = context.getCheckpointDir().rstrip("/") + "/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        if str(target).split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context, by Spark's own file distribution."""
    context = spark.sparkContext
    if getattr(context, "_claimlens_shipped", False):
        return
    package = Path(importlib.util.find_spec("claimlens").origin).parent
    target = Path(tempfile.mkdtemp(prefix="claimlens-")) / "claimlens.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    context._claimlens_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, the id as a long."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def with_hash(docs: DataFrame) -> DataFrame:
    """``id_text`` rows and their text's hash: rows are one document if id and text are equal."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def same_document(doc_id: str, text: str, other_id: str, other_hash: str) -> Column:
    """Whether a row (doc_id, text) is the document that other_id and other_hash name."""
    same_text = F.xxhash64(F.col(text).cast("string")) == F.col(other_hash)
    return F.col(doc_id).cast("long").eqNullSafe(F.col(other_id)) & same_text


def cropped(text: Column, size: int, pieces: int = 16) -> Column:
    """The text, or of one longer than ``size`` characters as many evenly spaced pieces, a line each."""
    part = size // pieces
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda k: (F.floor((F.length(text) - part).cast("long") * k / (pieces - 1)) + 1).cast("int"),
    )
    return F.when(F.length(text) > size, F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(part))), "\n")).otherwise(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels (True for 1) of at most ``rows`` labelled ids, in an order by hash, each cropped to ``size`` characters.

    The ids are drawn from the labels alone; no text is shuffled but those drawn, and only
    they reach the driver.  An id with several labels counts as the larger, one with several
    texts as the smallest; other labels than 0 and 1, null ids and null texts are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).alias("label")).filter("label in (0, 1) and id is not null")
    drawn = marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows)
    texts = id_text(docs).filter("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))  # at most ``rows``
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = texts.select("doc_id", "label", cropped(F.col("text"), size).alias("text")).collect()
    found.sort(key=lambda r: r.doc_id)
    return [r.text for r in found], np.array([r.label == 1 for r in found], bool)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n+1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole, (at - at[0]).astype(np.int64) if len(at) else np.zeros(1, np.int64)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; no text is cut."""
    data, at = text_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def each_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch
