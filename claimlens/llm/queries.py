"""The registered queries of the text operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import (
    bpe, byte_cnn, crf, decontaminate, line_dedup, merkle, minhash, nn_descent, periodic_runs, quality_rules, sharding,
    token_store, window_lm,
)
from claimlens.llm.common import id_text, read, shared_path, store


def tokenizer(name: str) -> tuple[str, str]:
    """(path of a public vocabulary, its split pattern)."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def quality_model(spark: SparkSession, sf_dir: str) -> byte_cnn.Model:
    return byte_cnn.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(fold(3) != 1))


def op1_window_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = store(window_lm.word_counts(id_text(docs)), "word-counts")
    p = window_lm.sized(counts)
    words, weights = window_lm.fit(docs, p, counts=counts)
    return window_lm.score(docs, words, weights, p, counts=counts)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.apply_policy(table, 1)).alias("base_failed"),
        quality_rules.apply_policy(table, 2).alias("kept"),
        "n_lines", "failed_bits",
    )


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = byte_cnn.score(read(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    held, predicted = F.coalesce(fold(3) == 1, F.lit(False)), (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document that loses lines: their numbers from 0."""
    removed = line_dedup.duplicate_lines(read(spark, sf_dir, "documents"))
    return removed.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), minhash.Params(width=3, percent=85))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("text_hash")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(read(spark, sf_dir, "documents"), path, pattern, digest=True)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-ids")
    path, pattern = tokenizer("byte_bpe_50k.json")
    token_store.write(read(spark, sf_dir, "documents"), folder, path, pattern, end_id=2)
    return token_store.digests(spark, folder)


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(fold(5) != 0)
    scored = crf.score(docs, crf.fit(docs, labels))
    held, predicted = F.coalesce(fold(5) == 0, F.lit(False)), (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "span_starts", "span_ends")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and leaked benchmark item."""
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumns({"contaminated": F.lit(True), "kept": F.lit(False)})


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read(spark, sf_dir, "documents"), fold(5) == 0)


def _repeating(text: Column) -> Column:
    """The text, for every tenth id with its words repeating from word a on with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        )
        return F.array_join(F.transform(place, lambda i: F.get(w, i)), " ")

    # an array of one is bound by transform, so the words are found once
    repeated = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, repeated).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    runs = F.col("runs")

    def longer(x: Column, y: Column) -> Column:
        """The run with more periods; runs come by start and period, so the first of equals stays."""
        return F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)

    top = F.aggregate(runs, F.get(runs, 0), longer)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_window_lm, op2_quality_rules, op3_ring_sharding, op4_quality_cnn, op5_line_dedup, op6_minhash,
        op7_bpe_round_trip, op8_token_store, op9_toxicity_crf, op10_decontamination,
        op11_nn_descent, op12_merkle_manifest, op13_periodic_runs,
    )
}
ORACLE_SQL = {"op2_quality_rules": quality_rules.ORACLE_SQL, "op12_merkle_manifest": merkle.oracle_sql()}
