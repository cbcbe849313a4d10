"""Rule ledger: every quality rule evaluated once per document, kept as a bitmask.

``ledger`` holds per document the measurements and ``failed_bits``, one bit per rule.
A policy is a versioned set of rules (a mask): applying one is ``failed_bits & mask``,
and an ablation (what each rule alone removes) is an aggregate of the masks, without
reading a text again.

Defined cases: a null text has no words and fails the length rule like an empty one;
repeated rows are measured each; an empty table gives an empty ledger; other columns
are not looked at.  All counts are of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import id_text

RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
"""Rule name to the condition, over the measurements, under which a document fails; a rule's bit is its place."""

BASE = ("few_words", "repeated_words")
POLICIES = {1: BASE, 2: tuple(RULES)}
"""Version to the rules it applies."""

def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, computing ``value`` once."""
    return F.element_at(F.transform(F.array(value), body), 1)


PLACE_BITS = 24


def _repeated_words(words: Column, windows: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    ``windows`` has the 64-bit hash of every window.  Sorted by the upper part of the hash
    with the place in the lower bits, equal windows are neighbours, and the whole hashes of
    neighbours are compared.  The places of repeated windows, sorted again, cover
    min(3, gap to the next) words each.  Texts of more words than places sort pairs.
    """
    high = F.lit(-1 << PLACE_BITS)
    low = F.lit((1 << PLACE_BITS) - 1)
    packed = F.transform(windows, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long")))
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))

    def places(s: Column, hash_of, place_of) -> Column:
        def alike(k: Column) -> Column:
            return F.coalesce(hash_of(F.get(s, k)) == hash_of(F.get(s, k + 1)), F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda _, k: alike(k - 1) | alike(k)), place_of))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def place(x: Column) -> Column:
        return x.bitwiseAND(low)

    short = _bind(F.sort_array(packed), lambda s: places(s, lambda x: F.get(windows, place(x).cast("int")), place))
    long = _bind(F.sort_array(pairs), lambda s: places(s, lambda x: x.getField("h"), lambda x: x.getField("i")))
    return (
        F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long"))
        .when(F.size(words) < 1 << PLACE_BITS, _bind(short, covered))
        .otherwise(_bind(long, covered))
    )


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    rows = id_text(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    plain = F.col("text")
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    rows = rows.withColumn("plain", plain).withColumn("words", F.array_remove(F.split("plain", " "), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = F.transform(
        F.when(F.size("words") < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("words") - 3)),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.withColumn("windows", window)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.replace("plain", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failed_bits``."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, doc_id, text).withColumn("failed_bits", bits)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def apply_policy(table: DataFrame, version: int) -> Column:
    """True for the documents that policy ``version`` keeps."""
    return table["failed_bits"].bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(table: DataFrame) -> DataFrame:
    """version, rule, n_failed, n_only (documents that only this rule of the policy removes)."""
    masks = table.groupBy("failed_bits").count()
    rules = [(v, name, mask(rules), mask((name,))) for v, rules in POLICIES.items() for name in rules]
    policy = F.explode(F.array(*[F.struct(*(F.lit(x) for x in r)) for r in rules])).alias("r")
    rows = masks.select("failed_bits", "count", policy).select("failed_bits", "count", "r.*")
    rows = rows.toDF("bits", "count", "version", "rule", "mask", "bit")
    active = F.col("bits").bitwiseAND(F.col("mask").cast("long"))
    bit = F.col("bit").cast("long")
    return rows.groupBy("version", "rule").agg(
        F.sum(F.when(active.bitwiseAND(bit) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(active == bit, F.col("count")).otherwise(0)).alias("n_only"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM m),
t AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM t
                             WHERE w3 IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
b AS (SELECT m.doc_id, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
      FROM m LEFT JOIN c ON c.doc_id = m.doc_id),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
                 + 4 * (100 * n_symbols > 10 * word_chars)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
                 + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed_bits
      FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, n_lines, failed_bits
FROM f
"""
