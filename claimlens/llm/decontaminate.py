"""Benchmark decontamination by template windows, in DataFrame functions only.

Text becomes tokens: words, numbers, and single characters of scripts written without
blanks; punctuation only tells where sentences end.  Numbers, names (a capital inside a
sentence), units and capitalised words that start a sentence (names or not) become typed
placeholders, other words lose their case.  Windows of ``width`` tokens with enough literal
words are hashed and joined with those of the benchmark.  For a document and an item at one
alignment, the slots (what stood at the placeholders) must be replaced consistently: each
value of the item by one value of the document and the reverse, so a question asked again
with other numbers or names is caught and a chance mix of values is not.  An item counts as
leaked when its covered tokens reach ``percent`` of it.

Items without such a window (short ones, sums, lists of names) are looked for as they are:
by windows of their own length, at most ``width``, over tokens with their values.

Texts are read once: a window that is in the benchmark takes its tokens along.

Defined cases: null and empty texts on either side give nothing; an item of fewer than
``least`` tokens says nothing about a text and is not looked for; repeated rows are found
each, rows with the same doc_id and text count as one document; a null doc_id is kept as such;
empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import free_name, id_text, same_document, store, with_hash

# Unit words, after a number or alone.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "ounce", "ounces", "pound", "pounds", "ton", "tons",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "percent", "degree", "degrees",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "mph", "kmh", "watt", "watts", "volt", "volts",
)


@dataclass(frozen=True)
class Params:
    width: int = 8
    literals: int = 4
    percent: int = 50
    least: int = 3
    broadcast_rows: int = 500_000
    """Benchmark windows are broadcast up to this many (8 bytes each and a few for the item)."""


_DOC = ["doc_id", "text_hash"]
"""What names a document."""
_NAMED, _FIRST = "\x01", "\x02"
"""Marks before a capital inside a sentence, and before any other."""
_INSIDE = r"(?<=[^.!?\s\x01][ \t]{1,4})(?=\p{Lu})"
_OUTSIDE = r"(?<![\p{L}\p{M}\x01])(?=\p{Lu})"
_JOINED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
"""Scripts written without blanks."""
_TOKEN = rf"[\x01\x02]?[\p{{L}}\p{{M}}&&[^{_JOINED}]]+|[{_JOINED}]|[0-9]+(?:[.,:/][0-9]+)*"
_NUMBER, _NAME, _UNIT, _START = "<number>", "<name>", "<unit>", "<start>"


def _forms(tokens: Column) -> Column:
    """The template of tokens."""
    return F.transform(
        tokens,
        lambda t: F.when(F.ascii(t) == 1, F.lit(_NAME))
        .when(F.ascii(t) == 2, F.lit(_START))
        .when(F.ascii(t) <= 57, F.lit(_NUMBER))
        .when(t.isin(*UNITS), F.lit(_UNIT))
        .otherwise(t),
    )


def _tokenised(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with the columns tokens (lower case, capitals marked) and forms."""
    marked = F.regexp_replace(F.translate(F.col("text"), _NAMED + _FIRST, "  "), _INSIDE, _NAMED)
    marked = F.regexp_replace(marked, _OUTSIDE, _FIRST)
    tokens = F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))
    rows = rows.select(*keep, tokens.alias("tokens"))
    return rows.select(*keep, "tokens", _forms(F.col("tokens")).alias("forms"))


def _plain(token: Column) -> Column:
    return F.translate(token, _NAMED + _FIRST, "")


def _windows(rows: DataFrame, keep: list[str], exact: list[int], p: Params) -> DataFrame:
    """``keep``, tokens, place, size and hash of every template window, and of every exact window of the sizes ``exact``.

    ``size`` is 0 for a template window of ``width`` tokens.
    """
    least = min([p.width, *exact])
    starts = F.when(F.size("forms") >= least, F.sequence(F.lit(0), F.size("forms") - least))
    # outer: Spark would otherwise compute the tokens a second time to leave out texts without a window
    placed = rows.select(*keep, "tokens", "forms", starts.alias("starts")).withColumn("place", F.explode_outer("starts"))
    placed = placed.filter("place is not null")
    template = F.xxhash64(*(F.get("forms", F.col("place") + k) for k in range(p.width)))
    if not exact:
        return placed.select(*keep, "tokens", "place", F.lit(0).alias("size"), template.alias("h"))
    hashes = [(0, p.width, template)]
    hashes += [(n, n, F.xxhash64(F.lit(n), *(_plain(F.get("tokens", F.col("place") + k)) for k in range(n)))) for n in exact]
    inside = [F.when(F.col("place") + n <= F.size("forms"), F.struct(F.lit(size).alias("size"), h.alias("h"))) for size, n, h in hashes]
    each = placed.select(*keep, "tokens", "place", F.explode(F.array(*inside)).alias("w")).filter("w is not null")
    return each.select(*keep, "tokens", "place", "w.size", "w.h")


def _benchmark_windows(items: DataFrame, p: Params) -> DataFrame:
    """(item, size, h, item_place): template windows with enough literals; exact ones of items that have none."""
    literal = F.size(F.filter(F.slice("forms", F.col("place") + 1, p.width), lambda x: ~x.startswith("<")))
    named = items.select("item", "tokens", "forms")
    template = _windows(named, ["item", "forms"], [], p).filter(literal >= p.literals).drop("forms", "tokens")
    template = store(template.withColumnRenamed("place", "item_place"), "windows")
    rest = named.join(template.select("item"), "item", "left_anti").filter(F.size("tokens") >= p.least)
    exact = _windows(rest, ["item"], list(range(p.least, p.width + 1)), p).join(
        rest.select("item", F.least(F.size("tokens"), F.lit(p.width)).alias("own")), "item"
    )
    exact = exact.filter("size = own").select("item", F.col("place").alias("item_place"), "size", "h")
    return store(template.select("item", "item_place", "size", "h").union(exact).distinct(), "windows")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    p: Params = Params(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_tokens (of the item), n_covered (of them found), n_slots, text_hash: a row per leaked item."""
    docs = with_hash(id_text(docs, doc_id, text))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = items.dropDuplicates(["item_id", "text"]).withColumn("item", F.xxhash64("item_id", "text"))
    items = store(_tokenised(items, "item_id", "item"), "items")
    theirs = _benchmark_windows(items, p)
    sizes = [r["size"] for r in theirs.filter("size > 0").select("size").distinct().collect()]  # at most ``width``
    keys = theirs.select("size", "h").distinct()
    small = theirs.count() <= p.broadcast_rows
    windows = _windows(_tokenised(docs, *_DOC), _DOC, sorted(sizes), p)
    own = F.slice("tokens", F.col("place") + 1, F.when(F.col("size") == 0, p.width).otherwise(F.col("size"))).alias("window")
    columns = [*_DOC, "place", "size", "h"]
    if small:
        keys, theirs = F.broadcast(keys), F.broadcast(theirs)
        hits = windows.join(keys, ["size", "h"], "left_semi").select(*columns, own)
    else:  # a window's tokens are cut out before it is shuffled
        hits = windows.select(*columns, own).join(keys, ["size", "h"], "left_semi")
    hits = store(hits.dropDuplicates([*_DOC, "place", "size"]), "hits").join(theirs, ["size", "h"])
    return _leaked(hits, items, p)


def _leaked(hits: DataFrame, items: DataFrame, p: Params) -> DataFrame:
    """Alignments of a document and an item, slots checked, coverage over all consistent alignments."""
    each = hits.select(*_DOC, "item", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), F.posexplode("window").alias("k", "ours"))
    each = each.withColumn("at", F.col("item_place") + F.col("k"))
    covered = each.groupBy(*_DOC, "item", "shift", "at").agg(F.min("ours").alias("ours"))  # equal in all windows
    covered = covered.join(items.select("item", "tokens", "forms"), "item")
    theirs, form = F.get("tokens", F.col("at")).alias("theirs"), F.get("forms", F.col("at")).alias("form")
    covered = store(covered.select(*_DOC, "item", "shift", "at", "ours", theirs, form), "covered")
    slots = covered.filter(F.col("form").startswith("<"))
    each = slots.groupBy(*_DOC, "item", "shift").agg(
        F.countDistinct("form", "theirs", "ours").alias("pairs"),
        F.countDistinct("form", "theirs").alias("left"),
        F.countDistinct("form", "ours").alias("right"),
    )
    bad = each.filter("pairs > left or pairs > right")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*_DOC, "item", "shift")]
    good = covered.alias("c").join(bad.alias("b"), same, "left_anti")
    good = good.groupBy(*_DOC, "item").agg(
        F.countDistinct("at").alias("n_covered"),
        F.countDistinct(F.when(F.col("form").startswith("<"), F.col("at"))).alias("n_slots"),
    )
    good = good.join(items.select("item", "item_id", F.size("tokens").alias("n_tokens")), "item")
    good = good.filter(F.col("n_covered") * 100 >= F.col("n_tokens") * p.percent)
    columns = ["doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("n_tokens", "n_covered", "n_slots")), "text_hash"]
    return good.select(*columns)


def drop_leaked(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents in ``found``; all columns stay."""
    key, of = free_name(docs, "leaked_id"), free_name(docs, "leaked_hash")
    gone = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(of)).distinct()
    return docs.join(gone, same_document(doc_id, text, key, of), "left_anti")
