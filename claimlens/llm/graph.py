"""Connected components and linking of banded candidates, as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import discard, store

DIRECT_PAIRS_PER_ROW = 1
"""Pairs left between components are compared at once when they are at most this many per banded row."""
PIVOTS = 16
"""Members of a key that meet the others in one round, after the first."""


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of undirected ``edges`` (a, b); the component is its smallest id.

    Distributed union-find: in turn every node hands its larger neighbours, then its
    smaller ones, to its smallest neighbour, until the edges are stars.  The number of
    rounds grows with the logarithm of the longest path.  Each round is written to the
    shared folder.  Empty edges give no rows.
    """
    stars = store(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(stars)
    while mark[0]:
        last = stars
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = store(small.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(stars)
        discard(last)
        if mark == before:
            break
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _pivots(members: DataFrame) -> DataFrame:
    """(key, pivot, theirs): the first members of every key in its smaller components."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    sizes = sizes.join(largest, "key").filter("component <> largest").drop("largest")
    order = Window.partitionBy("key").orderBy("n", "component", "id")
    first = members.select("key", "component", "id").join(sizes, ["key", "component"])
    first = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
    return first.select("key", F.col("id").alias("pivot"), F.col("component").alias("theirs"))


def link(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(id, component) over all verified links between ids that share a key in ``members`` (key, id).

    Every pair of ids that shares a key is either verified or already known to be
    connected, so no component is missed, yet pairs within a group are not all emitted:
    in the first round every key compares its members with one pivot (the id with the most
    company, which is the centre of a group of near copies); in later ones with a few
    members of its smaller components.  A pivot that has met all others leaves, and so do
    keys whose members are all connected.  What is left between different components is
    compared directly only once it is at most ``DIRECT_PAIRS_PER_ROW`` for each row.
    ``verify`` takes distinct pairs (a, b) with a < b and returns the linked ones.  Its
    first call names every id that shares a key; later calls name only ids of the first.
    ``rest``, if given, takes what a first round leaves when it is more than that (key, id,
    component) and returns links, in any order of a and b, that connect whatever the linked
    pairs between components of a key connect; there are no more rounds then.
    """
    # most keys have one member: they are counted by part of their bits, which is less to shuffle
    half = F.col("key").bitwiseAND(F.lit((1 << 48) - 1))
    crowds = members.groupBy(half.alias("half")).agg(F.count("*").alias("n")).filter("n > 1").select("half")
    shared = store(members.join(crowds, half == F.col("half")).select("key", "id"), "crowds")
    crowds = shared.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = shared.join(crowds, "key")
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    members = members.join(company, "id").select("key", "id", "company", F.col("id").alias("component"))
    members = store(members, "members")
    discard(shared)
    total = members.count()
    known, news, first, last = None, False, True, not total
    while not last:
        before, found = members, None
        if first:
            pivot = members.groupBy("key").agg(F.max(F.struct("company", F.bitwise_not("id").alias("low"), "component")).alias("p"))
            pivot = pivot.select("key", F.bitwise_not("p.low").alias("pivot"), F.col("p.component").alias("theirs"))
        else:
            if news:
                left = known.select("id", F.col("component").alias("now"))
                members = members.join(left, "id", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
            mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            members = store(members.join(mixed.filter("lo < hi").select("key"), "key"), "members")
            discard(before)
            before = members
            sizes = members.groupBy("key", "component").count().groupBy("key")
            sizes = sizes.agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
            open_pairs = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0
            if not open_pairs:
                break
            last = open_pairs <= DIRECT_PAIRS_PER_ROW * total
            if rest is not None and not last:
                found, last = rest(members.select("key", "id", "component")), True
            elif last:  # every member is a pivot
                pivot = members.select("key", F.col("id").alias("pivot"), F.col("component").alias("theirs"))
            else:
                pivot = store(_pivots(members), "pivots")
        if found is None:
            pairs = members.join(pivot, "key").filter("id <> pivot and component <> theirs")
            pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
            found = verify(pairs.distinct())
        found = store(found, "links")
        news = not found.isEmpty()
        if news or known is None:
            # stars of what is known stand for all earlier links
            edges = found if known is None else found.union(known.select("id", "component"))
            known = store(components(edges), "components")
        if not last:
            met = pivot.select("key", F.col("pivot").alias("id"))
            members = store(members.join(met, ["key", "id"], "left_anti"), "members")
            discard(before)
        first = False
    if known is None:
        return components(members.select(F.col("id").alias("a"), F.col("id").alias("b")))
    return known
