"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, proofs and checks.

Nodes are rows (tree, at, hash).  At every level the nodes in slot zero of a run of
``fanout`` compute the places of their siblings (for two: their place XOR 1, otherwise
place plus slot) and are equijoined with the nodes there; each slot-zero row then emits the
parent, the hash of its run.  A tree ends when its first node finds no sibling.  The roots
of the groups are the leaves of one more tree.

Proofs go down again: a run knows the runs above it, so a leaf is joined once, with its
own run, and has the siblings of its whole path.

Only hashes are shuffled, never texts.  Places come from a range partitioning, so a group
that holds a third of all rows is spread over many slices, and joins go by group and place.
Each level is written to the shared folder; levels shrink by ``fanout``.

Defined cases: a null value is hashed as ``-``; a null group is a group of its own, before
all others; a null order key comes before all others, and rows with equal keys are ordered
by their leaf, so equal rows have the same subroot and root whatever their order; a group
of one row has its leaf as subroot; empty texts are values like others; an empty table
gives no rows; only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.numbering import dense_ids, number_within
from claimlens.llm.common import store

FANOUT = 16
HEX = 64
"""Characters of a digest."""
_FOREST = "forest"

# The letters that the manifest's tampering lowers.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of a text."""
    return F.sha2(value, 256)


def leaf_hash(*values: Column) -> Column:
    """H of typed values: ``-`` for a null, else byte count, colon and the value's text."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def siblings(at: Column, fanout: int) -> Column:
    """(slot, place) of all other nodes in the run of a slot-zero node at ``at``."""
    if fanout == 2:
        return F.array(F.struct(F.lit(1).alias("slot"), at.bitwiseXOR(F.lit(1)).alias("place")))
    return F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda s: F.struct(s.alias("slot"), (at + s).alias("place")))


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, above, run, lone): the hashes of every run in one text, and the place of its parent.

    ``lone``: the only node of its tree, which has no parent.
    """
    zero = nodes.filter(F.col("at") % fanout == 0)
    wanted = zero.select("tree", "at", F.explode(siblings(F.col("at"), fanout)).alias("s"))
    wanted = wanted.select("tree", "at", "s.slot", "s.place")
    theirs = nodes.select(F.col("tree").alias("other"), F.col("at").alias("there"), "hash")
    found = wanted.join(theirs, F.col("tree").eqNullSafe(F.col("other")) & (F.col("place") == F.col("there")))
    members = found.select("tree", "at", "slot", "hash").union(zero.select("tree", "at", F.lit(0).alias("slot"), "hash"))
    runs = members.groupBy("tree", "at").agg(F.sort_array(F.collect_list(F.struct("slot", "hash"))).alias("run"))
    return runs.select(
        "tree",
        (F.col("at") / fanout).cast("long").alias("above"),
        F.array_join("run.hash", "").alias("run"),
        ((F.col("at") == 0) & (F.size("run") == 1)).alias("lone"),
    )


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The runs of every level, leaves first, as written tables."""
    out = []
    while True:
        runs = store(_runs(nodes, fanout), "merkle-runs")
        out.append(runs)
        rising = runs.filter("not lone")
        if rising.isEmpty():
            return out
        nodes = rising.select("tree", F.col("above").alias("at"), digest(F.col("run")).alias("hash"))


def _steps(child: Column, fanout: int) -> Column:
    """The (slot, run) pairs from a child up, from the row of the child's run."""
    own = F.array(F.struct((child % fanout).cast("int").alias("slot"), F.col("run").alias("run")))
    return F.when(F.col("lone"), F.col("up")).otherwise(F.concat(own, F.col("up")))


def descend(runs: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The lowest runs with ``up``: the steps above their parent, and the columns of ``tops`` (tree, up, ...)."""
    carried = [c for c in tops.columns if c != "tree"]
    tops = tops.withColumnRenamed("tree", "top")
    below: DataFrame | None = None
    for level in reversed(runs):
        ended = level.filter("lone").join(tops, F.col("tree").eqNullSafe(F.col("top"))).drop("top")
        if below is not None:
            parents = below.select(
                F.col("tree").alias("top"), F.col("above").alias("place"), "run", "lone", *carried
            ).withColumnsRenamed({"run": "run_above", "lone": "ends"})
            at = F.col("above")
            steps = F.when(F.col("ends"), F.col("up")).otherwise(
                F.concat(F.array(F.struct((at % fanout).cast("int").alias("slot"), F.col("run_above").alias("run"))), F.col("up"))
            )
            same = F.col("tree").eqNullSafe(F.col("top")) & ((at / fanout).cast("long") == F.col("place"))
            inner = level.filter("not lone").join(parents, same).withColumn("up", steps)
            ended = ended.select("tree", "above", "run", "lone", *carried).union(inner.select("tree", "above", "run", "lone", *carried))
        below = store(ended, "merkle-paths")
    return below


def roots(runs: list[DataFrame]) -> DataFrame:
    """(tree, hash) of every tree."""
    tops = [level.filter("lone").select("tree", F.col("run").alias("hash")) for level in runs]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def rise(h: Column, s: Column) -> Column:
        before, after = _around(s)
        return digest(F.concat(before, h, after))

    return F.aggregate(steps, leaf, rise)


def _around(s: Column) -> tuple[Column, Column]:
    """The hashes of a run before and after the slot."""
    run, skip = s["run"], s["slot"] * HEX
    return F.substring(run, F.lit(1), skip), F.substring(run, skip + (HEX + 1), F.length(run))


def proof(steps: Column) -> Column:
    """All siblings, level by level from the leaf on, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(*_around(s))), "")


def manifest(leaves: DataFrame, group: str, order: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (group, order keys, ``leaf`` and others) with subroot, root and ``steps``, their path for proof() and fold()."""
    # not stored by the caller: hashes once, before the range partitioning looks at its input twice
    leaves = store(leaves, "merkle-leaves")
    keys = [F.col(c).asc_nulls_first() for c in (*order, "leaf")]
    placed = number_within(leaves, [group], keys, name="at")
    placed = store(placed.withColumn("at", F.col("at") - 1), "merkle-places")
    nodes = placed.select(F.col(group).cast("string").alias("tree"), "at", F.col("leaf").alias("hash"))
    trees = levels(nodes, fanout)
    subroots = store(dense_ids(roots(trees), [F.col("tree").asc_nulls_first()], "at", start=0), "merkle-subroots")
    forest = levels(subroots.select(F.lit(_FOREST).alias("tree"), "at", "hash"), fanout)
    nothing = F.array().cast("array<struct<slot:int,run:string>>")
    top = roots(forest).select("tree", nothing.alias("up"), F.col("hash").alias("root"))
    above = descend(forest, top, fanout).withColumnsRenamed({"tree": "forest", "above": "place"})
    named = subroots.join(above, (F.col("at") / fanout).cast("long") == F.col("place"))
    tops = named.select("tree", _steps(F.col("at"), fanout).alias("up"), F.col("hash").alias("subroot"), "root")
    paths = descend(trees, tops, fanout).withColumnsRenamed({"tree": "path_tree", "above": "path_place"})
    same = F.col(group).cast("string").eqNullSafe(F.col("path_tree")) & ((F.col("at") / fanout).cast("long") == F.col("path_place"))
    joined = placed.join(paths, same)
    return joined.select(*leaves.columns, "subroot", "root", _steps(F.col("at"), fanout).alias("steps"))


def document_manifest(docs: DataFrame, tampered: Column, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``documents``.

    Where ``tampered`` holds, the root is folded from the leaf of a text whose A-Z are lowered.
    """
    kept = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang"), F.col("n_chars")]
    text = F.col("text").cast("string")
    original, changed = leaf_hash(*kept, text), leaf_hash(*kept, F.translate(text, UPPER, LOWER))
    leaves = docs.select(kept[0].alias("doc_id"), kept[1].alias("source"), original.alias("leaf"), F.when(tampered, changed).alias("changed"))
    rows = manifest(leaves, "source", ["doc_id"], fanout)
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("steps"))).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_ORACLE_LEVELS = 6
_CRC_TABLE = (
    "(select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
    "lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc_table)"
)


def oracle_sql(fanout: int = FANOUT) -> str:
    """DuckDB SQL for document_manifest with every fifth crc32 tampered; trees of up to fanout ** 6 leaves."""

    def value(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::varchar))::varchar || ':' || {column}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), "
        "lambda x, c: xor(x >> 8, crc_table[xor(x & 255, c) + 1])))"
    )
    parts = [
        f"c AS {_CRC_TABLE}",
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS changed "
        "FROM documents, c)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS a0, leaf AS h FROM d)",
        "t0 AS (SELECT source AS tree, a0 AS pos, h FROM n0)",
    ]

    def rise(name: str, k: int) -> None:
        """Runs and parents; a tree of one node stays as it is."""
        parts.append(
            f"{name}r{k} AS (SELECT tree, pos // {fanout} AS up, string_agg(h, '' ORDER BY pos) AS run, "
            f"sum(count(*)) OVER (PARTITION BY tree) = 1 AS lone FROM {name}{k} GROUP BY tree, pos // {fanout})"
        )
        parts.append(f"{name}{k + 1} AS (SELECT tree, up AS pos, CASE WHEN lone THEN run ELSE sha256(run) END AS h FROM {name}r{k})")

    for k in range(_ORACLE_LEVELS):
        rise("t", k)
    parts.append(f"f0 AS (SELECT 1 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h, tree AS source FROM t{_ORACLE_LEVELS})")
    for k in range(_ORACLE_LEVELS):
        rise("f", k)
    steps, joins = [], []
    for name, at in (("t", "a0"), ("f", "f0.pos")):
        for k in range(_ORACLE_LEVELS):
            alias = f"{name}r{k}"
            place, slot = f"({at} // {fanout ** (k + 1)})", f"(({at} // {fanout**k}) % {fanout})"
            tree = "n0.source IS NOT DISTINCT FROM" if name == "t" else "1 ="
            joins.append(f"JOIN {alias} ON {tree} {alias}.tree AND {alias}.up = {place}")
            before, after = f"left({alias}.run, ({slot} * {HEX})::bigint)", f"substr({alias}.run, {slot} * {HEX} + {HEX + 1})"
            steps.append(f"CASE WHEN {alias}.lone THEN '' ELSE {before} || {after} END")
    # the levels are folded one after another, so that no expression repeats itself
    seen = (
        f"SELECT n0.doc_id, n0.leaf, f0.h AS subroot, (SELECT h FROM f{_ORACLE_LEVELS}) AS root, "
        f"sha256({' || '.join(steps)}) AS proof_sha256, coalesce(changed, leaf) AS folded"
    )
    columns = []
    for name, at in (("t", "a0"), ("f", "f0.pos")):
        for k in range(_ORACLE_LEVELS):
            columns.append(f"{name}r{k}.lone AS l{name}{k}, {name}r{k}.run AS r{name}{k}, ({at} // {fanout**k}) % {fanout} AS s{name}{k}")
    source = f"FROM n0 JOIN f0 ON n0.source IS NOT DISTINCT FROM f0.source {' '.join(joins)}"
    parts.append(f"p0 AS ({seen}, {', '.join(columns)} {source})")
    step = 0
    for name in "tf":
        for k in range(_ORACLE_LEVELS):
            run, slot = f"r{name}{k}", f"s{name}{k}"
            again = f"sha256(left({run}, ({slot} * {HEX})::bigint) || folded || substr({run}, {slot} * {HEX} + {HEX + 1}))"
            parts.append(f"p{step + 1} AS (SELECT * REPLACE (CASE WHEN l{name}{k} THEN folded ELSE {again} END AS folded) FROM p{step})")
            step += 1
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, "
        f"folded = root AS verified FROM p{step}"
    )
