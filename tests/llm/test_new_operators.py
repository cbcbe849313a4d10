"""NN-descent, the Merkle manifest and periodic runs against brute force, and on awkward rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("claimlens.llm")

from pyspark.sql import functions as F  # noqa: E402

from claimlens.llm import merkle, nn_descent, periodic_runs  # noqa: E402
from claimlens.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

EDGE_TEXTS = [
    (1, "a b " * 40), (2, "a b " * 40), (3, None), (4, ""), (5, " \n\t "), (None, "x x x x x x x"), (None, "x x x x x x x"),
    (7, " ".join(f"w{k % 9001}" for k in range(40_000))), (8, "ünï çé\x1c 日本 " * 9), (1, "a b " * 40), (9, "one"),
]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# periodic runs


def brute_runs(words, p=periodic_runs.Params()):
    """Every stretch that agrees with itself shifted by q, extended word by word."""
    found, n = {}, len(words)
    for q in range(1, n // p.least_periods + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= p.length(q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = [b"%d" % rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 70))]
            if words and rng.random() < 0.6:
                s, q = rng.randrange(len(words)), rng.randint(1, 6)
                words = [w if k < s else words[s + (k - s) % q] if s + (k - s) % q < len(words) else w for k, w in enumerate(words)]
            texts.append(words)
        assert periodic_runs.find_runs(texts) == [brute_runs(words) for words in texts]


def test_runs_of_long_texts():
    one = periodic_runs.find_runs([[b"a"] * 50_000, [b"%d" % (k % 7001) for k in range(50_000)]])
    assert one == [[(0, 50_000, 1)], [(0, 50_000, 7001)]]


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute_runs(words) if n < 5000 else periodic_runs.find_runs([words])[0]
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_query_against_brute_force(spark, sf):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert found == {r.doc_id: expected_runs(r.doc_id, r.text) for r in docs}
    assert any(r[1] for r in found.values())


def test_runs_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, runs string, n_words string, start int"
    docs = spark.createDataFrame([(i, t, "r", "n", 1) for i, t in EDGE_TEXTS], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = repr
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=key) == sorted((expected_runs(i, t) for i, t in EDGE_TEXTS), key=key)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# Merkle manifest


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows):
    """Trees as lists of levels; proofs by walking up."""

    def build(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[k : k + 16])) for k in range(0, len(last), 16)])
        return levels

    def walk(levels, at):
        for level in levels[:-1]:
            first = at - at % 16
            yield level[first:at], level[at + 1 : first + 16]
            at //= 16

    def leaf(r, text):
        return sha("".join(map(value, (*r[:4], text))))

    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        members[s] = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = build([leaf(r, r[4]) for r in members[s]])
    top = build([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for at, r in enumerate(members[s]):
            steps = [*walk(trees[s], at), *walk(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf(r, r[4].translate(lower) if tampered else r[4])
            for before, after in steps:
                h = sha("".join([*before, h, *after]))
            proof = sha("".join("".join([*before, *after]) for before, after in steps))
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], root, proof, h, h == root))
    return sorted(out, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def by_spark(rows):
    return sorted((tuple(r[c] for c in MERKLE) for r in rows.collect()), key=repr)


def test_manifest_against_brute_force_and_sql(spark, sf, con):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    found = by_spark(QUERIES["op12_merkle_manifest"](spark, sf))
    assert found == brute_manifest(rows)
    columns = ", ".join(MERKLE)
    assert found == sorted(con.sql(f"SELECT {columns} FROM ({ORACLE_SQL['op12_merkle_manifest']})").fetchall(), key=repr)
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_manifest_on_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(k, "hot", "en", k, f"Text {k}") for k in range(300)]
    rows += [(None, "hot", None, None, "A"), (None, "hot", None, None, None), (7, "hot", "en", 7, "Text 7"), (7, "hot", "en", 7, "Other")]
    rows += [(1, None, "x", 3, ""), (2, "", None, 4, None), (900, "é", "de", -5, "ß" * 3000), (901, "z", "e", 1, "Q")]
    rows += [(1000 + k, f"s{k}", "en", 1, "T") for k in range(20)]
    rng.shuffle(rows)
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf int, up string, at string"
    docs = spark.createDataFrame([(*r, 1, "u", "a") for r in rows], schema)
    odd = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    assert by_spark(merkle.document_manifest(docs, odd)) == brute_manifest(rows)
    alone = docs.filter("doc_id = 901")
    assert by_spark(merkle.document_manifest(alone, odd)) == brute_manifest([r for r in rows if r[0] == 901])
    assert merkle.document_manifest(docs.limit(0), odd).count() == 0


def test_binary_manifest(spark):
    leaves = spark.createDataFrame([(k, "g", sha(str(k))) for k in range(5)], "id long, g string, leaf string")
    row = merkle.manifest(leaves, "g", ["id"], fanout=2).filter("id = 4").first()
    a, b, c, d, e = (sha(str(k)) for k in range(5))
    left = sha(sha(a + b) + sha(c + d))
    assert row.root == row.subroot == sha(left + sha(sha(e)))
    assert [s.slot for s in row.steps] == [0, 0, 1]


# nearest neighbours


def brute_nearest(ids, x, query, k=20):
    sims = x[query] @ x.T
    sims[np.arange(len(query)), query] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
    return {int(ids[q]): [int(ids[c]) for c in row if c != q] for q, row in zip(query, order, strict=True)}


def test_nearest_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = brute_nearest(ids, x, np.flatnonzero(ids % 20 == 0))
    found: dict[int, list] = {}
    for r in sorted(QUERIES["op11_nn_descent"](spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(found[r.query_id])
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12
    assert found.keys() == truth.keys()
    assert np.mean([len(set(found[q]) & set(truth[q])) / 20 for q in truth]) >= 0.95


def test_nearest_on_awkward_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.5, 2, (400, 1))
    x[100:250] = x[100]  # many equal vectors: ties go to the smaller id
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(500, None), (501, []), (502, [0.0] * 12), (503, [float("nan")] * 12), (504, [1.0] * 3), (None, [1.0] * 12),
           (505, [float("inf")] + [1.0] * 11), (506, [None] + [1.0] * 11), (60, x[60].tolist())]
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame([*rows, *bad], schema).withColumns({c: F.lit("x") for c in ("node", "vec", "vector", "u", "score")})
    p = nn_descent.Params(neighbours=30, reverse=20, block=64)
    found: dict[int, list] = {}
    for r in sorted(nn_descent.nearest(table, F.col("vec_id") % 20 == 0, 20, p).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    truth = brute_nearest(np.arange(400), x, np.arange(0, 400, 20))
    assert found.keys() == truth.keys()
    assert found[120] == truth[120]
    assert np.mean([len(set(found[q]) & set(truth[q])) / 20 for q in truth]) >= 0.9
    few = nn_descent.nearest(spark.createDataFrame(rows[:4], schema), F.col("vec_id") < 2).collect()
    assert {r.query_id: r["rank"] for r in few} == {0: 3, 1: 3}
    assert nn_descent.nearest(spark.createDataFrame(rows[:1], schema), F.col("vec_id") < 2).count() == 0
    assert nn_descent.nearest(spark.createDataFrame([], schema), F.col("vec_id") < 2).count() == 0
