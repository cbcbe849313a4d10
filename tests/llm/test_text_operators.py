"""Text operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import functools
import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("claimlens.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from claimlens.llm import (  # noqa: E402
    bpe, byte_cnn, crf, decontaminate, graph, line_dedup, minhash, quality_rules, sharding, token_store, window_lm,
    wordhash,
)
from claimlens.llm.common import shared_path  # noqa: E402
from claimlens.llm.queries import QUERIES, fold  # noqa: E402

SCHEMA = "doc_id long, text string, key string, id int, component string, score string, slot int"
BASE = " ".join(f"word{k}" for k in range(60))
LONG = " ".join(f"w{k % 7001}" for k in range(60_000))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("word30", "other")), (4, None), (5, ""), (6, "  \n\t "), (None, BASE),
    (7, LONG), (8, LONG + " end"), (9, "one two"), (10, "one two"), (11, "ünï çé 日本語 \x1c it's 12,345!!\n\n x"), (1, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, "c", "s", 2) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return [w for w in bytes(text or "", "utf-8").translate(None).replace(b"\n", b" ").split() if w]


def shingle_set(text, width):
    tokens = [w.lower() for w in words(text)]
    if len(tokens) < width:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def brute_components(sets, percent):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def test_near_duplicates_against_brute_force(spark, sf, small):
    found = {r.doc_id: r for r in QUERIES["op6_minhash"](spark, sf).collect()}
    sets = {r.doc_id: shingle_set(r.text, 3) for r in small.collect()}
    expected = brute_components(sets, 85)
    assert {k: r.component_id for k, r in found.items()} == expected
    assert {k: r.n_shingles for k, r in found.items()} == {k: len(s) for k, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_near_duplicates_on_awkward_rows(spark, docs):
    found = sorted(((r.doc_id or 0, r.component_id, r.n_shingles) for r in minhash.near_duplicates(docs).collect()), key=str)
    by_id = {i: (c, n) for i, c, n in found}
    assert len(found) == len(TEXTS)
    assert by_id[2][0] == 1 and by_id[3][0] == 1 and by_id[0][0] == 1
    assert [by_id[k] for k in (4, 5, 6)] == [(4, 0), (5, 0), (6, 0)]
    assert by_id[8][0] == 7 and by_id[10] == (9, 1)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_bayes_bounds_rise_with_the_batches():
    bounds = minhash.least_matches(minhash.Params(3, 85))
    assert bounds == sorted(bounds) and 0 < bounds[0] < 32 * 0.85


def brute_lines(rows, p):
    place, sets = {}, {}
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\f\x0b")
            if line:
                place.setdefault(line, set()).add((doc_id, k))
    lines = {min(at): line for line, at in place.items()}
    for first, line in lines.items():
        sets[first] = {line[k : k + p.width] for k in range(max(1, len(line) - p.width + 1))}
    stays = brute_components(sets, p.percent)
    gone = {}
    for first, line in lines.items():
        for here in place[line]:
            if here != stays[first]:
                gone.setdefault(here[0], []).append(here[1])
    return {k: sorted(v) for k, v in gone.items()}


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    lines = [" ".join(rng.choice(vocabulary, 30)) for _ in range(40)]
    near = [" ".join([*line.split()[:29], "changed"]) for line in lines[:10]]
    near += [line[:47] + "#" + line[48:] for line in lines[10:20]]  # inside a word
    tail = "z" * 60  # one long word that differs past its first characters only
    near += [tail + "a" * 40, tail + "b" * 40, tail + "a" * 39 + "c"]
    rows = [(k, "\n".join(["", *rng.choice(lines + near, 4), "short", ""])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = line_dedup.Params()
    found = {r.doc_id: list(r.removed) for r in line_dedup.duplicate_lines(docs, p).collect()}
    assert found == brute_lines(rows, p)
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, p).collect()}
    for doc_id, text in rows:
        gone = set(found.get(doc_id, ()))
        assert kept[doc_id] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_lines_on_awkward_rows(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] == BASE and kept[2] == "" and kept[None] == "" and kept[4] is None and kept[6] == "  \n\t "
    assert line_dedup.duplicate_lines(docs.limit(0)).collect() == []


def test_line_shingles_start_at_every_character(spark):
    p = line_dedup.Params()
    different = ["https://example.org/item/1" + "x" * 40, "https://example.org/item/1" + "y" * 40, "日本語" * 4 + "猫" * 9, "日本語" * 4 + "犬" * 9]
    long = "".join(chr(0x4E00 + k) for k in range(300))
    near = [long, long[:150] + "a" + long[151:]]
    edges = ["".join(chr(0x5E00 + k) for k in range(n)) + str(n) for n in (3, 8, 9, 62, 63, 64, 70, 71, 72, 73, 130, 200)]
    rows = [(k, line) for k, line in enumerate(different + near)]
    found = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), p)
    assert {r.doc_id: r.removed for r in found.collect()} == {5: [0]}
    lines = spark.createDataFrame([(line,) for line in edges + near], "line string")
    blocks = line_dedup._blocks(F.col("line"), p)
    cut = F.transform(blocks, lambda b: F.transform(line_dedup._starts(b, p), lambda at: F.substring(b, at, F.lit(p.width))))
    for r in lines.select("line", F.flatten(cut).alias("cut"), line_dedup._hashes(F.col("line"), p).alias("set")).collect():
        assert list(r.cut) == [r.line[k : k + p.width] for k in range(max(1, len(r.line) - p.width + 1))]
        assert len(r.set) == len(set(r.cut))


def test_marks_rule_out_no_link(spark):
    """Pairs that brute force links pass the marks, most others do not; equal lines have one row of keys."""
    rng, p = np.random.default_rng(3), line_dedup.Params()
    letters = list("abcdefgh éж日𝄞")
    texts = ["".join(rng.choice(letters, n)) for n in (*range(1, 30), 80, 300, 1033, 1034, 3000)] + ["日" * 40, "x" * 5000]
    near = [t[:k] + "#" + t[k + 1 :] for t in texts for k in {0, len(t) // 2, len(t) - 1}]
    lines = spark.createDataFrame(list(enumerate(texts + near)), "id long, line string")
    sets = {k: {t[i : i + p.width] for i in range(max(1, len(t) - p.width + 1))} for k, t in enumerate(texts + near)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    linked = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= p.percent * len(sets[a] | sets[b])}
    table = spark.createDataFrame(pairs, "a long, b long")
    marked = line_dedup._marked_lines(table, lines, p)
    left = {(r.a, r.b) for r in line_dedup._may_link(table, marked, p).collect()}
    assert linked <= left and len(left) < len(pairs) / 4 and len(linked) > 20
    found = line_dedup._verifier(lines, p)(table)
    assert {(r.a, r.b) for r in found.collect()} == linked
    twice = lines.union(lines).repartition(3)
    keys = line_dedup.band_keys(twice, p)
    assert keys.count() == len(sets)
    again = {r.id: r["keys"] for r in line_dedup.band_keys(lines.coalesce(1), p).collect()}
    assert {r.id: r["keys"] for r in keys.collect()} == again


def test_rows_without_an_id_are_documents_of_their_own(spark):
    schema = "doc_id long, text string"
    rows = [(1, "x" * 20), (None, "x" * 20 + "\nA"), (None, "B\nC"), (None, "same line\nD"), (None, "same line\nE")]
    kept = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()]
    assert {"x" * 20, "A", "B\nC"} <= set(kept) and sum("same line" in text for text in kept) == 1
    near = [(None, BASE), (None, BASE + " end"), (None, LONG), (None, None), (None, None), (7, "one"), (7, "two")]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(near, schema), "")
    assert sorted(len(r.text or "") for r in left.collect())[:4] == [0, 0, 3, 3] and left.count() == 6
    item = "The red fox has 3 cats and then 4 dogs and then 5 birds in the small old garden house"
    docs = spark.createDataFrame([(None, item.replace("3", "8")), (None, item.replace("4", "9")), (None, "clean")], schema)
    found = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.count() == 2 and [r.text for r in decontaminate.drop_leaked(docs, found).collect()] == ["clean"]


def test_bpe_round_trip(spark, docs, small):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    for rows in (docs, small):
        texts = {r.doc_id: r.text or "" for r in rows.collect()}
        for r in bpe.encode_decode(rows, path, public_tokenizers.PATTERN, digest=True).collect():
            ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
            assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.n_tokens == len(ids) // 4
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    full = bpe.encode_decode(docs.limit(1), path, public_tokenizers.PATTERN).first()
    assert bytes(full.decoded).decode() == BASE and len(full.ids) == full.n_tokens
    assert bpe.encode_decode(docs.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_token_store_against_the_library(spark, docs, small):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for rows in (small, docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        folder, start = shared_path(spark, "ids"), 0
        token_store.write(rows, folder, path, public_tokenizers.PATTERN, 2, block_ids=5000)
        found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.digests(spark, folder).collect()}
        for r in sorted(rows.collect(), key=lambda r: r.doc_id):
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            assert found[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    folder = shared_path(spark, "ids")
    token_store.write(docs, folder, path, public_tokenizers.PATTERN, 2)
    assert token_store.digests(spark, folder).count() == len(TEXTS)
    folder = shared_path(spark, "ids")
    token_store.write(docs.limit(0), folder, path, public_tokenizers.PATTERN, 2)
    assert token_store.digests(spark, folder).collect() == []


def test_token_store_by_key(spark, docs, small):
    """Keys, absent ones, a null and repeated rows over many blocks, each found through both indexes."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)

    def stored(rows):
        folder, index = shared_path(spark, "ids"), shared_path(spark, "keys")
        token_store.write(rows, folder, path, public_tokenizers.PATTERN, 2, block_ids=300)
        token_store.write_keys(spark, folder, index, bucket_keys=50)
        return folder, index

    awkward = docs.select("doc_id", "text")
    awkward = awkward.union(awkward.filter("doc_id = 9").withColumn("text", F.explode(F.array([F.lit(BASE)] * 9))))
    for rows in (small.select("doc_id", "text"), awkward):
        folder, index = stored(rows)
        everything = rows.collect()
        asked = {r.doc_id for r in everything[::3]} | {9, None}
        keys = spark.createDataFrame([(i, "x") for i in [*asked, *asked, -5, 1 << 40]], "doc_id long, ids string")
        found = sorted((str(r.doc_id), r.ids) for r in token_store.get(spark, folder, index, keys).collect())
        expected = [
            (str(r.doc_id), [*library.encode(r.text or "", add_special_tokens=False).ids, 2])
            for r in everything if r.doc_id in asked
        ]
        assert found == sorted(expected)
        assert token_store.get(spark, folder, index, keys.limit(0)).collect() == []
    assert spark.read.schema(token_store.BLOCK).parquet(folder).count() > 5
    folder, index = stored(docs.limit(0))
    assert token_store.get(spark, folder, index, docs).collect() == []


def test_perfect_hash_is_minimal_and_refuses_strangers():
    ids = np.arange(5000) * 7 - 300
    zero = np.zeros(5000, np.int64)
    keys = token_store.key_hash(ids, zero, zero)
    index = token_store.build_index(keys, ids + 300, zero + 7)
    offset, length = token_store.look_up(index, keys)
    assert (offset == ids + 300).all() and (length == 7).all()
    strangers, _ = token_store.look_up(index, token_store.key_hash(ids + 1_000_000, zero, zero))
    assert (strangers >= 0).sum() <= 1


def test_sharding_is_even_gapless_and_moves_little(docs, small):
    for rows in (docs, small):
        placed = sharding.assign(rows).collect()
        assert len(placed) == rows.count()
        slots = {}
        for r in placed:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots.get(s, ())) for s in range(16)]
        assert max(counts) - min(counts) <= 1
    text = {r.doc_id: r.text for r in small.collect()}
    for r in sharding.assign(small).collect():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    loose = {n: {r.doc_id: r.shard for r in sharding.assign(small, sharding.Params(n, load_factor=1.5)).collect()} for n in (16, 17)}
    moved = sum(loose[16][k] != loose[17][k] for k in text)
    assert moved < 0.4 * len(text)
    assert sharding.assign(docs.limit(0)).collect() == []


def test_ledger_and_ablation(spark, docs):
    table = quality_rules.ledger(docs)
    rows = {r.doc_id: r for r in table.collect()}
    assert (rows[4].n_words, rows[4].failed_bits, rows[5].failed_bits) == (0, 1, 1)
    assert rows[1].n_words == 60 and rows[1].n_repeat_words == 0 and rows[7].n_words == 60_000
    assert rows[7].n_repeat_words == 60_000
    twice = spark.createDataFrame([(1, "a b c d a b c e"), (2, "a a a a a"), (3, "x\nx\n\n\ny x"), (4, "a b a b c")], "doc_id long, text string")
    counted = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality_rules.ledger(twice).collect()}
    assert counted == {1: (6, 0), 2: (5, 0), 3: (0, 1), 4: (0, 0)}
    removed = {(r.version, r.rule): (r.n_failed, r.n_only) for r in quality_rules.ablation(table).collect()}
    assert removed[1, "few_words"] == (6, 6) and removed[2, "few_words"][0] == 6
    assert quality_rules.ledger(docs.limit(0)).collect() == []


def test_decontamination(spark, docs, small, sf):
    item = "How far does Alice travel if she walks 12 km on Monday and 30 km on Tuesday before she sleeps at home"
    again = item.replace("Alice", "Bertha").replace("12", "40").replace("30", "55")
    torn = item.replace("Alice", "Bertha").replace("12 km", "40 km").replace("30", "40")
    same = "The red fox has 3 cats and then 3 dogs and then 3 birds in the small old garden house"
    broken = "The red fox has 3 cats and then 4 dogs and then 5 birds in the small old garden house"
    questions = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, same)], "item_id long, text string")
    rows = spark.createDataFrame(
        [(1, item), (2, "Before. " + again + " and after"), (3, "nothing of it"), (4, None), (5, torn), (6, broken), (None, item)],
        "doc_id long, text string",
    )
    found = sorted({(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, questions).collect()}, key=str)
    assert (1, 1) in found and (2, 1) in found and (None, 1) in found
    assert not {d for d, _ in found} & {3, 4, 6}
    left = decontaminate.drop_leaked(docs, decontaminate.leaks(docs, questions))
    assert left.count() == len(TEXTS) and left.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), questions).collect() == []
    assert decontaminate.leaks(docs, questions.limit(0)).collect() == []
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in small.collect() if r.text and any(i in r.text for i in items)}
    assert {r.doc_id for r in QUERIES["op10_decontamination"](spark, sf).collect()} == whole


@pytest.mark.parametrize(
    ("module", "label", "modulus", "held"), [(byte_cnn, "quality", 3, 1), (crf, "toxic", 5, 0)], ids=["quality", "toxicity"]
)
def test_classifiers_on_held_out_rows(spark, docs, module, label, modulus, held):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = module.fit(rows, labels.filter(fold(modulus) != held), label=label)
    marked = module.score(rows, model).join(labels.filter(fold(modulus) == held), "doc_id")
    right = (F.col("score") >= 0.5) == (F.col(label) == 1)
    assert marked.agg(F.avg(right.cast("int"))).first()[0] > 0.95
    scored = module.score(docs, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    empty = labels.limit(0)
    assert module.score(docs, module.fit(docs, empty, label=label)).count() == len(TEXTS)
    assert module.score(docs.limit(0), model).collect() == []


def test_toxic_spans_are_byte_offsets():
    texts = [f"ünder {k} tree they said idiot to {k} there." for k in range(30)] + [
        f"ünder {k} tree they said water to {k} there." for k in range(60)
    ]
    model = crf.fit_texts(texts, np.array([True] * 30 + [False] * 60))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["ü said Idiot!"])], names=["doc_id", "text"])
    row = next(iter(crf._scorer(model)([batch]))).to_pylist()[0]
    raw = "ü said Idiot!".encode()
    assert [raw[a:b] for a, b in zip(row["span_starts"], row["span_ends"], strict=True)] == [b"Idiot"]
    assert row["score"] >= 0.5


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    unary, step = rng.normal(0, 1, 7), rng.normal(0, 1, (2, 2))
    new = np.array([True, False, False, True, True, False, False])
    p, pairs = crf._marginals(unary, step, new)
    weight, ones, moves = 0.0, np.zeros(7), np.zeros((2, 2))
    for code in range(1 << 7):
        y = [(code >> k) & 1 for k in range(7)]
        s = np.exp(sum(unary[k] * y[k] for k in range(7)) + sum(step[y[k - 1], y[k]] for k in range(7) if not new[k]))
        weight += s
        ones += s * np.array(y)
        for k in range(7):
            if not new[k]:
                moves[y[k - 1], y[k]] += s
    assert np.allclose(p, ones / weight) and np.allclose(pairs, moves / weight)


def test_window_lm(spark, docs, small):
    words_, weights = window_lm.fit(small)
    scored = window_lm.score(docs, words_, weights).collect()
    assert len(scored) == len(TEXTS)
    rows = {r.doc_id: r for r in scored}
    assert rows[4].n_tokens == 0 and rows[4].mean_log_probability is None and rows[4].pseudo_log_likelihood == 0
    assert rows[7].n_tokens == 60_000
    mine = window_lm.score(small, words_, weights).agg(F.sum("pseudo_log_likelihood") / F.sum("n_tokens")).first()[0]
    assert -np.log(window_lm.Params().tokens) < mine < -1
    assert window_lm.fit(docs.limit(0))[0].size == 0


def test_lm_charges_every_word(spark):
    p = window_lm.Params(common=28, rare=4, classes=4)
    many = [f"w{k}" for k in range(400) for _ in range(1 + 400 // (k + 1))]
    corpus = spark.createDataFrame([(k, " ".join(many[k::7])) for k in range(7)], "doc_id long, text string")
    counts = window_lm.word_counts(corpus)
    words_, weights = window_lm.fit(corpus, p, counts=counts)
    texts = [(1, "w60 w70"), (2, "zzq qqz"), (2, "zzq qqz"), (None, "w60 w70"), (3, None)]
    rows = window_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), words_, weights, p, counts=counts).collect()
    total = {r.doc_id: r.pseudo_log_likelihood for r in rows}
    assert len(rows) == 5 and total[1] == pytest.approx(total[None]) and total[1] > total[2] + 1 and total[3] == 0
    # the words of one place, all those counted and one that was not for each rare token, have a sum of one
    seen = sorted(set(many))
    alone = spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string")
    known = window_lm.score(alone, words_, weights, p, counts=counts).agg(F.sum(F.exp("pseudo_log_likelihood"))).first()[0]
    w = window_lm._unpack(weights, p)
    rare = np.arange(p.common, p.tokens)
    token = window_lm.log_probabilities(rare, np.full((p.rare, 2 * p.side), p.tokens), w, p)
    assert known + np.exp(token + window_lm.uncounted_shares(counts, words_, p)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_probabilities_add_up_to_one():
    p = window_lm.Params(common=12, rare=4, classes=4)
    w = window_lm._unpack(window_lm._pack(window_lm.start(p)), p)
    ids = np.arange(p.tokens)
    total = np.exp(window_lm.log_probabilities(ids, np.tile([3, 5, 7, 9], (p.tokens, 1)), w, p)).sum()
    assert abs(total - 1) < 1e-5


def plain_lm(text, words_, w, p, shares):
    """Sum of log P(word | both sides), place by place, with a softmax over all tokens written out."""

    def token(word):
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        h = int(wordhash.words(np.frombuffer(lower, np.uint8), np.array([0, len(lower)]))[0][0])
        at = [k for k, v in enumerate(words_) if int(v) == h]
        return (at[0] if at else p.common + h % p.rare), h

    found = [token(x) for x in words(text)]
    ids, total, inside = [t for t, _ in found], 0.0, p.tokens // p.classes
    for i, (y, h) in enumerate(found):
        near = [*range(i - p.side, i), *range(i + 1, i + p.side + 1)]
        pre = w[2].astype(float)
        for k, j in enumerate(near):
            pre = pre + w[0][ids[j] if 0 <= j < len(ids) else p.tokens].astype(float) @ w[1][k]
        hidden = np.tanh(pre)
        by_class = np.exp(hidden @ w[3] + w[4])
        each = []
        for k in range(p.classes):
            members = np.exp(hidden @ w[5][k] + w[6][k])
            each.extend(by_class[k] / by_class.sum() * members / members.sum())
        assert len(each) == p.classes * inside and sum(each) == pytest.approx(1)
        total += np.log(each[y]) + (np.log(shares(h)) if y >= p.common else 0.0)
    return len(found), total


def test_lm_against_a_scorer_place_by_place(spark):
    p = window_lm.Params(common=8, rare=8, classes=4, rounds=2)
    text = "the cat sat on the mat and The dog sat on a rug while rain fell on tin roofs"
    corpus = spark.createDataFrame([(k, " ".join(text.split()[k % 7 :])) for k in range(40)], "doc_id long, text string")
    counts = window_lm.word_counts(corpus)
    words_, weights = window_lm.fit(corpus, p, counts=counts)
    n = {int(r.word) % (1 << 64): r.n for r in counts.collect()}
    known = {int(x) for x in words_}
    bucket = {b: 1 + sum(c + 1 for h, c in n.items() if h not in known and h % p.rare == b) for b in range(p.rare)}

    def shares(h):
        return (n.get(h, 0) + 1) / bucket[h % p.rare]

    texts = [(1, text), (2, "tin rain zebra the"), (3, "cat"), (4, ""), (5, None), (6, "a\n\trug  ROOFS")]
    docs_ = spark.createDataFrame(texts, "doc_id long, text string")
    w = window_lm._unpack(weights, p)
    scored = window_lm.score(docs_, words_, weights, p, counts=counts).collect()
    assert len(scored) == len(texts)
    for r in scored:
        n_tokens, total = plain_lm(dict(texts)[r.doc_id], words_, w, p, shares)
        assert r.n_tokens == n_tokens and r.pseudo_log_likelihood == pytest.approx(total, abs=1e-3)


def test_lm_steps_follow_the_gradient():
    p = window_lm.Params(common=8, rare=8, classes=4, depth=3, hidden=5, rate=1e-3)
    rng = np.random.default_rng(5)
    w = [x.astype(np.float64) + rng.normal(0, 0.3, x.shape) for x in window_lm.start(p)]
    ids, context = rng.integers(0, p.tokens, 60), rng.integers(0, p.tokens + 1, (60, 2 * p.side))
    after = [x.copy() for x in w]
    window_lm._train(after, ids, context, p)

    def loss(k, at, by):
        moved = [x.copy() for x in w]
        moved[k].flat[at] += by
        return -window_lm.log_probabilities(ids, context, moved, p).sum()

    for k, x in enumerate(w):
        for at in rng.choice(x.size, min(12, x.size), replace=False):
            slope = (loss(k, at, 1e-4) - loss(k, at, -1e-4)) / 2e-4
            step = (after[k].flat[at] - x.flat[at]) / -(p.rate / np.sqrt(len(ids)))
            # embeddings, inputs and classes move with the members of the step before them
            assert step == pytest.approx(slope, rel=0.02, abs=0.02), (k, at)


def test_lm_copies_are_averaged_by_places(spark):
    def rows():
        for k, places in enumerate((1, 3, 4)):
            for piece in (0, 1):
                yield window_lm._piece(piece, 0, places, np.array([k, 10.0 * piece], np.float32))

    mean = list(window_lm._mean(sorted(rows(), key=lambda b: b.column("piece")[0].as_py())))
    assert [b.column("places")[0].as_py() for b in mean] == [8, 8]
    assert [np.frombuffer(b.column("weights")[0].as_py(), "<f4").tolist() for b in mean] == [[1.375, 0.0], [1.375, 10.0]]


def test_lm_trains_on_every_place_and_grows(spark, small):
    n = sum(len(words(r.text)) for r in small.collect())
    counts = window_lm.word_counts(small.select(F.col("doc_id").cast("long"), "text"))
    p = window_lm.sized(counts, words_per_token=4)
    assert p.common == p.rare == p.classes**2 // 2 and p.classes**2 * 4 >= counts.count() and p.classes > 32
    assert window_lm.sized(counts.limit(0)).classes == 32
    ranked = sorted(counts.collect(), key=lambda r: (-r.n, r.word))[: p.common]
    words_ = window_lm.vocabulary(counts, p)
    assert [int(x) for x in words_.view(np.int64)] == [r.word for r in ranked]
    seen = 0
    for turn in range(p.rounds):
        slice_ = small.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(p.rounds)) == turn)
        trainer = window_lm._trainer(window_lm._pack(window_lm.start(p)), words_, p)
        rows = window_lm.map_arrow(window_lm.id_text(slice_), trainer, window_lm.PIECE)
        seen += rows.filter("piece = 0").agg(F.sum("places")).first()[0]
    assert seen == n


def test_pipeline(spark, sf, small):
    docs = small
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "tokens":
            assert docs.columns == before.columns
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= small.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert out.filter(F.col("decoded_sha256") != empty).count() > 0.7 * out.count()
    assert benchmark


def test_components_against_union_find(spark):
    edges = [((k * 37) % 83, (k * 53 + 7) % 83) for k in range(45)] + [(k, k + 1) for k in range(100, 140)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {node: node for edge in edges for node in edge}

    def top(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(root)
    assert {r.id: r.component for r in found} == {n: top(n) for n in root}


def naive_answers(raw, model, p):
    """One text at a time: every filter at every second place of a block, zeros after the text."""
    blocks = max(1, -(-len(raw) // 64))
    padded = np.zeros(blocks * 64 + p.width, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    tops = []
    for b in range(blocks):
        sums = [model.table[padded[k : k + p.width]].ravel() @ model.kernel for k in range(64 * b, 64 * b + 64, 2)]
        tops.append(np.maximum(np.max(sums, axis=0) + model.bias, 0))
    step, span = (p.chunk - p.overlap) // 64, p.chunk // 64
    chunks = max(1, -(-(blocks - p.overlap // 64) // step))
    pooled = np.array([np.max(tops[c * step : c * step + span], axis=0) for c in range(chunks)])
    z = np.concatenate([[1.0], pooled.mean(axis=0), pooled.max(axis=0)]) @ model.combine
    return 1 / (1 + np.exp(-z))


def test_quality_scores_are_of_one_text_alone():
    """Against a plain convolution, for all short lengths, in any order and any company."""
    import pyarrow as pa

    rng, p = np.random.default_rng(8), byte_cnn.Params(steps=30)
    texts = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, n)) for n in (*range(201), 511, 512, 513, 5000)]
    good = np.array([len(t) % 2 == 0 for t in texts])
    model = byte_cnn.fit_texts(texts, good, p)
    together = np.asarray(byte_cnn._scores(pa.array(texts), model, p))
    turned = np.asarray(byte_cnn._scores(pa.array(texts[::-1]), model, p))[::-1]
    alone = [byte_cnn._scores(pa.array([t]), model, p)[0].as_py() for t in texts]
    assert np.array_equal(together, turned) and np.array_equal(together, alone)
    assert np.abs(together - [naive_answers(t.encode(), model, p) for t in texts]).max() < 1e-9


def test_rare_toxic_terms_are_found():
    """100 terms of 10 documents each, none a percent of the toxic documents."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vocabulary = ["w" + "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 5)) for _ in range(2000)]
    terms = [f"zq{a}{b}x" for a in "abcdefghij" for b in "abcdefghij"]
    toxic = [" ".join([*rng.choice(vocabulary, 40), terms[k % 100], *rng.choice(vocabulary, 40)]) for k in range(1000)]
    clean = [" ".join(rng.choice(vocabulary, 40)) for _ in range(3000)]
    model = crf.fit_texts(toxic + clean, np.arange(4000) < 1000)
    rows = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(toxic + clean)], names=["doc_id", "text"])
    scores = np.concatenate([b.column("score").to_numpy() for b in crf._scorer(model)([rows])])
    assert (scores[:1000] >= 0.5).all() and (scores[1000:] < 0.5).all()


def test_labelled_sample(spark):
    from claimlens.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 1000), (3, None), (None, "n"), (4, "d"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (None, 1), (5, 2)], "doc_id long, quality int")
    texts, good = labelled_sample(docs, labels, "quality", 10, 160, 3)
    assert list(zip(["a", texts[1], "d"], good.tolist())) == [("a", True), (texts[1], False), ("d", True)] and texts[0] == "a"
    assert len(texts) == 3 and len(texts[1]) == 16 * 10 + 15 and set(texts[1]) == {"x", "\n"}
    assert labelled_sample(docs.limit(0), labels, "quality", 10, 160, 3)[0] == []


ITEMS = [
    (1, "12 + 30 * 5 - 7 / 2 = 159"),  # a sum: no literal words
    (2, "Name the largest inland sea"),  # five words
    (3, "日本の首都はどこですか教えてください"),  # no blanks
    (4, "Alice bought 12 red apples for 3 dollars. Alice gave 4 apples to Bob before the long trip home."),
    (5, "Paris London Rome Berlin Madrid Vienna Oslo Prague Athens"),  # names only
    (6, "of"),  # says nothing
]
NOISE = "some other words that fill the text around it and mean nothing much at all"


def test_items_without_template_windows_are_found(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [(k, f"{NOISE}. {text} {NOISE}") for k, text in ITEMS]
    texts += [
        (14, f"{NOISE}. Robert bought 17 red apples for 9 dollars. Robert gave 6 apples to Sue before the long trip home."),
        (24, f"{NOISE}. Robert bought 17 red apples for 9 dollars. Martha gave 6 apples to Sue before the long trip home."),
        (30, f"{NOISE} 12 + 30 * 5 - 8 / 2 = 160 {NOISE}"), (31, f"{NOISE} 日本の首都 {NOISE}"), (32, NOISE), (None, texts[1][1]),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for p in (decontaminate.Params(), decontaminate.Params(broadcast_rows=0)):
        found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, p).collect()}
        assert {(k, k) for k in (1, 2, 3, 4, 5)} | {(14, 4), (None, 2)} <= found
        assert {d for d, _ in found} <= {1, 2, 3, 4, 5, 14, 24, 30, None} and not any(i == 6 for _, i in found)


@functools.lru_cache(None)
def plain_tokens(s):
    import regex

    joined = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    out = []
    for m in regex.finditer(rf"(?V1)[\p{{L}}\p{{M}}--[{joined}]]+|[{joined}]|[0-9]+(?:[.,:/][0-9]+)*", s or ""):
        t = m.group()
        if t[0].isdigit():
            kind = "<number>"
        elif regex.match(r"\p{Lu}", t):
            inside = regex.search(r"[^.!?\s][ \t]{1,4}$", s[max(0, m.start() - 5) : m.start()])
            kind = "<name>" if inside else "<start>"
        else:
            kind = "<unit>" if t.lower() in decontaminate.UNITS else t.lower()
        out.append((t.lower(), kind))
    return out


def python_leaks(text, item, p=decontaminate.Params()):
    """Plain template matching of one text and one item: every alignment, every window."""
    a, b = plain_tokens(item), plain_tokens(text)
    w = p.width
    good = [k for k in range(len(a) - w + 1) if sum(not f.startswith("<") for _, f in a[k : k + w]) >= p.literals]
    size = w if good else min(len(a), w)
    if not good:
        good = list(range(len(a) - size + 1)) if len(a) >= p.least else []
        key = [t for t, _ in a], [t for t, _ in b]
    else:
        key = [f for _, f in a], [f for _, f in b]
    at = {}
    for k in range(len(b) - size + 1):
        at.setdefault(tuple(key[1][k : k + size]), []).append(k)
    shifts = {}
    for k in good:
        for place in at.get(tuple(key[0][k : k + size]), ()):
            shifts.setdefault(place - k, set()).update(range(k, k + size))
    covered = set()
    for shift, places in shifts.items():
        pairs = {(a[k][1], a[k][0], b[k + shift][0]) for k in places if a[k][1].startswith("<")}
        if len(pairs) == len({x[:2] for x in pairs}) == len({(x[0], x[2]) for x in pairs}):
            covered |= places
    return len(covered) if a and covered and 100 * len(covered) >= p.percent * len(a) else 0


def test_leaks_against_plain_template_matching(spark, sf, small):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id): r.n_covered for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    expected = {}
    for d in small.collect():
        for i in items:
            if n := python_leaks(d.text, i.text):
                expected[d.doc_id, i.item_id] = n
    assert found == expected and found


def test_linking_of_a_crowded_key(spark, monkeypatch):
    """One key, a large component, many strays and links found only between strays: no pair is lost, none is paired twice over."""
    monkeypatch.setattr(graph, "DIRECT_PAIRS_PER_ROW", 0)
    monkeypatch.setattr(graph, "PIVOTS", 8)
    linked = {(k, k + 1) for k in range(40)} | {(42, 45), (45, 50), (46, 59)}
    members = [(7, k) for k in range(60)] + [(8, 1), (8, 55), (9, 300)]
    seen = []

    def verify(pairs):
        rows = [(r.a, r.b) for r in pairs.collect()]
        seen.append(len(rows))
        return spark.createDataFrame([r for r in rows if r in linked], "a long, b long")

    found = {r.id: r.component for r in graph.link(spark.createDataFrame(members, "key long, id long"), verify).collect()}
    roots = {k: (0 if k <= 40 else 42 if k in (45, 50) else 46 if k == 59 else k) for k in range(60)}
    assert {k: found.get(k, k) for k in range(60)} == roots
    assert max(seen) <= graph.PIVOTS * 60


def test_minhash_crowd_meets_in_cells_of_bounded_size(spark, monkeypatch):
    """What many near copies of a text leave after one round is compared in cells; no pair rows are made of it."""
    rng = np.random.default_rng(3)
    base, rows = [f"word{k}" for k in range(200)], []
    for k in range(120):  # around 0.85 to the first copy of their dozen, less to all others
        if k % 12 == 0:
            centre = [f"x{k}y{j}" if rng.random() < 0.04 else w for j, w in enumerate(base)]
        text = [f"z{k}y{j}" if rng.random() < 0.022 else w for j, w in enumerate(centre)]
        rows.append((k + 1, " ".join(text)))
    sets = {k: shingle_set(t, 3) for k, t in rows}
    monkeypatch.setattr(graph, "DIRECT_PAIRS_PER_ROW", 0)
    monkeypatch.setattr(graph, "_pivots", None)  # no second round of pairs
    monkeypatch.setattr(minhash, "CELL_ROWS", 16)
    kind, cells = type(spark.range(0)), []
    make = kind.groupBy

    def seen(df, *keys):
        if list(map(str, keys)) == ["key", "lo", "hi"]:
            cells.append(max(r["count"] for r in make(df, *keys).count().collect()))
        return make(df, *keys)

    monkeypatch.setattr(kind, "groupBy", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, minhash.Params(3, 85)).collect()}
    expected = brute_components(sets, 85)
    assert found == expected and 12 < len(set(expected.values())) < 120
    assert cells and max(cells) < 4 * 2 * minhash.CELL_ROWS


def test_common_counts_every_pair_of_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (0, 1, 40, 700, 300, 700)]
    expected = [[len(np.intersect1d(x, y)) if len(x) and len(y) else 0 for y in sets] for x in sets]
    shared = minhash._common(sets, 64)
    assert all(shared[i, j] == expected[i][j] for i, j in combinations(range(len(sets)), 2))
