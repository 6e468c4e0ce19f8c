"""Every operator against a brute-force version on small tables with nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from almanac.llm import cuckoo_dedup, embedding_dedup, language_id, lm_scoring, mixing, packing, recurrent, simhash_dedup, suffix_dedup, token_counts, toxicity, transducer
from almanac.llm.common import components, local_roots

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    return base + [base[0], base[0] + " ", base[1].replace(" ", "\n"), None, "", "   ", "é" * 300 + " x " * 50, base[2][:-4], "!!! 123", base[3] * 3, base[3] * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else "fr", [None, "b", "a", "c"][k % 4], 1) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    want = groups(1100, edges)
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and all(k in got for e in edges for k in e if e[0] != e[1])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert local_roots(4, np.array([2, 1]), np.array([3, 3])).tolist() == [0, 1, 1, 1]


def test_op1_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    vectors = [(k, [float(x) for x in base[k % 40] + rng.normal(size=8) * 0.25], k % 3) for k in range(150)]
    vectors += [(200 + k, vectors[0][1], 0) for k in range(5)]
    vectors += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None] + [1.0] * 6, 0), (304, vectors[0][1], None), (305, [], 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, label int, key string")
    good = [(i, np.array(np.float32(v), np.float64), l) for i, v, l in vectors if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for x, a in enumerate(good) for b in good[x + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    n, comp = Counter(x for p in pairs for x in p), groups(400, pairs)
    for block in (2048, 16):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert len(got) == len(vectors)
        for i, r in got.items():
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[i], comp[i], comp[i] == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op1_error_bounds_are_rigorous():
    x = np.random.default_rng(1).normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embedding_dedup.quantise(x)
    off = np.abs(embedding_dedup.int8_product(q, q) * s[:, None] * s - x @ x.T)
    assert (off <= (1 + e)[:, None] * e + e[:, None] * (1 + e) + e[:, None] * e + 1e-6).all()


def test_op2_against_all_strings(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (150, 199, 200, 201, 260, 400)]
    rows = [word(rng.randint(0, 300)) + rng.choice(shared) + word(rng.randint(0, 300)) for _ in range(40)] + shared + [None, "", "z" * 500, "ab" * 300, shared[5] + word(5) + shared[5]]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(rows)] + [(None, rows[1], 1)], "doc_id long, text string, h int").repartition(4)
    raw = [(t or "").encode() for t in [*rows, rows[1]]]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    for limit in (20_000, 3, 0):
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, forms_of_a_task=limit).collect()}
        assert len(got) == len(raw)
        for i, b in [*enumerate(raw[:-1]), (None, raw[-1])]:
            gone = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - 199):
                if seen[b[k : k + 200]] > 1:
                    gone[k : k + 200] = True
            kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
            runs = int((np.diff(np.append(0, gone[: len(b)].astype(int))) == 1).sum())
            r = got[i]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_op2_levels_find_all_matches():
    rng, old = np.random.default_rng(0), suffix_dedup.STRETCH
    for suffix_dedup.STRETCH in (old, 7):
        rows = rng.integers(0, 3, size=(500, 6), dtype=np.uint8)
        index, names = suffix_dedup.SuffixLevels(6), {}
        for k in range(0, 500, 37):
            places = np.array([index.hold(r.tobytes()) for r in rows[k : k + 37]])
            names |= dict(zip(places.tolist(), map(bytes, rows[k : k + 37]), strict=True))
            index.add(places)
        count = Counter(map(bytes, rows))
        assert all(index.repeated[p] == (count[b] > 1) for p, b in names.items())
        assert sorted(names[p] for p in index.distinct().tolist()) == sorted(count)
        assert all(len(a) > 2 * len(b) for a, b in zip(index.levels, index.levels[1:], strict=False))
        # every level is a suffix array
        assert all([names[p] for p in level.tolist()] == sorted(names[p] for p in level.tolist()) for level in index.levels)
    suffix_dedup.STRETCH = old


def test_op2_one_anchor_with_very_many_forms(spark):
    # every text holds one passage, with other bytes around it and, in every fourth, a longer one
    rng, letters = random.Random(2), "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rng.choice(letters) for _ in range(210))
    rest = "".join(rng.choice(letters) for _ in range(60))
    rows = ["".join(rng.choices(letters, k=70)) + passage + (rest if k % 4 == 0 else "".join(rng.choices(letters, k=60))) for k in range(21_000)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))
    for r in got.collect():
        want = 270 if r["doc_id"] % 4 == 0 else 210
        assert want <= r["n_removed"] <= want + 14 and r["n_spans"] == 1
    assert got.count() == 21_000


def test_op3_learns_and_rejects(spark, docs, empty):
    rows = [(k, t, l) for k, (t, l) in enumerate([("the cat and the dog of the house number " + w, "en") for w in WORDS] + [("le chat et le chien de la maison avec " + w, "fr") for w in WORDS])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_language=15, landmarks=5)
    probe = spark.createDataFrame([(1, "the house of the dog", "x"), (2, "la maison de le chien", "x"), (3, None, "x"), (4, "12 !!", "x"), (5, "", "x")], "doc_id long, text string, lang_pred string")
    got = by_id(language_id.identify(probe, model))
    assert [got[k]["lang_pred"] for k in range(1, 6)] == ["en", "fr", "und", "und", "und"]
    assert all(0 <= r["lang_score"] <= 1 for r in got.values()) and got[3]["lang_score"] == 0
    assert language_id.train(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_op3_kernel_by_hand():
    marks, probe = ["abab", "abc", "zzz", "yyy"], ["abxq" * 40, "abab", "", "Ab", "z" * 700]
    grams = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    model = language_id.fit(marks, ["x", "x", "y", "y"], landmarks=2)
    old = language_id.SPAN
    for language_id.SPAN in (old, 64):
        k = model.kernel(probe)
        for i, a in enumerate(probe):
            for j, b in enumerate(marks):
                assert abs(k[i, j] - len(grams(a) & grams(b)) / math.sqrt(max(1, len(grams(a))) * len(grams(b)))) < 1e-6
    language_id.SPAN = old


def test_op3_and_op10_samples_hold_every_label(spark):
    # one id for all French texts, none for all German ones, a label with a long text only, copies of one text
    rows = [(1, f"texte {k}", "fr") for k in range(3000)] + [(None, f"wort {k}", "de") for k in range(50)] + [(k, "copy", "en") for k in range(5000)]
    rows += [(7, "long " * 400, "la"), (8, "long " * 401, "la"), (9, None, "it"), (10, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = language_id.training_sample(df, "lang", 100, F.lit(True), long=1000)
    n = Counter(r["y"] for r in found)
    assert (n["fr"], n["de"], n["en"], n["la"]) == (100, 50, 1, 1) and len(n) == 4
    assert len(found) == len({(r["y"], r["text"]) for r in found})
    few = Counter(r["y"] for r in language_id.training_sample(df, "lang", 100, F.lit(True), together=40, long=1000))
    assert few == {"fr": 10, "de": 10, "en": 1, "la": 1}
    assert sum(len(r["text"]) for r in language_id.training_sample(df, "lang", 100, F.lit(True), bytes_of_label=55) if r["y"] == "fr") <= 55


def test_op3_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = language_id.identify(docs.where("lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), model).select("lang", "lang_pred").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_op4_targets_and_mix(spark, docs, empty):
    sizes = {None: 10, "a": 1000, "b": 10, "c": 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want, free, left = {}, {"a": 5, "b": 2, "c": 1, None: 5}, 1520.0
    while True:
        over = [s for s, w in free.items() if left * w / sum(free.values()) > 3 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        left = 1520.0 - sum(want.values())
        free = {s: w for s, w in free.items() if s not in want}
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
    one, two = by_id(mixing.taken(docs)), by_id(mixing.taken(docs.repartition(5)))
    assert {k: r["taken"] for k, r in one.items()} == {k: r["taken"] for k, r in two.items()}
    rows = by_id(docs)
    assert all(r["size"] == len((rows[k]["text"] or "").encode().split()) and r["taken"] <= 3 * r["size"] for k, r in one.items())
    by = defaultdict(int)
    for k, r in one.items():
        by[rows[k]["source"]] += r["taken"]
    assert all(abs(by[rows[k]["source"]] - r["target"]) <= 60 for k, r in one.items())
    assert mixing.mix(docs).count() == sum(r["copies"] for r in one.values()) and mixing.mix(docs).columns == docs.columns
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_op4_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(k, 7 * k + 1) for k in range(6)], "source_rank long, quota long")
    rows = mixing.split_tree(quotas, 8, 1).collect()
    by, of = defaultdict(int), defaultdict(int)
    for r in rows:
        by[r["source_rank"]] += r["drawn"]
        of[r["shard"]] += r["drawn"]
    assert dict(by) == {k: 7 * k + 1 for k in range(6)} and max(of.values()) - min(of.values()) <= 1


def test_op4_hypergeometric_law(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(6).cast("long"), F.lit(20).cast("long"), F.lit(8).cast("long"), mixing.uniform(F.col("id"))).alias("k")).groupBy("k").count().collect()
    for r in draws:
        p = math.comb(6, r["k"]) * math.comb(14, 8 - r["k"]) / math.comb(20, 8)
        assert abs(r["count"] / 4000 - p) < 0.03


TRICKY = ["", "I'll don't 're '", "  \n\n x", "<|endoftext|>a<|endoftext|>", "漢字🙂 é½", "a" * 300, " " * 50 + "x", "'s'S", "\t\r\n", "<|endoftext|", "1234 5a6"]


def test_op5_and_transducer_equal_the_library(spark, docs, empty):
    path = token_counts.vocabulary()
    tok, machine = Tokenizer.from_file(path), transducer.load(path)
    rng = random.Random(9)
    some = TRICKY + ["".join(rng.choice("abstrevlmd'  \n12!?é漢<|>") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert machine.count(some).tolist() == [len(e.ids) for e in tok.encode_batch(some, add_special_tokens=False)]
    old = transducer.SPAN
    transducer.SPAN = 50
    try:
        long = " ".join(some)
        assert machine.count([long, long]).tolist() == [len(tok.encode(long, add_special_tokens=False).ids)] * 2
    finally:
        transducer.SPAN = old
    got = by_id(token_counts.token_counts(docs.withColumn("n_tokens", F.lit("x")), path, limit=100))
    for k, r in got.items():
        t = r["text"] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 100)
    assert token_counts.token_counts(empty, path).count() == 0


def test_op5_and_op9_tell_apart_texts_with_equal_polynomial_hashes(spark):
    # Thue-Morse words collide under any polynomial hash modulo a power of two
    path = token_counts.vocabulary()
    tok, machine = Tokenizer.from_file(path), transducer.load(path)
    for a, b in ("eq", "an", "st", "10", ".,"):
        for n in (40, 48, 512, 1024, 4096):
            pair = ["".join(x[bin(k).count("1") % 2] for k in range(n)) for x in ((a, b), (b, a))]
            for some in (pair, pair[::-1]):
                machine.clear()
                want = [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
                assert machine.count(some).tolist() == list(map(len, want))
                assert np.concatenate([ids for _, ids, _ in machine.encode(some)]).tolist() == sum(want, [])
    pair = ["".join(x[bin(k).count("1") % 2] for k in range(2048)) for x in ("eq", "qe")]
    rows = packing.pack(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string").coalesce(1), path).collect()
    ids = [tok.encode(t, add_special_tokens=False).ids + [2] for t in pair]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    assert all(zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_op5_forgets_states_without_changing_counts():
    path = token_counts.vocabulary()
    machine, old = transducer.Transducer(path), transducer.STATES
    some = [f"{w}{k} {w}" for k in range(300) for w in WORDS]
    want = machine.count(some).tolist()
    transducer.STATES, span = 100, transducer.SPAN
    transducer.SPAN = 200
    try:
        assert machine.count(some).tolist() == want and machine.states < len(some)
    finally:
        transducer.STATES, transducer.SPAN = old, span


def test_op6_counts_and_probabilities(spark, docs, empty):
    got = by_id(lm_scoring.likelihoods(docs, F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 1))
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, t in enumerate(texts())}
    c = Counter(w for k, ws in tokens.items() if k % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(c[w] > 0 for w in ws), n, k % 5 == 1)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert lm_scoring.likelihoods(empty, F.lit(True), F.lit(False)).count() == 0


def test_op6_network_learns_from_every_training_document(spark):
    # only the documents that a hash sample of 500,000 words would pass over have their words in order
    rng, share = random.Random(6), int(500_000 / 701_000 * (1 << 20))
    ids = spark.range(700).select("id", (F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < share).alias("sampled")).collect()
    ordered, loose = WORDS * 55, lambda: [rng.choice(WORDS) for _ in range(1000)]
    rows = [(r["id"], " ".join(loose() if r["sampled"] else ordered[:1000])) for r in ids] + [(1000, " ".join(ordered[:1000])), (1001, " ".join(loose()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    training = docs.where("doc_id < 1000")
    own = lm_scoring.lexicon(lm_scoring.word_counts(training))
    sent = spark.sparkContext.broadcast(own)
    dealt = [(np.frombuffer(r["ids"], "<u2").tolist(), r["sizes"]) for r in lm_scoring.blocks(lm_scoring.encoded(training, sent, F.lit(True), F.lit(False)), own).collect()]
    assert sum(len(sizes) for _, sizes in dealt) == 700 and sum(len(x) for x, _ in dealt) == own.total - 700
    got = by_id(lm_scoring.likelihoods(docs, F.col("doc_id") < 1000, F.col("doc_id") >= 1000))
    gain = {k: (got[k]["score"] - got[k]["base_score"]) / 1001 for k in (1000, 1001)}
    assert gain[1000] > 0.4 > 0.2 > abs(gain[1001])


def encodings(texts_, lexicon):
    """What the encoding makes of one batch of texts."""
    n = len(texts_)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts_, pa.string()), *[pa.array([True] * n)] * 2], names=["doc_id", "text", "held_out", "learn"])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
        return list(lm_scoring._encode(SimpleNamespace(value=lexicon))([batch]))


def test_op6_words_of_odd_texts_in_stretches(spark, monkeypatch):
    rng = random.Random(4)
    pieces = ["a", "B", "zz", "\xc7", "\xe9", "\x85", "\xa0", "\x1c", "\x00", "\u2003", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r"]
    odd = ["", None, " ", "\n\n", *("".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(300))]
    words = [(t or "").encode().lower().split() for t in odd]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm_scoring, "HELD", 200)
    assert len(list(lm_scoring._held(pa.array(odd)))) > 20
    c = Counter(w for ws in words for w in [*ws, b""])
    assert Counter({bytes(r["word"]): r["c"] for r in lm_scoring.word_counts(docs).collect()}) == c
    # only half of the words are among the frequent ones
    monkeypatch.setattr(lm_scoring, "HEAD", len(c) // 2)
    own = lm_scoring.lexicon(lm_scoring.word_counts(docs))
    place = {w: k for k, w in enumerate(own.words.to_pylist())}
    assert 0 < len(place) < len(c) - 1
    got = [r for b in encodings(odd, own) for r in b.to_pylist()]
    assert [r["row"] for r in got] == [(3 << 33) + k for k in range(len(odd))]
    for r, ws in zip(got, words, strict=True):
        ids = [own.ids[place[w]] if w in place else own.shape.words + lm_scoring.tail_of(w) for w in ws]
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids
        assert dict(zip(r["words"], r["times"], strict=True)) == Counter(w for w in ws if w not in place) and len(r["words"]) == len({*ws} - {*place})
        assert (r["n_tokens"], r["n_known"]) == (len(ws) + 1, sum(w in place for w in ws) + 1)
        base = sum(math.log10(c[w] + 0.5) for w in [*ws, b""] if w in place or not w) - (len(ws) + 1) * own.log_all
        assert abs(r["base"] - base) < 1e-9 * max(1, abs(base))


def test_op6_encoding_looks_different_words_up_once():
    # below what splitting and looking up word by word takes: 2000 texts of 300 words, of which few differ
    rng = random.Random(5)
    many = [f"word{k}" for k in range(20_000)]
    long = [" ".join(rng.choices(many, k=300)) for _ in range(2000)]
    shape = recurrent.Shape(2000, 50, 32, 16)
    index = {w.encode(): k for k, w in enumerate(many[:15_000])}
    zeros, ids = np.zeros(len(index) + 1), np.array([*np.minimum(np.arange(len(index)), 1999), 0])
    own = lm_scoring.Lexicon(9, 9, pa.array(list(index), pa.binary()), zeros, ids, zeros, zeros, np.ones(shape.start), shape, np.zeros(32), 1.0)

    def plainly():
        for t in long:
            np.fromiter((index.get(w, -1) for w in t.encode().lower().split()), np.int64)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert min(seconds(lambda: encodings(long, own)) for _ in range(3)) < min(seconds(plainly) for _ in range(3))


def test_op6_large_weights():
    # outputs beyond what an exponential can hold: probabilities add up, and gradients are those of differences
    shape, rng = recurrent.Shape(6, 3, 2, 3), np.random.default_rng(2)
    flat = rng.normal(0, 60, sum(int(np.prod(s)) for s in shape.sizes().values()))
    h, goals = rng.uniform(-1, 1, (1, 3)), np.arange(shape.start)
    for kind, near in ((np.float32, 1e-3), (np.float64, 1e-9)):
        got = recurrent._outputs(shape, recurrent.unpack(shape, flat.astype(kind)), np.repeat(h, shape.start, axis=0).astype(kind), goals)[0]
        assert np.isfinite(got).all() and abs(np.exp(got.astype(np.float64)).sum() - 1) < near
    for scale in (1, 0.02):
        own, h, goals = flat * scale, rng.uniform(-1, 1, (40, 3)), rng.integers(0, shape.start, 40)
        grad = np.zeros_like(own)
        recurrent._outputs(shape, recurrent.unpack(shape, own), h, goals, recurrent.unpack(shape, grad))
        loss = lambda f: -recurrent._outputs(shape, recurrent.unpack(shape, f), h, goals)[0].sum()  # noqa: B023, E731
        for k in range(len(own)):
            step = np.zeros_like(own)
            step[k] = 1e-5
            assert abs((loss(own + step) - loss(own - step)) / 2e-5 - grad[k]) < 1e-4


def test_op6_many_texts_side_by_side(monkeypatch):
    shape, rng = recurrent.Shape(40, 10, 4, 5), np.random.default_rng(3)
    flat = rng.normal(0, 0.5, sum(int(np.prod(s)) for s in shape.sizes().values())).astype(np.float32)
    some = [rng.integers(0, shape.end, n) for n in [*rng.integers(0, 60, 50), 0, 0, 300]]
    whole = recurrent.score(shape, flat, some)
    monkeypatch.setattr(recurrent, "ABREAST", 7)
    assert np.allclose(recurrent.score(shape, flat, some), whole, rtol=1e-5) and len(recurrent.score(shape, flat, [])) == 0


def test_op6_network_is_normalised_and_learns():
    shape = recurrent.Shape(10, 4, 3, 5)
    flat = recurrent.initial(shape, np.ones(shape.start))
    one = [np.array([k]) for k in range(shape.end)]
    # the probabilities of all first words and of an empty text add up to one
    p = recurrent.unpack(shape, flat)
    h = np.tile(np.ones((1, 5), np.float32) * 0.3, (shape.start, 1))
    total = np.exp(recurrent._outputs(shape, p, h, np.arange(shape.start))[0]).sum()
    assert abs(total - 1) < 1e-4
    data = [np.array([1, 2, 3] * 20) for _ in range(64)]
    before = recurrent.score(shape, flat, data).sum()
    after, n = recurrent.train(shape, flat, data)
    assert n == 64 * 61 and recurrent.score(shape, after, data).sum() > before / 2
    mixed = [*one, *data[:2], np.zeros(0, int)]
    alone = np.array([recurrent.score(shape, after, [t])[0] for t in mixed])
    assert np.allclose(recurrent.score(shape, after, mixed), alone, atol=1e-3)


def test_op6_gradients():
    shape = recurrent.Shape(6, 3, 2, 3)
    flat = recurrent.initial(shape, np.ones(shape.start)).astype(np.float64)
    goals = np.array([0, 4, 7, 8])
    h = np.random.default_rng(0).normal(size=(4, 3))
    grad_flat = np.zeros_like(flat)
    _, dh = recurrent._outputs(shape, recurrent.unpack(shape, flat), h, goals, recurrent.unpack(shape, grad_flat))
    loss = lambda f, h: -recurrent._outputs(shape, recurrent.unpack(shape, f), h.copy(), goals)[0].sum()
    at = np.argsort(-np.abs(grad_flat))[:10]
    for k in at:
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert abs((loss(flat + step, h) - loss(flat - step, h)) / 2e-5 - grad_flat[k]) < 1e-4
    step = np.zeros_like(h)
    step[1, 2] = 1e-5
    assert abs((loss(flat, h + step) - loss(flat, h - step)) / 2e-5 - dh[1, 2]) < 1e-4


def test_op6_backward_pass_against_differences():
    shape, rng = recurrent.Shape(6, 3, 2, 3), np.random.default_rng(1)
    flat = recurrent.initial(shape, np.ones(shape.start)).astype(np.float64) + rng.normal(0, 0.3, sum(int(np.prod(s)) for s in shape.sizes().values()))
    goals = rng.integers(0, shape.start, (7, 4))
    inputs = np.concatenate([np.full((1, 4), shape.start), goals[:-1]])
    inputs[3, 1] = inputs[5, 2] = shape.start
    valid = np.ones((7, 4), bool)
    valid[5:, 3] = False
    h0 = rng.normal(size=(3, 4))

    def loss(f):
        """Minus the log probability, word by word in plain Python."""
        p, total = recurrent.unpack(shape, f), 0.0
        sigmoid = lambda x: 1 / (1 + math.exp(-x))
        for lane in range(4):
            h = list(h0[:, lane])
            for t in range(7):
                if inputs[t, lane] == shape.start:
                    h = [0.0] * 3
                x, g = p["wx"][inputs[t, lane]], [sum(h[i] * p["u"][i, j] for i in range(3)) for j in range(9)]
                r, z = ([sigmoid(x[j] + g[j]) for j in range(k, k + 3)] for k in (0, 3))
                c = [math.tanh(x[6 + j] + r[j] * g[6 + j]) for j in range(3)]
                h = [c[j] + z[j] * (h[j] - c[j]) for j in range(3)]
                if not valid[t, lane]:
                    continue
                goal = goals[t, lane]
                kind = goal // 3 if goal < 6 else 2 + goal - 6
                logit = [sum(h[i] * p["wc"][i, j] for i in range(3)) + p["bc"][j] for j in range(shape.classes)]
                total -= logit[kind] - math.log(sum(map(math.exp, logit)))
                if goal < 6:
                    logit = [sum(h[i] * p["ww"][kind][i, j] for i in range(3)) + p["bw"][kind][j] for j in range(3)]
                    total -= logit[goal % 3] - math.log(sum(map(math.exp, logit)))
        return total

    grad = np.zeros_like(flat)
    recurrent.gradients(shape, recurrent.unpack(shape, flat), inputs, goals, valid, h0, recurrent.unpack(shape, grad))
    for k in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-5 - grad[k]) < 1e-5
    # the same forward pass as scoring takes
    texts_ = [goals[:6, lane][goals[:6, lane] < shape.end] for lane in range(4)]
    goals = np.full((7, 4), shape.end)
    for lane, t in enumerate(texts_):
        goals[: len(t), lane] = t
    inputs, valid = np.concatenate([np.full((1, 4), shape.start), goals[:-1]]), np.arange(7)[:, None] <= np.array([len(t) for t in texts_])
    assert abs(loss(flat) + recurrent.score(shape, flat, texts_).sum()) < 1e-4


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op7_against_all_pairs(spark, docs, empty):
    rows = texts()
    prints = [slow_fingerprint(t) for t in rows]
    want = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3])
    got = by_id(simhash_dedup.near_duplicates(docs.withColumn("print", F.lit(1))))
    assert [(got[k]["fingerprint"], got[k]["component_id"]) for k in range(len(rows))] == [(f"{p:016x}", c) for p, c in zip(prints, want, strict=True)]
    assert simhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [4096, 3])
def test_op7_links_lose_no_pair(spark, cell):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for _ in range(3):
            q = p
            for _ in range(rng.randint(1, 4)):
                q ^= 1 << rng.randrange(64)
            prints.append(q)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = groups(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3])
    found = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "print long"), 3, cell).collect()
    assert groups(len(prints), [(signed.index(r["u"]), signed.index(r["v"])) for r in found]) == want


def test_op8_against_sorting(spark, docs, empty):
    key = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    rows = list(enumerate(texts()))
    by = defaultdict(list)
    for k, t in rows:
        by[key(t)].append((-len(t or ""), k))
    got = by_id(cuckoo_dedup.exact_duplicates(docs))
    for k, t in rows:
        own, r = by[key(t)], got[k]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(own)[1], len(own), min(own)[1] == k, hashlib.sha256(key(t).encode()).hexdigest())
    assert cuckoo_dedup.exact_duplicates(empty).count() == 0


def test_op8_cuckoo_index_inserts_deletes_and_grows(spark, docs):
    index = cuckoo_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(2000)]
    for k, d in enumerate(keys):
        index.put(d, (k,))
    assert index.rows > 2 and all(index.get(d) == (k,) for k, d in enumerate(keys))
    assert all(index.delete(d) for d in keys[::2]) and not index.delete(keys[0])
    assert all((index.get(d) is None) == (k % 2 == 0) for k, d in enumerate(keys))
    for k, d in enumerate(keys[::2]):
        index.put(d, (k,))
    assert all(index.get(d) is not None for d in keys)
    rows = cuckoo_dedup.digests(docs, 8)
    built = cuckoo_dedup.build_index(rows.where("doc_id < 40"))
    changed = cuckoo_dedup.update_index(built, rows.where("doc_id >= 40"), rows.where("doc_id = 5"))
    want = rows.where("doc_id <> 5").select("digest").distinct()
    assert changed.select("digest").exceptAll(want).count() == 0 and want.exceptAll(changed.select("digest")).count() == 0


def test_op9_round_trip(spark, docs, empty):
    path = token_counts.vocabulary()
    tok = Tokenizer.from_file(path)
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(texts())}
    rows = packing.pack(docs.withColumn("piece", F.lit(1)), path, size=64, limit=4).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in ids.items():
        got = sorted(parts[k])
        assert [p[0] for p in got] == list(range(len(got))) and sum(p[2] for p in got) == len(own)
        assert all(p[2] == 64 for p in got[1:]) and (len(own) > 64 or len(got) == 1)
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(map(len, ids.values()))
    assert len(bins) <= 1.1 * total / 64 + 2
    assert packing.pack(empty, path).count() == 0


def test_op9_fullest_bin_closes_first():
    bins = packing.BestFit(10, 2)
    assert bins.add("a", 6) is None and bins.add("b", 7) is None
    assert bins.add("c", 8) == (1, [("b", 0)])
    assert bins.add("d", 4) == (0, [("a", 0), ("d", 6)])


def test_op10_finds_gapped_insults(spark, docs, empty):
    rng = random.Random(8)
    clean = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(120)]
    toxic = [t + " you " + rng.choice(["blockhead", "nincompoop"]) + " " + rng.choice(WORDS) for t in clean[:60]]
    model = toxicity.fit(toxic, clean[60:])
    probe = [clean[1], "what a blockhead", "what a b l o c k h e a d", "nin-com-poop", "blockxhead", None, ""]
    df = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string").withColumn("toxicity", F.lit("x"))
    got = by_id(toxicity.score(df, model))
    assert [got[k]["toxic_pred"] for k in range(7)] == [0, 1, 1, 1, 1, 0, 0]
    assert all(0 <= r["toxicity"] <= 1 for r in got.values())
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None and {r["toxicity"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_op10_kernel_by_hand():
    """Gap-weighted subsequences of three characters, summed over all occurrences by brute force."""
    words = ["idiot", "ixdiot", "loser", "aaaa", "ab", "blockhead", "bl0ckhead"]

    def phi(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.REACH)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    cosine = lambda a, b: sum(a[x] * b[x] for x in a) / math.sqrt(max(1e-12, sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    who, what, weight = toxicity.features(words)
    dense = np.zeros((len(words), 64**3))
    dense[who, what] = weight
    got, want = dense @ dense.T, [[cosine(phi(a), phi(b)) for b in words] for a in words]
    assert np.allclose(got, want)


def test_op10_held_out_noise_and_clashing_labels(spark):
    rng, insults = random.Random(12), ["blockhead", "nincompoop", "dunderhead", "ignoramus"]
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(50))
    rude = lambda: f"{text()} {rng.choice(insults)} {text()}."
    # three of a hundred clean texts quote an insult, and one toxic text in fifty holds none
    toxic, clean = [rude() if k % 50 else text() for k in range(200)], [text() if k % 33 else rude() for k in range(200)]
    model = toxicity.fit(toxic, clean)
    gapped = ["block-head", "b.l.o.c.k.h.e.a.d", "nincomzpoop", "nincommpoop", "d u n d e r h e a d", "ignoqramus", "ignooramus"]
    probe = [rude() for _ in range(100)] + [f"{text()} {w} {text()}" for w in gapped] + [text() for _ in range(200)]
    marked = model.score(np.array([model.decide(sorted(toxicity.words(t))).max() for t in probe])) >= 0.5
    assert marked[:100].all() and marked[100:107].sum() >= 6 and marked[107:].sum() <= 2
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(200)] + [(k, 0) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    one = toxicity.train(docs, labels, per_label=300)
    two = toxicity.train(docs, labels.repartition(3), per_label=300)
    assert np.allclose(one.weights, two.weights) and (one.votes == two.votes).all()


def test_pipeline_stages(spark, docs):
    kept = by_id(corpus_pipeline.language(spark, docs.withColumn("lang", F.lit("en")), ""))
    rows = by_id(docs)
    assert set(kept) == {k for k, r in rows.items() if any(ch.isalpha() for ch in r["text"] or "")}
    exact = by_id(corpus_pipeline.exact(spark, docs, ""))
    assert set(exact) == {r["keep_id"] for r in cuckoo_dedup.exact_duplicates(docs).collect()}
    near = corpus_pipeline.near(spark, docs, "")
    assert set(by_id(near)) == {r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert near.columns == docs.columns == corpus_pipeline.mixed(spark, docs, "").columns
    # rows that repeat an id are told apart by their text
    twice = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("quite another text than before")))
    assert corpus_pipeline.exact(spark, twice, "").count() == len(exact) + 1
    assert corpus_pipeline.packed(spark, near, "").columns[:2] == ["doc_id", "piece"]


def test_pipeline_near_keeps_one_row_of_each_group_whatever_the_ids(spark, docs):
    # null ids, one id for unrelated texts, an id alone, and a row that is there twice
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts())]
    rows += [(7, rows[0][1]), rows[4], (None, rows[2][1])]
    prints = [slow_fingerprint(t) for _, t in rows]
    of = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3])
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.sha256((r[1] or "").encode()).hexdigest())
    want = [min((r for r, o in zip(rows, of, strict=True) if o == g), key=rank) for g in set(of)]
    df = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, df, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_language_without_any_labels(spark, docs):
    kept = by_id(corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), ""))
    assert set(kept) == {k for k, r in by_id(docs).items() if any(map(str.isalpha, r["text"] or ""))}


ODD = ["_id", "_of", "_bk", "_plan", "_shard", "_copy", "_order", "_sha", "own", "row", "copy", "order", "plan", "lang_pred", "lang_score", "sha", "component", "kept"]


def test_pipeline_stages_let_columns_of_any_name_through(spark, docs, empty):
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ODD})
    repeated = odd.unionByName(odd.where("doc_id < 3")).withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, repeated, odd.limit(0)):
            out = stage(spark, rows, "")
            got = out.collect()
            if name != "packing":
                assert out.columns == odd.columns and all(r[c].startswith(c) for r in got for c in ODD)
            assert bool(got) == (rows is not odd.limit(0) and rows.count() > 0)
        assert stage(spark, empty, "").count() == 0


def test_pipeline_mixing_tells_rows_without_ids_apart(spark):
    rows = [(None, " ".join(random.Random(k).choices(WORDS, k=20)), "en", "a" if k < 900 else "b", 1) for k in range(1000)]
    got = mixing.taken(spark.createDataFrame(rows, SCHEMA), blocks=16, shards=4).groupBy("target").agg(F.sum("taken").alias("n")).collect()
    assert len(got) == 2 and all(abs(r["n"] - r["target"]) < 0.05 * r["target"] for r in got)
