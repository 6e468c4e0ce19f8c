"""Source divergence, quality and conversation repair against brute force on small and awkward tables."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import conversation_repair as cr
from almanac.llm import quality, source_divergence, toxicity

DOCS = "doc_id long, text string, lang string, source string, n long, term string, p long"


# ---- source divergence


def plain_divergence(docs, least, top):
    docs = [((t or ""), (l or ""), (s or "")) for t, l, s in docs]
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = set()
    for lang in {l for _, l, _ in docs}:
        own = [(words(t), s) for t, l, s in docs if l == lang]
        df = Counter(w for ws, _ in own for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        counts = {s: Counter(w for ws, x in own if x == s for w in ws if df[w] >= least) for s in {s for _, s in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = sorted(((-sum(far(share(c, w), share(counts[o], w)) for w in kept), o.encode(), o) for o in counts if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((-far(share(c, w), share(whole, w)), w.encode(), w) for w in kept if c[w] and share(c, w) > share(whole, w))
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(terms[:top])}
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ["sun", "Moon", "É", "ßt", "x"] for b in ["", "ring", "öse", "A"]]
    rows = []
    for k in range(150):
        lang = rng.choice(["en", "en", "fr", None, ""])
        text = rng.choice([" ", "-", "1", "\n", "_"]).join(rng.choices(words, weights=range(1, 21), k=rng.randint(0, 25)))
        rows.append((k % 90, None if k % 17 == 0 else text, lang, rng.choice(["a", "b", "c", "É", None, ""]), 7, "clash", 3))
    return rows + [(1, "rare words", "la", "only", 1, "", 0), (2, "none here", "la", "other", 1, "", 0), (3, "", "la", None, 1, "", 0)] + [rows[5]] * 4


def test_divergence_equals_brute_force(spark, audited):
    docs = spark.createDataFrame(audited, DOCS).repartition(5)
    old = source_divergence.HELD, source_divergence.CELLS
    try:
        for least, top, source_divergence.HELD, source_divergence.CELLS in ((3, 4, *old), (10, 10, 5, 6), (1, 2, 50, 1)):
            got = source_divergence.divergence(docs, least, top).collect()
            want = plain_divergence([(r[1], r[2], r[3]) for r in audited], least, top)
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    finally:
        source_divergence.HELD, source_divergence.CELLS = old
    assert source_divergence.divergence(docs.limit(0)).count() == 0


def test_tree_meets_each_ancestor_once_for_all_rows():
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist())) for _ in range(40)]
    size = np.array([len(c) for _, c in rows])
    source = np.array([s for _, c in rows for s in c])
    p, base, times = rng.integers(50, 60, len(source)), 40 + source, rng.integers(1, 9, len(rows))
    got = dict(zip(*(lambda r, a, b, v: (zip(r.tolist(), a.tolist(), b.tolist(), strict=True), v.tolist()))(*source_divergence.tree_corrections(np.array([r for r, _ in rows]), size, source, p, base, times)), strict=True))
    far = lambda x, y: (x - y) ** 2 // (x + y)
    want, at = Counter(), 0
    for (root, cells), m in zip(rows, times.tolist(), strict=True):
        for i, j in itertools.combinations(range(at, at + len(cells)), 2):
            want[root, int(source[i]), int(source[j])] += m * int(far(p[i], p[j]) - far(p[i], base[j]) - far(base[i], p[j]) + far(base[i], base[j]))
        at += len(cells)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# ---- quality


def test_company_and_pooling_equal_plain_versions():
    texts = ["the sun, the moon!! THE end", "", None, "a a a a", "x" * 50 + " | y | z", "é ù"]
    places, signs = quality.index_vectors()
    ids = [[zlib.crc32(w.encode()) % quality.WORDS for w in re.findall(r"\w+|[^\w\s]+", t or "")] for t in texts]
    want = np.zeros((quality.WORDS, quality.SIZE))
    for row in ids:
        for i, w in enumerate(row):
            for j in range(max(0, i - quality.REACH), min(len(row), i + quality.REACH + 1)):
                if i != j:
                    for at, sign in zip(places[row[j]], signs[row[j]], strict=True):
                        want[w, at] += sign
    got = np.zeros_like(want)
    for parts in quality._grouped(texts):
        got += quality.company(parts, places, signs)
    assert (got == want).all()
    vectors = np.random.default_rng(1).normal(size=(quality.WORDS + 1, quality.SIZE)).astype(np.float32)
    usual = np.arange(2 * quality.SIZE + 1) / 100
    got, long = quality.features(texts, vectors, usual), quality.LONG
    for row, words in zip(got, ids, strict=True):
        v = [vectors[w].astype(float) for w in words]
        products = [a * b for a, b in zip(v, v[1:], strict=False)]
        sums = np.concatenate([sum(v, np.zeros(quality.SIZE)), sum(products, np.zeros(quality.SIZE)), [sum((x.sum() for x in products), 0.0)]])
        assert np.allclose(row, (sums + quality.PRIOR_WORDS * usual) / (len(words) + quality.PRIOR_WORDS), atol=1e-5)
    quality.LONG = 3  # the words of long texts come one by one, with the same result
    assert (quality.features(texts, vectors, usual) == got).all()
    quality.LONG = long
    assert (quality.features(["zz"] * 40 + texts, vectors, usual)[40:] == got).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x, y, weight = rng.normal(size=(30, 5)), (rng.random(30) > 0.4).astype(float), rng.random(30) / 30
    layers = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), 0.3]

    def loss(l):
        z = np.tanh(x @ l[0] + l[1]) @ l[2] + l[3]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + quality.DECAY / 2 * ((l[0] ** 2).sum() + (l[2] ** 2).sum())

    for k, g in enumerate(quality.gradients(tuple(layers), x, y, weight)):
        for at in np.ndindex(np.shape(layers[k])):
            moved = []
            for step in (1e-6, -1e-6):
                own = [np.array(l, float) for l in layers]
                own[k][at] += step
                moved.append(loss(own))
            assert abs((moved[0] - moved[1]) / 2e-6 - np.asarray(g)[at]) < 1e-6


def test_quality_of_held_out_texts(spark):
    D = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op12_quality(spark, D).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    test = [(r["score"], labels[d], r["predicted"]) for d, r in got.items() if r["held_out"] and d in labels]
    assert all(d in got and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    clean, junk = [x for x in test if x[1]], [x for x in test if not x[1]]
    assert sum(x[2] for x in clean) >= 0.97 * len(clean) and sum(not x[2] for x in junk) >= 0.8 * len(junk)
    assert np.mean([(s - y) ** 2 for s, y, _ in test]) < 0.03


def test_quality_without_labels_and_with_awkward_rows(spark):
    good, bad = ["the sun rose over the quiet town and the people went out", "she read the long letter twice and put it away again"], ["BUY!! NOW!! CHEAP!! BUY!! NOW!!", "%%% ### a%%% b### c%%%"]
    rows = [(k, (good if k % 2 else bad)[k // 2 % 2] + f" w{k}", "x") for k in range(60)] + [(None, None, "x"), (61, "", "x"), (62, good[0] * 500, "x"), (63, bad[0] * 400, "x"), (5, good[0], "x"), (64, good[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None), (7, 1), (7, 1)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in scored)
    by = {r["doc_id"]: r["quality_pred"] for r in scored}
    assert by[62] == 1 and by[63] == 0 and len({r["quality_score"] for r in scored if r["text"] == good[0]}) == 1
    assert {r["quality_score"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["quality_score"] for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
    # two labels of one doc_id: the lower counts
    both = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    assert {r["quality_score"] for r in quality.score(docs, quality.train(docs, both)).collect()} == {0.0}


def test_temperature_softens_what_is_wrong():
    z, weight = np.array([8.0, 8.0, -8.0, -8.0] * 10), np.full(40, 1 / 40)
    sure, unsure = np.array([1.0, 1.0, 0.0, 0.0] * 10), np.array([1.0, 0.0, 0.0, 1.0] * 10)
    assert quality.temperature(z, sure, weight, 0.0) <= 1 < quality.temperature(z, unsure, weight, 0.0)


# ---- conversation repair


def plain_repair(rows):
    """What the contract says of the rows (turn, role, text) of one conversation, in order: all edits are tried."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub("[ \t-\r]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, state, inserts):
        if i == len(rows) and state in ("", "a"):
            options = [(0, "", ())]
        else:
            options = []
        if i < len(rows):
            _, role, text = rows[i]
            options.append(step(best(i + 1, state, 0), 4, "D", None))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if role[:1] in after[state]:
                    options.append(step(best(i + 1, role[:1], 0), more, "K", f"{role}:{text}"))
                options.append(step(best(i + 1, due[state], 0), 3 + more, "R", f"{full[due[state]]}:{text}"))
        if inserts < 3:
            options.append(step(best(i, due[state], inserts + 1), 3, "I", f"{full[due[state]]}:"))
        return min((o for o in options if o), default=None)

    def step(rest, cost, letter, line):
        return rest and (rest[0] + cost, letter + rest[1], ((line,) if line is not None else ()) + rest[2])

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(k, 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    text = lambda: rng.choice(["Yes.", "No!", "Well", " \t", "", "Why? ", "ok.", "so\x0b", "é.", None, f"{rng.random()}."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin", "User"])
    rows = [(c, rng.choice([t, t, t, t // 2, None]) if c % 3 else t, role(), text()) for c in range(120) for t in range(rng.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"line {t}." if t % 7 else "line") for t in range(160)]
    rows += [(501, 3, "user", "same.")] * 60 + [(None, t, role(), text()) for t in range(20)]
    rows += [(c, t, "user", "x.") for c in range(600, 640) for t in (11,)]
    return rows + rows[:15]


def test_repair_equals_brute_force(spark, talk):
    df = spark.createDataFrame([(*r, "x", 1) for r in talk], "conv_id long, turn long, role string, text string, n string, again int")
    want = {c: plain_repair(v) for c, v in plain_damage(talk).items()}
    old = cr.ROWS, cr.TOGETHER
    try:
        for parts, cr.ROWS, cr.TOGETHER in ((1, *old), (7, 5, 40), (3, 1, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in cr.repair(cr.damage(df.repartition(3))).collect()}
            assert got == want
    finally:
        cr.ROWS, cr.TOGETHER = old
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert any(not v for v in plain_damage(talk).values())  # a conversation of which nothing is left
    assert cr.repair(cr.damage(df.limit(0))).count() == 0


def test_least_paths_by_ranks_equal_all_paths():
    rng = np.random.default_rng(6)
    for _ in range(200):
        size = rng.integers(0, 5, 3)
        n = int(size.sum())
        rows = cr.Rows(size, rng.integers(0, 4, n), rng.integers(1, 3, n), rng.random(n) < 0.2, rng.random(n) < 0.2, rng.random(n) < 0.4)
        end, entry = rng.integers(0, 9, (3, 4)), rng.integers(0, 4, 3)
        letters, nodes, last = cr.paths(rows, end, entry)
        delete, keep, goal, rerole = rows.offers()
        first = np.cumsum(size) - size
        for c in range(3):

            @functools.cache
            def best(i, s, inserts, c=c):
                if i == size[c]:
                    return (int(end[c][s]), "", s)
                r = first[c] + i
                ways = [(int(delete[r]), "D", i + 1, s, 0), (int(rerole[r]), "R", i + 1, int(cr._TURN[s]), 0), (int(keep[r][s]), "K", i + 1, int(goal[r][s]), 0)]
                ways += [(cr.INSERT, "I", i, int(cr._TURN[s]), inserts + 1)] if inserts < 3 else []
                return min((cost + best(j, t, k)[0], letter + best(j, t, k)[1], best(j, t, k)[2]) for cost, letter, j, t, k in ways if cost < cr._FAR)

            assert ("".join(" DIKR"[k] for k in letters[c]), last[c]) == best(0, int(entry[c]), 0)[1:]
            assert math.isclose(cr.costs(rows, end)[first[c] + c, entry[c]], best(0, int(entry[c]), 0)[0]) and len(nodes[c]) == len(letters[c])


# ---- toxicity


def labelled(folder):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    marks = pq.read_table(f"{folder}/labels.parquet").to_pandas().groupby("doc_id").toxic.max()
    return [(t or "", int(marks[d]), zlib.crc32(str(d).encode()) % 5 == 0) for d, t in zip(texts.doc_id, texts.text, strict=True) if d in marks.index]


def test_toxicity_precision_and_recall_on_held_out_rows():
    rows = labelled("/root/testdata/sf0.1")
    pick = lambda y: list(dict.fromkeys(t for t, a, held in rows if a == y and not held))
    toxic, clean = pick(1), pick(0)
    model = toxicity.fit(toxic[: toxicity.SAMPLE], clean[: toxicity.SAMPLE], rarity=len(clean) / len(toxic))
    test = [(t, y) for t, y, held in rows if held]
    marked = model.score(np.array([model.evidence(model.decide(sorted(toxicity.words(t)))) for t, _ in test])) >= 0.5
    hits, found = sum(m and y for m, (_, y) in zip(marked, test, strict=True)), int(marked.sum())
    assert hits >= 0.8 * sum(y for _, y in test) and hits >= 0.85 * found


def test_toxicity_scores_equal_plain_ones(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(20))
    model = toxicity.fit([f"{text()} blockhead {text()}" for _ in range(60)], [text() for _ in range(60)], rarity=3.0)

    def plain(word):
        word = re.sub(r"[\W_]+", "", word)
        best = -1.0
        for lo in range(0, max(1, len(word) - toxicity.WINDOW // 2), toxicity.WINDOW // 2):
            part, sums = [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 for c in word[lo : lo + toxicity.WINDOW]], Counter()
            for i, j, k in itertools.combinations(range(len(part)), 3):
                if k - i < toxicity.REACH:
                    sums[(part[i] * 64 + part[j]) * 64 + part[k]] += toxicity.DECAY ** (k - i + 1)
            if sums:
                best = max(best, sum(w * float(model.weights[c]) for c, w in sums.items()) / math.sqrt(sum(w * w for w in sums.values())) + model.bias)
        return best

    texts = ["what a blockhead", "b l o c k h e a d and a block-head", "nothing here", "", None, text(), "x" * 60 + "blockhead" * 4, "blok head é"]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        f = [max(0.0, x) for x in sorted(map(plain, toxicity.words(t)), reverse=True)[:3]]
        z = model.votes[0] * max(f, default=0.0) + model.votes[1] * sum(f) + model.votes[2]
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-6
    assert got[0] > 0.5 > got[2] and (model.votes[:2] >= 0).all()


def test_only_proven_words_are_learnt():
    others = {f"w{k}": 3 for k in range(500)}  # the more words are tried, the more a word must show
    p, q = Counter({"insult": 30, "chance": 3, "quoted": 30, "common": 60, "once": 1} | others), Counter({"quoted": 2, "common": 500, "chance": 1} | {w: 27 for w in others})
    assert toxicity.proven(p, q, 100, 900) == {"insult", "quoted"}
