"""Golden values, round trips, stream and batch equality, intake."""

import math
import random
import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import functions as F

from almanac.functions import calendars as cal
from almanac.functions import sky
from almanac.functions import text as tx
from almanac.operators import annotations, catalogues, claims, dating, joins, large_lexicon, lexical, lunations, readers, retrieval, sky_tables, statements
from almanac.sources import intake
from almanac.streaming import logs

DATA = "/root/testdata/sf0.001"


def test_calendars_round_trip(spark):
    days = spark.range(-700_000, 800_000, 1009).withColumnRenamed("id", "rd")
    for name, (of, to) in cal.SYSTEMS.items():
        back = days.withColumn("d", to(F.col("rd"))).select("rd", of(F.col("d.year"), F.col("d.month"), F.col("d.day")).alias("back"))
        assert back.agg(F.count_if(F.expr("back is null or back <> rd"))).first()[0] == 0, name


def test_known_dates(spark):
    cases = [
        ("gregorian", 2000, 1, 1, 730120),
        ("julian", 1752, 9, 2, 639796 - 1),
        ("hebrew", 5784, 1, 1, 738985 - 1),
        ("islamic", 1, 1, 1, 227015),
        ("persian", 1, 1, 1, 226896),
        ("coptic", 1, 1, 1, 103605),
        ("ethiopic", 1, 1, 1, 2796),
    ]
    df = spark.createDataFrame(cases, "system string, y int, m int, d int, rd long")
    got = {r["system"]: (r["got"], r["rd"]) for r in df.withColumn("got", cal.to_rd(F.col("system"), F.col("y"), F.col("m"), F.col("d"))).collect()}
    for name in ("gregorian", "islamic", "persian", "coptic", "ethiopic"):
        assert got[name][0] == got[name][1], name
    # 2 September 1752 (Julian) was the day before 14 September 1752 (Gregorian)
    after = spark.range(1).select(cal.from_gregorian(cal.long(1752), cal.long(9), cal.long(14)) - 1).first()[0]
    assert got["julian"][0] == after
    # 1 Nisan 5784 fell on 9 April 2024, and 1 Tishri 5785 on 3 October 2024
    first = spark.range(1).select(cal.from_gregorian(cal.long(2024), cal.long(4), cal.long(9)), cal.from_gregorian(cal.long(2024), cal.long(10), cal.long(3)), cal.hebrew_new_year(cal.long(5785))).first()
    assert got["hebrew"][0] == first[0] and first[1] == first[2]
    assert spark.range(1).select(cal.to_maya(cal.from_gregorian(cal.long(2012), cal.long(12), cal.long(21)))).first()[0] == "13.0.0.0.0"
    assert spark.range(1).select(cal.to_rd(F.lit("nowhere"), F.lit(1), F.lit(1), F.lit(1))).first()[0] is None


TEXTS = [
    "Ten days, été λόγος; 40 days and 1260 days.",
    "THE SUN was darkened; the ſun hid his light, İstanbul and Kush. Blood moon! moon became as blood",
    "In the 3rd year of Cyrus, 12.19.6.15.2, A.M. 5784 and AH 1445; six hundred threescore and six. The morning star.",
    "Qur'an, sha'ban, tzolk'in and the seals; seals ed with wax, a horn of plenty, hornets. 144,000 and 3:16 and 7.5",
    "the third day of Nisan in the first year of Darius the Great, 586 BC, 70 AD, Olympiad 5, the 14th day of the 7th month",
    "Babylon babylonian Mystery Babylon, the whore of Babylon; Hebrew calendar, hebrew, sin, sins, ra, Ra. era",
    "thus saith the Lord: behold I will; BEHOLD, I WILL. prophet prophecy foretold foretell in the latter days",
    "", " ", "no portent", "xx" * 3000 + " comet " + "y" * 5000,
]


def plain_spans(patterns, text, flags):
    """All matches of all patterns, one pattern after the other, in order of start, longest first."""
    found = [(m.start(), m.end(), k) for k, p in enumerate(patterns) for m in re.finditer(p, text, flags)]
    return sorted(found, key=lambda x: (x[0], x[0] - x[1], x[2]))


def plain_apart(spans, group=lambda k: None):
    kept = []
    for s in spans:
        if not any(s[0] < k[1] and k[0] < s[1] and group(s[2]) == group(k[2]) for k in kept):
            kept.append(s)
    return kept


def test_scans_equal_the_plain_patterns(spark):
    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()][:40]
    some = TEXTS + real + [f"{a} {b}" for a in TEXTS[:7] for b in TEXTS[:7]]
    docs = spark.createDataFrame([*enumerate(some), (-1, None)], "doc_id long, text string").repartition(3)
    by = lambda df, *c: sorted(tuple(r[x] for x in ("doc_id", "start", "stop", *c)) for r in df.collect())
    rules = [(p, name, kind) for name, kind, patterns, *_ in annotations.lexicon() for p in patterns]
    bounded = [rf"\b{re.escape(p)}\b" if re.fullmatch(r"[\w' ]+", p) else p for p, _, _ in rules]
    want = [(k, s[0], s[1], *rules[s[2]][1:]) for k, t in enumerate(some) for s in plain_apart(plain_spans(bounded, t, re.I), lambda r: rules[r][2])]
    assert by(annotations.entities(docs), "name", "kind") == sorted(want)
    want = [(k, s[0], s[1], annotations.DATES[s[2]][1]) for k, t in enumerate(some) for s in plain_apart(plain_spans([p for p, _ in annotations.DATES], t, 0))]
    assert by(annotations.dates(docs), "kind") == sorted(want)
    want = [(k, s[0], s[1], annotations.MARKERS[s[2]][1]) for k, t in enumerate(some) for s in plain_spans([p for p, _ in annotations.MARKERS], t, re.I)]
    assert by(annotations.markers(docs), "marker") == sorted(want)
    want = []
    for k, t in enumerate(some):
        found = [(m.start(), m.end(), m[0].replace(",", "")) for m in re.finditer(r"\b(\d[\d,]{0,9})\b", t) if not set(".:") & set(t[max(0, m.start() - 1) : m.end() + 1])]
        found = [f for f in found if f[2] in annotations.NUMERALS] + [(m.start(), m.end(), n) for p, n in annotations.SPELLED for m in re.finditer(rf"\b{p}\b", t, re.I)]
        kept = []
        for f in sorted(found, key=lambda x: (x[0], x[0] - x[1])):
            if not any(f[0] < x[1] and x[0] < f[1] for x in kept) and f[2] not in {x[2] for x in kept}:
                kept.append(f)
        want += [(k, *f) for f in kept]
    assert by(annotations.numbers(docs), "number") == sorted(want)
    empty = docs.limit(0)
    assert not any(f(empty).count() for f in (annotations.entities, annotations.dates, annotations.markers, annotations.numbers))


def test_dates_numbers_and_entities(spark):
    docs = spark.createDataFrame([(1, "In the 3rd year of Cyrus, 12.19.6.15.2, A.M. 5784 and AH 1445; six hundred threescore and six. The morning star.")], "doc_id long, text string")
    kinds = {r["kind"]: r for r in annotations.resolve(annotations.dates(docs)).collect()}
    assert set(kinds) == {"regnal_year", "maya_long_count", "anno_mundi", "hijri_year"}
    assert kinds["anno_mundi"]["year"] == 5784 and kinds["hijri_year"]["calendar"] == "islamic" and not kinds["regnal_year"]["resolvable"]
    assert [r["number"] for r in annotations.numbers(docs).orderBy("start").collect()] == ["666"]
    assert [(r["name"], r["surface"]) for r in annotations.entities(docs).collect()] == [("Venus", "morning star")]


def test_language_and_script(spark):
    texts = [("Thou hast the hand of the king, and that which behold unto thee",), ("אבגד",), ("",), ("zzz qqq",)]
    got = [r["l"] for r in spark.createDataFrame(texts, "t string").select(tx.language(F.col("t")).alias("l")).collect()]
    assert (got[0]["code"], got[0]["register"]) == ("en", "Early Modern English")
    assert (got[1]["code"], got[1]["script"]) == ("he", "Hebrew")
    assert got[3]["code"] == "und"


def test_normalise_folds_and_strips(spark):
    got = spark.createDataFrame([("é \t x\r\n\r\n\r\n\r\ny​\x07 ",)], "t string").select(tx.normalise(F.col("t"))).first()[0]
    assert got == "é x\n\ny"


def test_joins_equal_brute_force(spark):
    left = spark.createDataFrame([(k, float(k * 7 % 50) - 20) for k in range(40)], "id int, x double")
    right = spark.createDataFrame([(k, float(k * 11 % 47) - 20.5) for k in range(40)], "rid int, y double")
    got = {(r["id"], r["rid"]) for r in joins.range_join(left, right, "x", "y", 3).collect()}
    assert got == {(r["id"], r["rid"]) for r in left.crossJoin(right).where("abs(x - y) <= 3").collect()}
    near = {r["id"]: r["near"]["rid"] for r in joins.nearest_join(left, right, "id", "x", "y", 3, "rid").collect()}
    for i, x in [(r["id"], r["x"]) for r in left.collect()]:
        want = min(((abs(x - r["y"]), r["rid"]) for r in right.collect()))
        assert near.get(i) == (want[1] if want[0] <= 3 else None)


def test_future_claims_and_caps(spark):
    rows = [("ai_hypothesis", "it will occur on Friday", 0.9, 0, None, None, 0), ("verified_history", "x", 0.5, 0, None, None, 0), ("source_text", "x", 1.5, 0, None, "q", 0)]
    df = spark.createDataFrame(rows, "claim_type string, statement string, confidence double, n_citations int, engine string, quoted_text string, n_matched int")
    got = [(r["claim_type"], r["confidence"], len(r["adjustments"])) for r in claims.coerce(df).collect()]
    assert got == [("uncertain", 0.55, 2), ("ai_hypothesis", 0.5, 1), ("source_text", 1.0, 0)]


M64 = (1 << 64) - 1


def plain_scrambled(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_vector(text, size=384):
    words = [w for w in re.findall(r"[\wͰ-῿Ⲁ-ⷿ]+", unicodedata.normalize("NFKC", text).lower()) if w not in tx.STOP_WORDS]
    number = lambda w: xxhash.xxh3_64_intdigest(w.encode())

    def run(four):
        x = 0
        for c in four:
            x = (x * 0xA0761D6478BD642F + ord(c) + 1) & M64
        return plain_scrambled(x)

    counts = {}
    for f, n in [(number(w), 1) for w in words] + [(plain_scrambled((number(a) * 0xD6E8FEB86659FD93 + number(b)) & M64), 1) for a, b in zip(words, words[1:], strict=False)] + [(run(f"^{w}$"[k : k + 4]), 0.5) for w in words if len(w) > 4 for k in range(len(w) - 1)]:
        counts[f] = counts.get(f, 0) + n
    out = [0.0] * size
    for f, n in counts.items():
        out[f % size] += (1 if f >> 63 else -1) * (1 + math.log(n))
    norm = math.sqrt(sum(v * v for v in out))
    return [v / norm for v in out] if norm else out, set(words)


def test_vectors_equal_a_plain_version(spark):
    texts = ["the moon shall be darkened", "ΛΌΓΟΣ ﬁnal Nebuchadnezzar", "", None, "moon moon moon", "Babylon babylonian babylons " * 40, "a", "x y"]
    for together in (lexical.TOGETHER, 10):
        old, lexical.TOGETHER = lexical.TOGETHER, together
        got = {r["k"]: r for r in lexical.embed(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k").collect()}
        lexical.TOGETHER = old
        for k, t in enumerate(texts):
            want, words = plain_vector(t or "")
            assert all(abs(a - b) < 1e-12 for a, b in zip(got[k]["vector"], want, strict=True)) and len(got[k]["tokens"]) == len(words)
            assert got[k]["tokens"] == sorted(got[k]["tokens"])
    assert lexical.embed(spark.createDataFrame([], "k int, text string"), "k").count() == 0

    class Lengths:
        size = 1

        def vectors(self, texts):
            return np.array([[float(len(t))] for t in texts])

    own = lexical.embed(spark.createDataFrame([(1, "abc", "z"), (2, None, None)], "k int, text string, other string"), "k", Lengths(), ["other"]).collect()
    assert [(r["k"], r["other"], r["vector"]) for r in own] == [(1, "z", [3.0]), (2, None, [0.0])]


def test_pruned_search_equals_all_pairs(spark):
    rng = random.Random(8)
    tongues = [[f"{a}{b}{k}" for a in "klmn" for b in "aeiou"] for k in range(4)]
    works = spark.createDataFrame([(k, " ".join(rng.choices(tongues[k % 4], k=rng.choice([3, 20, 80])))) for k in range(90)], "id long, text string")
    texts = [" ".join(rng.choices(tongues[k % 4] if k % 5 else sum(tongues, []), k=rng.choice([1, 15, 200]))) for k in range(60)] + ["", "zz"]
    w, q = lexical.embed(works, "id"), lexical.embed(spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "id string, text string"), "id")
    want = retrieval.top_k(q, w, 4, overlap=0.02, itself=True)
    for size in (10, 1000):
        got = retrieval.pruned_top_k(q, w, 4, size=size)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # with works of like words together, a text meets the blocks of its own words only
    placed = retrieval._blocks(w, 10)
    assert placed.count() == 90 and placed.select("block").distinct().count() > 4
    assert retrieval.pruned_top_k(q.limit(0), w, 4).count() == 0 and retrieval.pruned_top_k(q, w.limit(0), 4).count() == 0


def test_sources_of_rows_with_null_and_repeated_ids(spark):
    works = [(k, f"{w} {w}s of the {w} king and his {w} house") for k, w in enumerate("moon river temple lamb".split())] + [(None, "no id")]
    docs = [(None, works[1][1], "a"), (None, works[2][1], "b"), (7, works[3][1], "c"), (7, works[0][1], "d"), (7, works[0][1], "e"), (8, None, "f")]
    got = {}
    for r in retrieval.identify_sources(spark.createDataFrame(docs, "doc_id long, text string, mark string"), spark.createDataFrame(works, "item_id long, text string"), keep=["mark"]).where("place = 1").collect():
        assert r["mark"] not in got
        got[r["mark"]] = (r["doc_id"], r["item_id"], r["identified"])
    assert got == {"a": (None, 1, True), "b": (None, 2, True), "c": (7, 3, True), "d": (7, 0, True), "e": (7, 0, True), "f": (8, None, False)}


def test_claim_lines_of_repeated_places(spark, tmp_path):
    """Two lines of one order, line and part keep their own citations, in Spark and in SQL."""
    import duckdb

    from almanac import plans

    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(40)
    twice = rows.unionByName(rows.withColumn("l_suppkey", F.col("l_suppkey") + 1)).unionByName(rows).unionByName(rows.withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 1 day")))
    twice.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"create view {t} as select * from '{DATA if t == 'events' else tmp_path}/{t}.parquet{'' if t == 'events' else '/*.parquet'}'")
    names = ["claim_id", "ordering", "part", "statement", "engine", "citations"]
    got = sorted(tuple(r[n] for n in names) for r in plans.QUERIES["a8_claim_csv"](spark, str(tmp_path)).collect())
    want = sorted(map(tuple, con.sql(plans.ORACLE_SQL["a8_claim_csv"]).df()[names].itertuples(index=False, name=None)))
    assert len(got) == 160 and len({r[0] for r in got}) == 160 and got == want


def test_sources_equal_brute_force(spark):
    rng, words = random.Random(5), "moon sun star king temple river prophet darkness blood egypt babylon horse crown lamb seal".split()
    works = [(k, " ".join(rng.choices(words, k=30))) for k in range(12)] + [(50, ""), (51, None)]
    works += [(60, works[3][1])]
    docs = [(k, f"{works[k % 12][1]} {' '.join(rng.choices(words, k=3))}") for k in range(8)] + [(20, "quite other things entirely"), (21, None), (22, " ".join(rng.choices(words, k=10)))]
    got = {}
    for r in retrieval.identify_sources(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(works, "item_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["place"], r["item_id"], r["score"], r["identified"]))
    for d, t in docs:
        v, ws = plain_vector(t or "")
        hits = []
        for i, w in works[:-1]:
            u, us = plain_vector(w or "")
            score = round(sum(a * b for a, b in zip(v, u, strict=True)), 9)
            overlap = len(ws & us) / len(ws | us) if ws and us else 0
            if score >= 0.18 and overlap >= 0.02:
                hits.append((-score, i, overlap))
        want = [(k + 1, i, -s, k == 0 and -s >= 0.45 and o >= 0.2) for k, (s, i, o) in enumerate(sorted(hits)[:4])] or [(1, None, None, False)]
        mine = sorted(got[d])
        assert [(p, i, y) for p, i, _, y in mine] == [(p, i, y) for p, i, _, y in want] and all(s is None or abs(s - x[2]) < 1e-8 for (_, _, s, _), x in zip(mine, want, strict=True))


def test_top_k_in_blocks_and_recall_of_the_index(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    vectors = [(k, (base[k % 30] + rng.normal(size=16) * 0.6).tolist(), ["a", "b", None][k % 3]) for k in range(900)] + [(1000, None, "a"), (1001, [0.0] * 16, "a"), (1002, [1.0, 2.0], "b")]
    df = spark.createDataFrame(vectors, "id long, vector array<double>, label string")
    old = retrieval.QUERIES, retrieval.ROWS
    retrieval.QUERIES, retrieval.ROWS = 7, 100
    try:
        for by in (None, "label"):
            got = {}
            for r in retrieval.top_k(df.where("id % 20 = 0"), df, 5, 0.18, by=by).collect():
                got.setdefault(r["query_id"], []).append((r["place"], r["row_id"]))
            x = np.array([v for _, v, _ in vectors[:900]])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for q in range(0, 900, 20):
                scores = sorted((-round(float(x[q] @ x[k]), 9), k) for k in range(900) if k != q and (by is None or k % 3 == q % 3))
                assert [k for _, k in sorted(got.get(q, []))] == [k for s, k in scores[:5] if -s >= 0.18]
    finally:
        retrieval.QUERIES, retrieval.ROWS = old
    real = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    pairs = lambda found: {(r["query_id"], r["row_id"]) for r in found.collect()}
    exact, near = pairs(retrieval.top_k(real.where("id % 20 = 0"), real, 5)), pairs(retrieval.approximate_top_k(real.where("id % 20 = 0"), real, 5))
    assert len(exact & near) >= 0.9 * len(exact)


def test_file_types(spark, tmp_path):
    for name, content in {"a.txt": b"plain", "b.pdf": b"%PDF-1.7", "c.bin": b"\xff\xfe\x00\x01\x80", "d.txt": b"<script>x</script>", "e.exe": b"plain"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: (r["mime"], r["refused"]) for r in intake.files(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"] == ("text/plain", None) and got["b.pdf"] == ("application/pdf", None)
    assert got["c.bin"][1] == "type" and got["d.txt"][1] == "markup" and got["e.exe"][1] == "extension"
    # Spark's reader passes over empty files; the rule itself names them
    assert spark.range(1).select(intake.refusal(F.lit("f.txt"), F.lit(0), F.lit("text/plain"))).first()[0] == "empty"


def test_bundles(spark, tmp_path):
    good = '{"dataset": {"key": "k", "name": "n", "license": "l"}, "sources": [{"slug": "s", "title": "t", "canonical_citation": "c", "license": "l"}], "passages": [{"source_slug": "s", "reference_label": "1", "translation": "x", "translation_credit": "w"}], "events": [{"designation": "e", "event_type": "comet", "label": "l", "is_computed": true}]}'
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "bad.json").write_text(good.replace('"source_slug": "s"', '"source_slug": "none"').replace('"is_computed": true', '"is_computed": false'))
    assert intake.violations(intake.bundle(spark, f"file://{tmp_path}/good.json")).count() == 0
    got = {r["problem"] for r in intake.violations(intake.bundle(spark, f"file://{tmp_path}/bad.json")).collect()}
    assert got == {"source undefined", "recorded event without source"}


def test_streams_equal_batches(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert logs.replay(spark, DATA, "events", logs.stream_once).count() == events.count()
    usage = logs.replay(spark, DATA, "events", logs.stream_usage, "complete")
    assert usage.exceptAll(logs.s7(spark, DATA)).count() == 0 and usage.count() == logs.s7(spark, DATA).count()
    # append mode gives the windows that the watermark has closed
    assert logs.replay(spark, DATA, "events", logs.stream_audit).exceptAll(logs.s5(spark, DATA)).count() == 0


def test_seasons_and_delta_t(spark):
    years = spark.createDataFrame([(1962,), (-585,), (2000,)], "year long")
    got = {(r["year"], r["season"]): r for r in sky_tables.seasons(years).collect()}
    assert abs(got[1962, "june solstice"]["jd_tt"] - 2437837.39245) < 1e-4
    assert got[2000, "march equinox"]["rd"] == 730120 + 31 + 29 + 19
    expected = [(-500.0, 17203.7, 60.0), (0.0, 10583.6, 10.0), (1000.0, 1574.2, 5.0), (1700.0, 8.83, 1.0), (1900.0, -2.79, 1.0), (2000.0, 63.86, 0.5)]
    df = spark.createDataFrame(expected, "y double, want double, tolerance double")
    assert all(abs(r["got"] - r["want"]) <= r["tolerance"] for r in df.withColumn("got", sky.delta_t(F.col("y"))).collect())


def test_lunar_phases(spark):
    got = {(r["lunation"], r["phase"]): r["jd_tt"] for r in lunations.phases(spark, 1977, 1977).collect() + lunations.phases(spark, 2044, 2044).collect()}
    assert abs(got[-283, "new moon"] - 2443192.65118) < 1e-4
    assert abs(got[544, "last quarter"] - 2467636.49186) < 1e-4
    new = sorted(v for (k, p), v in got.items() if p == "new moon" and v < 2.45e6)
    assert all(29.2 < b - a < 29.9 for a, b in zip(new, new[1:], strict=False))


def test_known_eclipses(spark):
    modern = {(r["body"], r["date"]["year"], r["date"]["month"], r["date"]["day"]): r for r in lunations.eclipses(spark, 1999, 2019).collect()}
    assert abs(modern["solar", 1999, 8, 11]["gamma"] - 0.5062) < 1e-3 and modern["solar", 1999, 8, 11]["kind"] == "total"
    assert abs(modern["lunar", 2019, 1, 21]["magnitude"] - 1.1953) < 5e-3
    # 28 May 585 BCE and 15 June 763 BCE in the Julian calendar
    for year, month, day in ((-584, 5, 28), (-762, 6, 15)):
        rd = spark.range(1).select(cal.from_julian(cal.long(year), cal.long(month), cal.long(day))).first()[0]
        found = lunations.eclipses(spark, year, year).where((F.col("body") == "solar") & (F.col("rd") == rd))
        assert found.count() == 1


def test_as_of_and_interval_joins_equal_brute_force(spark):
    rng = random.Random(4)
    left = [(k, "ab"[k % 2], rng.uniform(0, 100)) for k in range(60)]
    right = [("ab"[k % 2], rng.uniform(0, 100), k) for k in range(40)]
    l, r = spark.createDataFrame(left, "id int, u string, t double"), spark.createDataFrame(right, "u string, at double, v int")
    for stretch in (None, 7.0):
        got = {x["id"]: x["v"] for x in joins.asof_join(l, r, ["u"], "t", "at", ["v"], stretch).collect()}
        for i, u, t in left:
            assert got[i] == max(((at, v) for w, at, v in right if w == u and at <= t), default=(None, None))[1]
    arcs = [(k, rng.uniform(0, 360), rng.uniform(0, 360)) for k in range(30)]
    points = spark.createDataFrame([(k, rng.uniform(0, 360)) for k in range(50)], "p int, x double")
    want = {(p["p"], k) for p in points.collect() for k, a, b in arcs if (a <= p["x"] < b if a <= b else p["x"] >= a or p["x"] < b)}
    old = joins.FEW
    try:
        for joins.FEW in (old, 0):
            assert {(x["p"], x["k"]) for x in joins.interval_join(points, spark.createDataFrame(arcs, "k int, a double, b double"), "x", "a", "b", 360).collect()} == want
    finally:
        joins.FEW = old


def test_readers_take_the_leftmost(spark):
    rows = [("three days of darkness came, and it was dark for two days", 3), ("it was dark for two days, then three days of darkness", 2), ("darkness. 4 days", None), (None, None), ("DARKNESS for 12 days", 12)]
    got = [r["d"] for r in spark.createDataFrame(rows, "t string, n int").select(readers.darkness_days(F.col("t")).alias("d")).collect()]
    assert got == [n for _, n in rows]
    years = spark.createDataFrame([("587 BCE and 70 AD, 4000 BC, 1 bc",)], "t string").select(readers.years_in(F.col("t")).alias("y")).first()["y"]
    assert years == [-586, 70, 0]


def test_dating_over_real_eclipses(spark):
    docs = spark.createDataFrame([(1, "In 585 BC the sun was darkened in the spring, a total eclipse; three days of darkness."), (2, "A comet in 66 AD."), (3, "In A.H. 200 the moon was darkened at full moon."), (4, "nothing"), (5, None)], "doc_id long, text string")
    asked = dating.criteria(docs).join(dating.spans(docs), "doc_id")
    rows = {r["doc_id"]: r for r in asked.collect()}
    assert (rows[1]["eclipse"], rows[1]["total"], rows[1]["season"], rows[1]["dark_days"], rows[1]["first"], rows[1]["last"]) == ("solar", True, "spring", 3, -784, -384)
    assert rows[3]["phase"] == "full" and rows[3]["first"] == 815 - 200 and (rows[4]["first"], rows[4]["last"]) == (-550, -51)
    days = dating.sky_days(spark, -784, 1015)
    table = {(d["kind"], d["year"], d["month"], d["day"]): d for d in days.where("year in (-584, 66)").collect()}
    # 28 May 585 BCE (Julian) is 22 May in the Gregorian reckoning: a total eclipse in spring
    assert table["solar", -584, 5, 22]["is_total"] and table["solar", -584, 5, 22]["season"] == "spring"
    found = dating.candidates(asked, days)
    best = {}
    for r in found.collect():
        best.setdefault(r["doc_id"], []).append(r)
    assert set(best) == {1, 2, 3} and all(len(v) <= 10 for v in best.values())
    one = sorted(best[1], key=lambda r: r["place"])
    assert one[0]["fit"] == 1.0 and one[0]["unsearchable"] == ["unusual_darkness"] and all(r["weak"] for r in one) and abs(one[0]["confidence"] - 0.55) < 1e-9
    assert [r["fit"] for r in one] == sorted((r["fit"] for r in one), reverse=True)
    assert {r["year"] for r in best[2]} <= {-86, -11, 66, 141, 218, -43} and best[2][0]["fit"] == 1.0
    claims_ = dating.candidate_claims(found)
    assert claims.problems(claims_).where("size(problems) > 0").count() == 0
    assert dating.candidates(asked.limit(0), days).count() == 0


def test_whole_spans_are_searched(spark, tmp_path):
    from almanac import plans

    texts = [(1, "A comet was seen.", None, None), (2, "A comet in 66 AD.", None, None), (3, "The sun was darkened.", 1500, -900), (4, "The sun was darkened.", -9000, 9000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, given_first int, given_last int")
    found = {r["doc_id"]: (r["first"], r["last"]) for r in dating.searches(docs).collect()}
    assert found == {1: (-800, 200), 2: (-134, 266), 3: (-900, 1500), 4: (-3000, 3000)}
    assert found == {r["doc_id"]: (r["first"], r["last"]) for r in dating.spans(docs, None).collect()}
    # a cap is only what is asked for
    assert {r["doc_id"]: (r["first"], r["last"]) for r in dating.spans(docs).collect()} == {1: (-550, -51), 2: (-134, 266), 3: (50, 549), 4: (-250, 249)}
    spark.createDataFrame([(k,) for k in range(12)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    claims_ = plans.QUERIES["j15_candidates_of_eclipses"](spark, str(tmp_path)).where("doc_id = 2").orderBy("ordering").collect()
    # a comet without a year: all that are recorded from -800 to 200 in order of time; before, none after -51
    years = [int(r["statement"].split("-01-01 ")[0]) for r in claims_]
    assert years == sorted(c[2] for c in catalogues.COMETS if -800 <= c[2] <= 200) and max(years) == 141 and len(years) == 7


def test_catalogues_and_facts_of_dates(spark):
    dates = spark.createDataFrame([(1, 1066, 1, 1), (2, 1604, 8, 12), (3, 500, 2, 10)], "date_id long, year int, month int, day int")
    got = {}
    for r in catalogues.near_dates(dates).collect():
        got.setdefault(r["date_id"], set()).add((r["what"], r["name"], r["off"]))
    assert got[1] == {("comet", "1P/1066 G1", 0), ("shower", "Quadrantids", 2)}
    assert ("supernova", "SN 1604", 0) in got[2] and ("shower", "Perseids", 0) in got[2] and ("comet", "1P/1607 S1", 3) in got[2] and 3 not in got
    day = spark.createDataFrame([(1, 1999, 8, 11)], "date_id long, year long, month int, day int").withColumn("rd", cal.from_gregorian(F.col("year"), cal.long(8), cal.long(11)))
    facts = catalogues.facts_of_dates(day, 1999, 1999).first()
    assert facts["new_moon"] == facts["rd"] and len(facts["seasons"]) == 4 and any(e["erd"] == facts["rd"] and e["event_type"] == "solar_eclipse" for e in facts["eclipses"])
    assert facts["time"]["note"] == "exact"
    events = catalogues.sky_events(spark, 1999, 1999)
    assert events.where("event_type = 'season'").count() == 4 and events.where("event_type = 'solar_eclipse' and month = 8 and day = 11 and hour between 10 and 12").count() == 1


def test_claims_of_texts_and_their_stream(spark):
    docs = spark.createDataFrame([(1, "In 585 BC the sun was darkened. Seven seals. Thus saith the Lord."), (2, "The moon became as blood."), (3, None), (4, "")], "doc_id long, text string")
    rows = {}
    for r in statements.claims_of_annotations(docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert set(rows) == {1, 2, 4}
    kinds = [(r["section"], r["claim_type"], r["quoted_text"]) for r in sorted(rows[1], key=lambda r: r["ordering"])]
    assert kinds[0][0] == "original_text" and ("key_entities", "source_text", "Seven") in kinds and ("calendar_conversion", "astronomical_calculation", "585 BC") in kinds
    assert any(r["claim_type"] == "ai_hypothesis" for r in rows[1]) and any(r["claim_type"] == "uncertain" and r["section"] == "astronomical_references" for r in rows[2])
    assert all(sorted(r["ordering"] for r in v) == list(range(1, len(v) + 1)) for v in rows.values())
    sky = [r["statement"] for r in statements.claims_of_sky(docs).collect()]
    assert any("solar eclipse on -584-05-22" in s for s in sky) and 0 < len(sky) <= 6
    line = {(r["kind"], r["year"]) for r in statements.timeline(docs).collect()}
    assert ("calendar_conversion", -584) in line and ("astronomical_event", -584) in line
    stream = logs.s6(spark, DATA)
    batch = statements.claims_of_annotations(spark.read.parquet(f"{DATA}/documents.parquet")).select(*stream.columns)
    assert stream.count() == batch.count() and stream.exceptAll(batch).count() == 0


def test_account_states_stream_as_in_batch(spark):
    got = logs.replay(spark, DATA, "events", logs.stream_accounts, "complete")
    want = logs.s4(spark, DATA)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_readable_takes_the_marked_part(spark):
    long = "words " * 50
    pages = [
        f"<body><nav>menu</nav><div role='main'><p>{long}</p></div><p>other</p></body>",
        f"<body><div id=\"content\">{long}</div><footer>x</footer></body>",
        f"<body><section class=\"wide content\">{long}</section><p>other</p></body>",
        f"<body><main>short</main><p>{long}</p></body>",
        f"<article>{long}</article><main>{long} more</main>",
    ]
    got = [r["t"] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(intake.readable(F.col("h")).alias("t")).collect()]
    assert all("other" not in t and "menu" not in t for t in got[:3]) and "short" in got[3] and "more" not in got[4]


def test_stages_by_mode_and_lexicon_tables(spark):
    docs = spark.createDataFrame([(1, "In 585 BC the sun was darkened. The gorgon came."), (2, None)], "doc_id long, text string")
    quick, whole = statements.claims_by_mode(docs, "quick").collect(), statements.claims_by_mode(docs, "no such mode").collect()
    assert 0 < len(quick) < len(whole) and sorted(r["ordering"] for r in whole) == list(range(1, len(whole) + 1))
    entries = annotations.entries_of(annotations.lexicon_table(spark, [("Gorgon", "creature", ["gorgon"], None, None, None)]))
    assert [(r["name"], r["kind"]) for r in annotations.entities(docs, entries).collect()] == [("Gorgon", "creature")]


def test_annotations_in_one_pass(spark, tmp_path):
    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()][:20]
    some = TEXTS + real + [None]
    docs = spark.createDataFrame([(k, t, f"m{k}") for k, t in enumerate(some)], "doc_id long, text string, mark string").repartition(3)
    rows = {r["doc_id"]: r for r in annotations.annotate(docs, keep=["mark"]).collect()}
    assert len(rows) == len(some) and all(r["mark"] == f"m{k}" for k, r in rows.items())
    for name, alone in (("numbers", annotations.numbers), ("markers", annotations.markers), ("dates", annotations.dates), ("entities", annotations.entities)):
        want = {}
        for r in alone(docs).collect():
            want.setdefault(r["doc_id"], []).append(tuple(r)[1:])
        assert {k: [tuple(x) for x in r[name]] for k, r in rows.items() if r[name]} == want
    docs.write.parquet(f"file://{tmp_path}/docs")
    read = spark.read.parquet(f"file://{tmp_path}/docs")
    for made in (statements.claims_of_annotations(read), dating.searches(read), statements.timeline(read, sky=False)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1
    assert "Exchange" not in statements.claims_of_annotations(read)._jdf.queryExecution().executedPlan().toString()


def test_years_in_arrays_equal_placed_dates(spark):
    texts = [f"In A.M. {y} and A.H. {y % 1500 + 1}; {y} BC, Olympiad {y % 300 + 1}." for y in range(1, 9999, 37)] + ["12.19.6.15.2 and A.M. 99"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = annotations.place(annotations.resolve(annotations.dates(docs))).where("resolvable")
    year = F.when(F.col("calendar").isin("julian", "olympiad"), F.col("year")).otherwise(cal.to_gregorian(F.col("first_rd"))["year"])
    want = {}
    for r in placed.select("doc_id", "start", year.alias("y")).where("y between -3000 and 3000").orderBy("start").collect():
        want.setdefault((r["doc_id"], r["y"]), r["start"])
    got = {(r["doc_id"], r["year"]): r["start"] for r in statements.named_years(docs).collect()}
    assert got == want and len(got) > 300
    # the years that Hebrew and Islamic years begin in, against the day numbers of their first days
    years = spark.range(1, 40_000, 3).select(F.col("id").alias("year"), F.explode(F.array(F.lit("hebrew"), F.lit("islamic"))).alias("calendar"))
    begins = annotations.place(years).withColumn("want", cal.to_gregorian(F.col("first_rd"))["year"])
    assert begins.where(annotations.year_of(F.col("calendar"), F.col("year")) != F.col("want")).count() == 0


def test_claims_of_rows_with_null_and_repeated_ids(spark):
    many = "Seven and 40, 12, 3, 4, 7, 10, 50, 70, 144, 153, 216, 360, 432, 666. " + "Thus saith the Lord. " * 12
    docs = spark.createDataFrame([(None, many), (None, "585 BC."), (4, many), (4, "In 585 BC the sun was darkened."), (4, None)], "doc_id long, text string")
    rows = {}
    for r in statements.claims_of_annotations(docs).collect():
        rows.setdefault((r["doc_id"], r["text_key"]), []).append(r)
    assert len(rows) == 4 and all(sorted(r["ordering"] for r in v) == list(range(1, len(v) + 1)) for v in rows.values())
    full = [v for v in rows.values() if len(v) > 20]
    assert len(full) == 2 and all(sum(r["section"] == "symbolism" for r in v) == 12 and sum(r["confidence"] == 0.85 and r["section"] == "key_entities" for r in v) == 10 for v in full)
    modes = statements.claims_by_mode(docs).collect()
    assert sum(r["statement"].startswith("The text, as it was given") for r in modes) == 4 and any("eclipse on -584-05-22" in r["statement"] for r in modes)
    line = statements.timeline(docs, sky=False).collect()
    assert sorted((r["doc_id"] or 0, r["year"]) for r in line if r["description"] == "585 BC") == [(0, -584), (4, -584)]


def test_comets_near_eclipses_get_credit(spark):
    asked = spark.createDataFrame([(1, "solar", True, True, 0, 100), (2, "lunar", False, True, 0, 100), (3, "either", False, True, 0, 100), (4, "solar", False, True, 200, 300)], "doc_id long, eclipse string, total boolean, comet boolean, first long, last long")
    asked = asked.selectExpr("*", "cast(null as array<string>) bodies", "cast(null as string) phase", "cast(null as int) dark_days", "cast(null as string) season")
    day = "day_id long, kind string, year long, month int, day int, is_total boolean, phase string, season string, comet_gap int"
    comet = (1, "comet", 50, 1, 1, False, None, None, 0)
    # no eclipse in the span: days of comets, with the nearest eclipse of the wanted body by its distance
    outside = [(2, "solar", 101, 1, 1, False, None, None, None), (3, "lunar", 250, 1, 1, False, None, None, None)]
    near = {r["day_id"]: r for r in dating.near_eclipses(spark.createDataFrame([comet, (4, "solar", 49, 12, 2, False, None, None, None), (5, "lunar", 50, 5, 31, True, None, None, None), (6, "solar", 50, 9, 1, True, None, None, None)], day)).collect()}
    assert (near[1]["near_solar"]["off"], near[1]["near_solar"]["whole"], near[1]["near_lunar"]["off"]) == (30, False, 150)
    got = {r["doc_id"]: r for r in dating.candidates(asked, spark.createDataFrame([comet, *outside], day)).collect()}
    assert set(got) == {1, 2, 3} and all(r["unmatched"] == ["eclipse"] and abs(r["fit"] - 0.6 / 1.6) < 1e-9 for r in got.values())
    # the last day of the span has an eclipse a month after a comet of its own
    late = (7, "comet", 100, 12, 15, False, None, None, 0)
    found = {r["doc_id"]: r for r in dating.candidates(asked.where("doc_id < 3"), spark.createDataFrame([late, *outside[:1]], day)).collect()}
    credit = (1 - 0.6 * (17 - 15) / 165) * 0.7
    assert abs(found[1]["fit"] - (credit + 0.6) / 1.6) < 1e-9 and found[1]["matched"] == ["eclipse", "comet"] and found[2]["matched"] == ["comet"]
    # where the span has an eclipse, comets are no days of their own
    both = dating.candidates(asked, spark.createDataFrame([comet, (8, "solar", 60, 1, 1, True, None, None, None)], day)).collect()
    assert {(r["doc_id"], r["kind"]) for r in both} == {(1, "solar"), (2, "comet"), (3, "solar")}


def test_stage_runs_count_while_they_write(spark):
    docs = spark.createDataFrame([(1, "In 585 BC the sun was darkened. Seven seals."), (2, "The moon became as blood."), (3, None)], "doc_id long, text string")

    def broken(docs):
        return docs.select("doc_id", F.raise_error(F.lit("no such sky")).cast("string").alias("claim_type"), F.lit(0.5).alias("confidence"))

    found, runs = statements.run_mode(docs, stages=[statements.claims_of_annotations, broken, statements.claims_of_sky])
    assert [r.status for r in runs] == ["completed", "failed", "completed"] and statements.outcome(runs) == "partial" and "no such sky" in runs[1].error
    for run, stage in ((runs[0], statements.claims_of_annotations), (runs[2], statements.claims_of_sky)):
        rows = stage(docs).collect()
        grade = {"source_text", "verified_history", "astronomical_calculation"}
        assert (run.claims, run.evidence) == (len(rows), sum(r["claim_type"] in grade for r in rows)) and abs(run.confidence - sum(r["confidence"] for r in rows) / len(rows)) < 1e-9
    want = statements.claims_by_mode(docs).select(*found.columns)
    assert found.count() == want.count() and found.exceptAll(want).count() == 0
    none, failed = statements.run_mode(docs, stages=[broken])
    assert none.count() == 0 and statements.outcome(failed) == "failed" and statements.trace_table(spark, failed).first()["outcome"] == "failed"


def test_large_lexicon_equals_plain_patterns(spark):
    rng = random.Random(12)
    words = ["sun", "moon", "sun's", "red", "the", "of", "Été", "łódź", "x1", "_", "star-fire", "İz"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    entries = [(f"n{k}", rng.choice("ab"), [make(rng.randint(1, 4)) for _ in range(rng.randint(0, 3))]) for k in range(300)] + [("odd", "a", ["!sun", "moon.", "", None]), ("twin", "a", ["the moon"]), ("twin", "b", ["the moon", "THE  Moon"])]
    texts = [rng.choice(["", "(", "\n"]) + rng.choice([" ", "  ", " ", ", "]).join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(80)] + [None, "", "The Moon of the moon's", "SUN SUN", make(3000)]
    docs = spark.createDataFrame([(None if k % 9 == 0 else k % 40, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = large_lexicon.mentions(docs, spark.createDataFrame(entries, "name string, kind string, phrases array<string>"))
    got = sorted(tuple((x is not None, x) for x in r) for r in found.collect())
    want = set()
    for k, t in enumerate(texts):
        low = large_lexicon._lowered(t or "")
        for kind in "ab":
            spans = {(m.start(), -m.end(1), name) for name, g, ps in entries if g == kind for p in ps if p and re.fullmatch(r"\w(.*\w)?", q := re.sub(r"\s+", " ", p.lower().strip())) for m in re.finditer(rf"(?<!\w)(?=({re.escape(q)})(?!\w))", low)}
            stop = 0
            for a, b, name in sorted(spans):
                if a >= stop:
                    stop = -b
                    want.add((k, a, stop, t[a:stop], name, kind))
    seen = {(None if k % 9 == 0 else k % 40, texts[k], *r) for k, *r in want}
    want = sorted(tuple((x is not None, x) for x in (d, *r)) for d, _, *r in seen)
    assert [x for x in want if x not in got] == [] and [x for x in got if x not in want] == [] and got == want and len(got) > 200
    assert large_lexicon.mentions(docs.limit(0), spark.createDataFrame(entries, "name string, kind string, phrases array<string>")).count() == 0
    many = spark.range(100_000).select(F.concat(F.lit("entry "), "id").alias("name"), F.lit("k").alias("kind"), F.array(F.concat(F.lit("name "), "id", F.lit(" of things"))).alias("phrases"))
    few = large_lexicon.mentions(spark.createDataFrame([(1, "Name 77 of things, name 99999 of things; name 100000 of things")], "doc_id long, text string"), many)
    assert sorted((r["start"], r["name"]) for r in few.collect()) == [(0, "entry 77"), (19, "entry 99999")]


def test_claims_of_sources_tell_of_disputed_dates(spark):
    works = [(k, f"{w} {w}s of the {w} king and his {w} house", n) for k, (w, n) in enumerate([("moon", "before or after the fall"), ("river", None), ("temple", " ")])]
    docs = spark.createDataFrame([(1, works[0][1]), (None, works[1][1]), (None, works[2][1]), (4, "quite other things"), (5, None)], "doc_id long, text string")
    got = {}
    for r in statements.claims_of_sources(docs, spark.createDataFrame(works, "item_id long, text string, dating_note string")).orderBy("ordering").collect():
        got.setdefault((r["doc_id"], r["text_key"]), []).append((r["ordering"], r["claim_type"], r["statement"]))
    assert len(got) == 4 and all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    last = {v[0][2]: v[-1] for v in got.values()}
    assert last["The text corresponds to work 0."][1:] == ("scholarly_interpretation", "The date of work 0: before or after the fall")
    assert not any("date of work" in x[2] for v in got.values() for x in v if "work 0" not in v[0][2])
    assert ("uncertain", "No work of the corpus is close to this text.") in {x[1:] for v in got.values() for x in v}


def test_pages_filter_by_owner_project_and_tag(spark):
    from almanac.operators import reports

    rows = [(k, k % 3, k % 2, "ab"[k % 2], k % 4 == 0, f"Title_{k % 5}%", k // 2) for k in range(60)]
    analyses = spark.createDataFrame(rows, "analysis_id long, owner_id long, project_id long, status string, is_favorite boolean, title string, created_at long")
    tags = spark.createDataFrame([(k, "sky") for k in range(0, 60, 3)] * 2 + [(1, "sea")], "analysis_id long, slug string")
    for asked, keep in (
        ({"owner": 1}, lambda r: r[1] == 1), ({"project": 0, "favourite": True}, lambda r: r[2] == 0 and r[4]), ({"tag": "sky", "status": "b"}, lambda r: r[0] % 3 == 0 and r[3] == "b"), ({"title": "LE_3%"}, lambda r: r[5] == "Title_3%"),
        ({"tag": "none"}, lambda r: False), ({}, lambda r: True),
    ):
        want = sorted((r for r in rows if keep(r)), key=lambda r: (-r[6], r[0]))
        got = reports.analyses_page(analyses, tags, limit=5, offset=2, **asked).collect()
        assert [r["analysis_id"] for r in got] == [r[0] for r in want[2:7]] and all(r["total"] == len(want) for r in got)


def test_index_reads_few_rows_in_full_and_finds_most(spark):
    real = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    pairs = lambda found: {(r["query_id"], r["row_id"]): r["score"] for r in found.collect()}
    asks = real.where("id % 20 = 0")
    exact, near = pairs(retrieval.top_k(asks, real, 5)), pairs(retrieval.approximate_top_k(asks, real, 5))
    assert len(exact.keys() & near.keys()) >= 0.95 * len(exact) and all(abs(exact[x] - near[x]) < 1e-8 for x in exact.keys() & near.keys())
    assert 5 * retrieval.OVERFETCH < 0.1 * real.count()  # what a query reads in full
    # where vectors lie in groups, a query looks into few cells
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + 0.2 * rng.normal(size=16)).tolist()) for k in range(1600)] + [(5000, None), (5001, [1.0]), (5002, [0.0] * 16)]
    x = np.array([v for _, v in rows[:1600]])
    centres = retrieval._cells(x, 40)
    assert retrieval._probes(x, centres, 5, 0.97) <= 8 and retrieval._probes(rng.normal(size=(640, 64)), retrieval._cells(rng.normal(size=(640, 64)), 40), 5, 0.97) > 20
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    old = retrieval.QUERIES, retrieval.ROWS
    retrieval.QUERIES, retrieval.ROWS = 7, 20
    try:
        exact, near = pairs(retrieval.top_k(df.where("id % 10 = 0"), df, 5)), pairs(retrieval.approximate_top_k(df.where("id % 10 = 0"), df, 5))
    finally:
        retrieval.QUERIES, retrieval.ROWS = old
    assert len(exact.keys() & near.keys()) >= 0.95 * len(exact)
    assert retrieval.approximate_top_k(df.limit(0), df, 5).count() == 0 and retrieval.approximate_top_k(df, df.limit(0), 5).count() == 0
