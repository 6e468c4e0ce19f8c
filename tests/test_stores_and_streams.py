"""Stores that change as a whole, loads of bundles, and streams with state against their batch twins."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from almanac.sources import bundles
from almanac.sources.store import Kept, Store
from almanac.streaming import stateful

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    kinds = {n: spark.createDataFrame([], d).schema for n, d in {"one": "k string, n int, v string", "two": "a int, b int, v double"}.items()}
    return Store(spark, f"file://{tmp_path}/store", {"one": Kept(kinds["one"], ("k",)), "two": Kept(kinds["two"], ("a", "b"))}, 8)


def files(store, name):
    return {b: f for (t, b), f in store._manifest().items() if t == name}


def test_store_changes_only_touched_buckets(spark, store):
    rng, plain = random.Random(1), {}
    assert store.read("one").count() == 0 and store.version() == 0
    for turn in range(4):
        new = [(rng.choice([None, *map(str, range(40))]), turn, f"{turn}") for _ in range([60, 1, 0, 5][turn])]
        before = files(store, "one")
        out = store.put({"one": spark.createDataFrame(new, "k string, n int, v string").withColumn("other", F.lit(1))})
        plain |= {r[0]: r for r in new}
        got = {r["k"]: tuple(r) for r in store.read("one").collect()}
        assert got == plain and store.read("one").count() == len(plain)
        after = files(store, "one")
        changed = {b for b in after if after[b] != before.get(b)}
        assert len(changed) == out.buckets["one"] and (out.version is None) == (not new)
        assert all(after[b] == before[b] for b in before if b not in changed)
    assert store.version() == 3


def test_store_changes_all_tables_or_none(spark, store):
    store.put({"one": spark.createDataFrame([("x", 1, "old")], "k string, n int, v string"), "two": spark.createDataFrame([(1, 2, 0.5)], "a int, b int, v double")})
    held = store.read("one")

    @F.udf("double")
    def broken(x):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        store.put({"one": spark.createDataFrame([("x", 2, "new"), ("y", 2, "new")], "k string, n int, v string"), "two": spark.createDataFrame([(1, 2)], "a int, b int").withColumn("v", broken("a"))})
    assert store.version() == 1 and [tuple(r) for r in store.read("one").collect()] == [("x", 1, "old")] and store.read("two").count() == 1
    store.put({"one": spark.createDataFrame([("x", 3), ("x", 3)], "k string, n int"), "two": spark.createDataFrame([(None, 2, 1.0), (None, 2, 1.0)], "a int, b int, v double")})
    assert [tuple(r) for r in store.read("one").collect()] == [("x", 3, None)] and store.read("two").count() == 2
    assert [tuple(r) for r in held.collect()] == [("x", 1, "old")]  # who reads the old version goes on reading it


def bundle(slug, title="t", label="1", text="x", **more):
    one = {"dataset": {"key": slug, "name": "n", "license": "l"}, "sources": [{"slug": slug, "title": title, "canonical_citation": "c", "license": "l", "odd": 1}]}
    one["passages"] = [{"source_slug": slug, "reference_label": label, "translation": text, "translation_credit": "w", "themes": ["a", "b"]}]
    one["events"] = [{"designation": f"{slug}-e", "event_type": "comet", "label": "seen", "year": -12, "source_slug": slug}]
    return one | more


def test_bundles_are_loaded_whole_or_not_at_all(spark, tmp_path):
    store = bundles.corpus_store(spark, f"file://{tmp_path}/corpus", 4)

    def put(name, *some):
        (tmp_path / name).mkdir()
        for k, b in enumerate(some):
            (tmp_path / name / f"{k}.json").write_text(json.dumps(b))
        return f"file://{tmp_path}/{name}"

    show = lambda: {t: sorted(map(str, store.read(t).collect())) for t in ("sources", "passages", "events", "datasets")}
    tried = bundles.load(store, put("first", bundle("s"), bundle("r", "other")), dry_run=True)
    assert not tried.refused and tried.change is None and store.version() == 0
    done = bundles.load(store, f"file://{tmp_path}/first")
    assert done.change.rows == {"sources": 2, "passages": 2, "events": 2, "datasets": 2} and store.version() == 1
    assert store.read("passages").where("source_slug = 's'").first()["themes"] == ["a", "b"]
    before = show()
    bad = bundle("q", "", passages=[{"source_slug": "none", "reference_label": "1", "translation": "x", "translation_credit": ""}] * 2, events=[{"designation": "e", "event_type": "t", "label": "l"}], dataset={"key": "k"})
    refused = bundles.load(store, put("bad", bundle("s", "newer"), bad))
    found = {(r["part"], r["name"], r["problem"]) for r in refused.problems.collect()}
    assert found == {
        ("sources", "q", "title missing"), ("passages", "1", "translation_credit missing"), ("passages", "1", "label repeated"), ("passages", "1", "source undefined"),
        ("events", "e", "recorded event without source"), ("datasets", "k", "name missing"), ("datasets", "k", "license missing"),
    }
    assert refused.change is None and show() == before and store.version() == 1
    bundles.load(store, put("second", bundle("s", "newer", text="y"), bundle("p")))
    assert {(r["slug"], r["title"]) for r in store.read("sources").collect()} == {("s", "newer"), ("r", "other"), ("p", "t")}
    assert {(r["source_slug"], r["translation"]) for r in store.read("passages").collect()} == {("s", "y"), ("r", "x"), ("p", "x")}
    again = show()
    bundles.load(store, f"file://{tmp_path}/second")
    assert show() == again
    assert bundles.load(store, put("none", {"dataset": None, "sources": []})).refused == 1


def log(spark, seed, n=90):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, 3, 3, None]), k, 1_000_000_000 + rng.randrange(0, 60_000), rng.choice(["running", "running", "completed", "failed"]), rng.randrange(5), 3) for k in range(n)]
    rows += [(9, 10_000 + k, 1_000_005_000 + 1800 * k, "running", 0, 3) for k in range(4)]  # just in time, each
    return spark.createDataFrame(rows, "job_id long, event_id long, s long, status string, attempts int, most int").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_sweep_over_shuffled_batches_and_a_restart_equals_the_batch(spark, tmp_path):
    every = log(spark, 3).withColumn("ts", F.when(F.col("ts").isNotNull(), F.col("ts"))).cache()
    want = stateful.swept(every)
    assert {r["verdict"] for r in want.collect()} == {"retrying", "failed"} and want.where("job_id = 9").count() == 1
    whole = f"file://{tmp_path}/whole"
    every.repartition(3).write.parquet(f"{whole}/in")
    got = stateful.append_all(stateful.stream_sweep(stateful.watched(spark, f"{whole}/in", every.schema)), whole)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # in stretches of three hours, with rows of a stretch in any order, one file a batch, stopped in between
    parts = f"file://{tmp_path}/parts"
    spans = every.withColumn("part", F.floor((F.unix_seconds("ts") - 1_000_000_000) / 3500).cast("int"))
    top = spans.agg(F.max("part")).first()[0]
    for k in range(top + 1):
        spans.where(F.col("part") == k).drop("part").orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(f"{parts}/in")
        if k in (top // 2, top):
            got = stateful.append_all(stateful.stream_sweep(stateful.watched(spark, f"{parts}/in", every.schema, 1)), parts)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_accounts_are_kept_by_key(spark, tmp_path):
    from almanac.streaming import logs

    events = spark.read.parquet(f"{DATA}/events.parquet")
    out = f"file://{tmp_path}"
    halves = events.randomSplit([0.5, 0.5], 7)
    for k, half in enumerate(halves):
        half.repartition(2).write.mode("append").parquet(f"{out}/in")
        store = stateful.keep_accounts(stateful.stream_accounts(stateful.watched(spark, f"{out}/in", events.schema, 1)), out, 4)
        seen = halves[0] if not k else events
        got, want = store.read("accounts"), logs.account_state(seen)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_rows_are_in_time_or_late(spark, tmp_path):
    rng = random.Random(5)
    out, seen, want = f"file://{tmp_path}", None, {}
    for k in range(4):
        rows = [(100 * k + j, None if j == 7 else 1_000_000 + 3000 * k + rng.randrange(-6000, 3000)) for j in range(30)]
        df = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.mode("append").parquet(f"{out}/in")
        on_time, late = stateful.split_late(stateful.watched(spark, f"{out}/in", df.schema, 1), "at", out)
        want |= {i: s is not None and (seen is None or s >= seen - 3600) for i, s in rows}
        seen = max([seen or 0, *(s for _, s in rows if s)])
    got = Counter([(r["id"], True) for r in on_time.collect()] + [(r["id"], False) for r in late.collect()])
    assert got == Counter(want.items()) and 0 < late.count() < on_time.count()


def test_events_by_century_read_their_folders_only(spark, tmp_path):
    from almanac.operators import event_table

    rng = random.Random(2)
    rows = [(k, rng.choice(["comet", "eclipse"]), None if k % 50 == 0 else rng.choice([rng.randrange(-900, 900), 250])) for k in range(600)]
    events, path, old = spark.createDataFrame(rows, "id long, event_type string, year long"), f"file://{tmp_path}/events", event_table.ROWS
    try:
        event_table.ROWS = 50
        event_table.write_by_century(events, path)
    finally:
        event_table.ROWS = old
    stored = event_table.stored_events(spark, path, events.schema)
    assert stored.count() == 600
    for first, last, kind in ((-250, -1, None), (-1, 0, "comet"), (200, 299, "eclipse"), (880, 2000, None), (5, 4, None)):
        found = event_table.in_years(stored, first, last, kind)
        assert {r["id"] for r in found.collect()} == {i for i, t, y in rows if y is not None and first <= y <= last and kind in (None, t)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "century" in plan.split("PartitionFilters: [")[1].split("]")[0] or first > last
