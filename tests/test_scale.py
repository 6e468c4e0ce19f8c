"""Steps whose work or memory must not grow faster than their input."""

import json

from pyspark.sql import functions as F

from almanac.plans.registry import table

DATA = "/root/testdata/sf0.001"


def test_bundles_are_bounded_and_whole(spark):
    from almanac.sources import bundles, intake

    path = bundles._bundles(spark, DATA, False, most=500)
    held = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    sizes = [sum(len(b[p]) for p in ("sources", "passages", "events")) for b in held]
    lines = table(spark, DATA, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    own = table(spark, DATA, "supplier").selectExpr("s_suppkey AS l_suppkey")
    parts = intake.bundle(spark, path, lines=True)
    assert parts["passages"].count() == lines.join(own, "l_suppkey").count() > 3000
    # a nation has more than a thousand rows, a bundle at most about 500
    assert max(sizes) < 600


def test_bundles_are_packed_and_their_rows_move_once(spark, tmp_path):
    from pathlib import Path

    from almanac import plans
    from almanac.sources import bundles

    lines, before = table(spark, DATA, "lineitem").count(), shuffled(spark)
    assert plans.QUERIES["u5_loaded_bundles"](spark, DATA).count() > lines
    # before, 93 bytes a line here and 196 at ten times sf0.1
    assert (shuffled(spark) - before) / lines < 60
    path = bundles._bundles(spark, DATA, False)
    plain = sum(len(r["value"]) for r in spark.read.text(path).collect())
    packed = sum(f.stat().st_size for f in Path(path.removeprefix("file://")).glob("part-*"))
    # before, as many bytes as the texts have
    assert packed < plain / 4


def test_lines_do_not_move_to_meet_few_suppliers(spark):
    from almanac.sources import bundles

    lines, before = table(spark, DATA, "lineitem").count(), shuffled(spark)
    own, few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), bundles.FEW
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with many suppliers, of which Spark only knows a bound
    try:
        path, moved = bundles._bundles(spark, DATA, False), shuffled(spark) - before
        # before, 34 bytes a line
        assert moved / lines < 25
        bundles.FEW = 0
        joined = bundles._bundles(spark, DATA, False)
    finally:
        bundles.FEW = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == sorted(r["value"] for r in spark.read.text(joined).collect())


def test_rows_that_a_store_would_drop_are_checked_too(spark, tmp_path):
    from almanac.sources import bundles

    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(map(json.dumps, lines)))
        return f"file://{tmp_path}/{name}"

    source = {"slug": "s", "title": "t", "canonical_citation": "c", "license": "l"}
    passage = {"source_slug": "s", "reference_label": "1", "translation": "x", "translation_credit": "w"}
    named, bare = {"key": "k", "name": "n", "license": "l"}, {"key": "k", "name": "n"}
    store = bundles.corpus_store(spark, f"file://{tmp_path}/corpus", 4)
    for n in range(6):
        # whichever of the rows of a key would stay
        done = bundles.load(store, put(f"datasets{n}", {"dataset": named | {"name": f"n{n}"}, "sources": [source]}, {"dataset": bare}), lines=True)
        assert [tuple(r) for r in done.problems.collect()] == [("datasets", "k", "license missing")] and done.refused == 1 and done.change is None
    done = bundles.load(store, put("twice", {"dataset": named, "sources": [source], "passages": [passage] * 3}), lines=True)
    assert [tuple(r) for r in done.problems.collect()] == [("passages", "1", "label repeated")] and done.change is None and store.version() == 0
    done = bundles.load(store, put("good", {"dataset": named, "sources": [source], "passages": [passage]}, {"dataset": named}), lines=True)
    assert done.refused == 0 and done.problems.count() == 0 and done.change.rows == {"sources": 1, "passages": 1, "events": 0, "datasets": 1}
    # a row of a store holds what its schema has, not the count of its copies
    assert store.version() == 1 and store.read("passages").columns == store.tables["passages"].schema.names


def test_days_that_no_search_can_tell_apart_are_bounded(spark):
    from almanac.operators import dating

    row = "'solar' AS kind, 100 AS year, 1 AS month, CAST(1 + id % 20 AS INT) AS day, false AS is_total, 'new' AS moon, 'spring' AS time_of_year, CAST(NULL AS INT) AS comet_gap"
    days = spark.range(5000).selectExpr("id AS day_id", *row.split(", "))
    assert sorted(r["day_id"] for r in dating.foremost(days, [], 10).collect()) == list(range(0, 200, 20))


def test_equal_texts_are_read_once_by_a_task(spark):
    from almanac.operators.scanning import annotated

    def read(text):
        import uuid

        return [(text, uuid.uuid4().hex)]

    docs = spark.range(30_000, numPartitions=1).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('text ', id % 5) END AS text")
    rows = annotated(docs, {"found": (read, "said string, made string", None)})
    seen = rows.selectExpr("doc_id", "explode(found) AS f").selectExpr("doc_id", "f.said", "f.made").toPandas()
    assert len(seen) == sum(k % 7 > 0 for k in range(30_000))
    assert (seen["said"] == "text " + (seen["doc_id"] % 5).astype(str)).all()
    # before, each row was read for itself
    assert seen["made"].nunique() == 5


def test_a_join_by_keys_and_range_sends_few_rows_twice(spark):
    from almanac.operators import joins

    left = spark.range(600).selectExpr("id % 3 AS k", "id AS a", "id * 7 % 901 / 2 - 200 AS x")
    right = spark.range(600).selectExpr("id % 3 AS k", "id AS b", "id * 11 % 907 / 2 - 200 AS y")
    pairs = joins.range_join(left, right, "x", "y", 10, ["k"])
    lefts, rights = left.collect(), right.collect()
    near = sorted((p["a"], q["b"]) for p in lefts for q in rights if p["k"] == q["k"] and abs(p["x"] - q["y"]) <= 10)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == near
    low, high = ((q["y"] - 15) // (10 * joins.REACH) for q in rights), ((q["y"] + 15) // (10 * joins.REACH) for q in rights)
    # before, every row of the right side was sent three times
    assert sum(h - a + 1 for a, h in zip(low, high)) < 1.6 * len(rights)


def test_the_state_calls_of_a_run_do_not_grow_with_its_rows():
    from almanac.streaming.stateful import STALE, Sweep

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendList", "put"):
                    self.held = [*(self.held if name == "appendList" else []), *args[0]]
                elif name == "update":
                    self.held = [args[0]]
                elif name == "clear":
                    self.held = []
                return {"exists": bool(self.held), "get": iter(self.held)}.get(name)

            return call

    class Run(State):
        def get(self):
            return self.held[0]

    class Handle:
        getListState = getMapState = lambda self, *a: State()
        getValueState = lambda self, *a: Run()
        registerTimer = lambda self, at: calls.append("timer")

    class Now:
        getCurrentWatermarkInMs = lambda self: 10 * STALE

    sweep = Sweep()
    sweep.init(Handle())
    # the last of a thousand rows stands still; each row comes twice
    rows = [{"at": k, "event_id": k, "status": "running", "attempts": 1, "most": 3} for k in range(1000)] * 2
    assert list(sweep.handleInputRows((7,), iter(rows), None)) == []
    out = list(sweep.handleExpiredTimer((7,), Now(), None))
    assert [(r.job_id, r.at, r.verdict) for r in out] == [(7, 999 + STALE, "retrying")]
    assert len(calls) < 12


def shuffled(spark):
    return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_stored_summaries_move_once_and_without_zeros(spark, tmp_path):
    import numpy as np

    from almanac import plans
    from almanac.operators import lexical, reports

    rows = [(1, "a", "the moon was seen over Babylon"), (2, None, None), (3, "", ""), (4, "d", "the moon was seen"), (4, "d", "the moon was seen")]
    store = reports.summary_store(spark, f"file://{tmp_path}/store", 4)
    assert reports.refresh_summaries(store, spark.createDataFrame(rows, "analysis_id long, title string, summary string")).rows == {"summaries": 4}
    reports.refresh_summaries(store, spark.createDataFrame([(1, "new", "comet"), (None, "n", "x")], "analysis_id long, title string, summary string"))
    got = {r["analysis_id"]: r for r in reports.stored_summaries(store).collect()}
    texts = {1: "new. comet", 2: "", 3: ". ", 4: "d. the moon was seen", None: "n. x"}
    assert {k: r["title"] for k, r in got.items()} == {1: "new", 2: None, 3: "", 4: "d", None: "n"}
    for k, text in texts.items():
        assert np.array_equal(got[k]["vector"], lexical.LexicalVectors().vectors([text])[0])
    # before, every vector was written with its zeros
    assert all(len(r["places"]) == len(r["weights"]) < 40 for r in store.read("summaries").collect())
    orders, before = table(spark, DATA, "orders").count(), shuffled(spark)
    assert plans.QUERIES["e13_stored_summaries"](spark, DATA).count() == orders
    # before, 530 bytes a row at five times sf0.1
    assert (shuffled(spark) - before) / orders < 400


def test_claim_lines_send_narrow_rows_once(spark, tmp_path):
    import duckdb

    from almanac import plans

    lines = table(spark, DATA, "lineitem")
    # without one of its parts, a claim_id may be another claim's
    keys = [(1, None, 2, 5), (1, 2, None, 5), (1, 2, 5, None), (None, 2, 2, 4), (-1, 2, 2, -4)]
    keys = spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    odd = keys.crossJoin(lines.limit(1).drop(*keys.columns)).withColumns({c: F.col(c).cast(lines.schema[c].dataType) for c in keys.columns})
    lines.limit(500).unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    names = ["claim_id", "analysis_id", "ordering", "part", "engine", "citations"]
    got = [tuple(r[n] for n in names) for r in plans.QUERIES["a8_claim_csv"](spark, str(tmp_path)).collect()]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({plans.ORACLE_SQL['a8_claim_csv']})").fetchall()
    assert len(got) == 505 and sorted(map(repr, got)) == sorted(map(repr, want))
    before = shuffled(spark)
    assert plans.QUERIES["a8_claim_csv"](spark, DATA).write.format("noop").mode("overwrite").save() is None
    # before, 252 bytes a row at five times sf0.1
    assert (shuffled(spark) - before) / lines.count() < 100


def test_report_lines_are_dealt_once(spark):
    from almanac.sources.intake import report_text

    claims = [(1, "evidence", 2, "source_text", "b", 0.5), (1, "evidence", 2, "source_text", "b", 0.5), (1, "evidence", 1, "uncertain", None, 0.5), (1, "translation", 1, "uncertain", "t", 0.25), (1, None, 1, "uncertain", "none", 1.0), (2, "odd_one", 1, "uncertain", "o", 1.0)]
    claims = spark.createDataFrame(claims, "analysis_id long, section string, ordering int, claim_type string, statement string, confidence double")
    events = spark.createDataFrame([(1, 7, "e"), (1, None, None), (3, 5, "only")], "analysis_id long, year int, description string")
    trace = spark.createDataFrame([(1, "s", 4)], "analysis_id long, stage string, claims long")
    whole = report_text(claims, events, trace)
    assert {r["analysis_id"]: r["report"].split("\n") for r in whole.collect()} == {
        1: ["**[Uncertain]** none (1.00)", "# Analysis 1", "## Translation", "**[Uncertain]** t (0.25)", "## Evidence", "**[Source text]** b (0.50)", "**[Source text]** b (0.50)", "| Year | Event |", "|---|---|", "| null | null |", "| 7 | e |", "## How this report was produced", "- s (4 claims)"],
        2: ["## Odd One", "# Analysis 2", "**[Uncertain]** o (1.00)"],
        3: ["| Year | Event |", "|---|---|", "| 5 | only |"],
    }
    # before, seven kinds of lines were made by passes of their own, three of them distinct
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + whole._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 3
