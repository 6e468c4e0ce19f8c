"""Corpus bundles: reading them back, what is wrong with them, and loading them into a store, whole or not at all."""

from __future__ import annotations

import dataclasses
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.registry import query, table
from ..plans.written import shared_dir, written
from .intake import BUNDLE, bundle, lacking, violations
from .store import BUCKETS, Kept, Outcome, Staged, Store


def corpus_tables() -> dict[str, Kept]:
    """The tables of a corpus, with the fields of bundles and the columns that name a row."""
    kinds = {f.name: getattr(f.dataType, "elementType", f.dataType) for f in StructType.fromDDL(BUNDLE)}
    keys = {"sources": ("slug",), "passages": ("source_slug", "reference_label"), "events": ("designation",), "datasets": ("key",)}
    return {name: Kept(kinds["dataset" if name == "datasets" else name], k) for name, k in keys.items()}


@dataclasses.dataclass(frozen=True)
class Load:
    """What came of a load: the problems that it was refused for (a table, empty where it wasn't), and the change."""

    problems: DataFrame
    refused: int
    change: Outcome | None


def corpus_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    """A store of sources, passages, events and datasets."""
    return Store(spark, root, corpus_tables(), buckets)


def load(store: Store, path: str, dry_run: bool = False, lines: bool = False) -> Load:
    """Load the bundles of a path (a JSON object a file, or a line) into a store: all of them, or none where anything is
    wrong with any. Rows replace those of their keys; loading the same bundle again changes nothing that a reader sees. A
    dry run only looks for problems.

    Rows go straight to where the store keeps them, counted by key on the way, and are checked there; only if something is
    wrong are they read again, to say all of it. The files of a refused load are in no version, so nobody reads them."""
    found = bundle(store.spark, path, lines)
    if not dry_run:
        staged = store.stage(found, copies=True)
        if _sound(staged, found["datasets"]):
            return Load(store.spark.createDataFrame([], "part string, name string, problem string"), 0, store.commit(staged))
    parts = {k: written(v) for k, v in found.items()}
    problems = written(violations(parts))
    refused = problems.count()
    if not parts["sources"].take(1):
        problems, refused = store.spark.createDataFrame([("sources", None, "no sources")], problems.schema), max(1, refused)
    return Load(problems, refused, None if refused or dry_run else store.commit(staged))


def _sound(staged: Staged, datasets: DataFrame) -> bool:
    """Whether there are sources, and nothing that violations() would name: every key once, no row that lacks something.
    Datasets may repeat, so all their rows are looked at, not only those that stay."""
    rows = staged.tables | {"datasets": datasets}
    again = [rows[t].where("_copies > 1").select(F.lit(t).alias("part")) for t in ("sources", "passages", "events")]
    return bool(staged.counts["sources"]) and functools.reduce(DataFrame.unionByName, again, lacking(rows).select("part")).count() == 0


@query("a1_corpus_bundles", "SELECT n_name AS dataset, 's' || s_suppkey AS slug, s_name AS title, CAST(-(s_suppkey % 900) AS INT) AS earliest FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as one bundle file for each nation, and read back with the bundles' schema."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    source = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("title"), (-(F.col("s_suppkey") % 900)).cast("int").alias("composition_earliest_year"), F.col("n_name").alias("tradition"))
    rows = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("n_name", "s_nationkey", source.alias("source"))
    files = rows.groupBy("s_nationkey", "n_name").agg(F.to_json(F.struct(F.struct(F.col("n_name").alias("key")).alias("dataset"), F.collect_list("source").alias("sources"))).alias("value"))
    path = f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
    files.select("s_nationkey", "value").write.partitionBy("s_nationkey").text(path)
    found = bundle(spark, f"{path}/*")["sources"]
    return found.select(F.col("tradition").alias("dataset"), "slug", "title", F.col("composition_earliest_year").alias("earliest"))


_PARTS = """s AS (SELECT CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE concat('s', s_suppkey % 90) END AS slug, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE s_name END AS title, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE s_name END AS canonical_citation, 'free' AS license, CAST(s_suppkey % 7 AS INT) AS composition_earliest_year, CAST(s_suppkey % 5 AS INT) AS composition_latest_year FROM supplier),
p AS (SELECT concat('s', l_suppkey % 95) AS source_slug, concat(l_orderkey % 4000, '.', l_linenumber) AS reference_label, CASE WHEN l_partkey % 29 = 0 THEN ' ' ELSE 'x' END AS translation, CASE WHEN l_partkey % 31 > 0 THEN 'own' END AS translation_credit FROM lineitem),
e AS (SELECT concat('e', event_id % 5000) AS designation, event_type, CASE WHEN event_id % 101 > 0 THEN 'an event' END AS label, event_type = 'view' AS is_computed, CASE WHEN user_id % 3 = 0 THEN concat('s', user_id % 100) END AS source_slug FROM events)"""


@query("m11_bundle_violations", f"""WITH {_PARTS}, slugs AS (SELECT DISTINCT slug FROM s WHERE slug IS NOT NULL)
SELECT 'sources' AS part, nullif(title, '') AS name, 'slug missing' AS problem FROM s WHERE slug IS NULL UNION ALL SELECT 'sources', slug, 'title missing' FROM s WHERE title = '' UNION ALL SELECT 'sources', coalesce(slug, nullif(title, '')), 'canonical_citation missing' FROM s WHERE trim(canonical_citation) = ''
UNION ALL SELECT 'sources', slug, 'slug repeated' FROM s WHERE slug IS NOT NULL GROUP BY slug HAVING count(*) > 1 UNION ALL SELECT 'sources', slug, 'earliest after latest' FROM s WHERE composition_earliest_year > composition_latest_year
UNION ALL SELECT 'passages', reference_label, 'translation missing' FROM p WHERE trim(translation) = '' UNION ALL SELECT 'passages', reference_label, 'translation_credit missing' FROM p WHERE translation_credit IS NULL
UNION ALL SELECT 'passages', reference_label, 'label repeated' FROM p GROUP BY source_slug, reference_label HAVING count(*) > 1
UNION ALL SELECT 'passages', reference_label, 'source undefined' FROM p WHERE source_slug NOT IN (SELECT slug FROM slugs) UNION ALL SELECT 'events', designation, 'designation repeated' FROM e GROUP BY designation HAVING count(*) > 1
UNION ALL SELECT 'events', designation, 'label missing' FROM e WHERE label IS NULL
UNION ALL SELECT 'events', designation, 'recorded event without source' FROM e WHERE NOT is_computed AND source_slug IS NULL UNION ALL SELECT 'events', designation, 'source undefined' FROM e WHERE source_slug IS NOT NULL AND source_slug NOT IN (SELECT slug FROM slugs)""")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of these sources, passages and events would be refused for; nothing is loaded (a dry run)."""
    names = {"s": "supplier", "p": "lineitem", "e": "events"}
    parts = {}
    for short, part in (("s", "sources"), ("p", "passages"), ("e", "events")):
        body = _PARTS.split(f"{short} AS (", 1)[1].split(f"FROM {names[short]})", 1)[0]
        parts[part] = spark.sql(f"{body} FROM {{rows}}", rows=table(spark, sf_dir, names[short]))
    return violations(parts)


#: About how many rows a bundle holds at most; what belongs to a dataset is dealt to as many bundles as that takes.
ROWS = 25_000
#: Up to how many suppliers are broadcast to the lines and events that they are looked up for: numbers, some 20 MB.
FEW = 1_000_000


def _bundles(spark: SparkSession, sf_dir: str, revised: bool, most: int = ROWS) -> str:
    """A folder of bundles, one a line: of each nation its suppliers as sources, their lines as passages, and the events of
    users of a supplier's number. Of the revised ones only the suppliers in debt, under other titles, with new events.

    A nation's rows are dealt to bundles by their hash, so that none grows with the tables, whatever a nation holds. They
    move once, as numbers, and become texts only within their bundle; equal rows meet there."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    suppliers = table(spark, sf_dir, "supplier").join(nations, "s_nationkey")
    suppliers = suppliers.where("s_acctbal < 0") if revised else suppliers
    own = suppliers.select("s_nationkey", "s_suppkey")
    own = F.broadcast(own) if own.count() <= FEW else own  # Spark takes the join with nations for large, and would move all lines
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber", "l_partkey").join(own, "s_suppkey")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("s_suppkey"), "event_id", "event_type").join(own, "s_suppkey")
    kinds = {"sources": suppliers.select("s_nationkey", "s_suppkey", "s_name", "n_name"), "passages": line, "events": seen}
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("_kind", F.lit(k)) for k, df in enumerate(kinds.values())))
    n = -(-sum(table(spark, sf_dir, t).count() for t in ("supplier", "lineitem", "events")) // most) or 1
    piece = F.pmod(F.xxhash64("s_suppkey", "_kind", "l_orderkey", "l_linenumber", "event_id", "event_type"), F.lit(n))
    key = ["s_nationkey", "_piece", "_kind", "s_suppkey", "l_orderkey", "l_linenumber", "event_id", "event_type", "s_name", "n_name"]
    once = rows.repartition("s_nationkey", piece).withColumn("_piece", piece).groupBy(*key).agg(F.max("l_partkey").alias("part"), F.count("*").alias("_times"))
    # sorted, for lines of one order side by side pack well
    held = lambda k, *c: F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.struct("s_suppkey", *c))))
    whole = once.groupBy("s_nationkey", "_piece").agg(held(0, "s_name", "n_name", "_times").alias("s"), held(1, "l_orderkey", "l_linenumber", "part").alias("p"), held(2, "event_id", "event_type").alias("e"))
    slug = lambda x: F.concat(F.lit("s"), x["s_suppkey"])
    source = lambda x: F.struct(slug(x).alias("slug"), F.concat(x["s_name"], F.lit(", revised" if revised else "")).alias("title"), x["s_name"].alias("canonical_citation"), F.lit("free").alias("license"), x["n_name"].alias("tradition"))
    passage = lambda x: F.struct(slug(x).alias("source_slug"), F.concat_ws(".", x["l_orderkey"], x["l_linenumber"]).alias("reference_label"), F.concat(F.lit("part "), x["part"]).alias("translation"), F.lit("own").alias("translation_credit"))
    event = lambda x: F.struct(F.concat(F.lit("e"), x["event_id"] + (10**9 if revised else 0)).alias("designation"), x["event_type"].alias("event_type"), F.concat(F.lit("seen by "), slug(x)).alias("label"), slug(x).alias("source_slug"))
    dataset = F.struct(F.concat(F.lit("nation "), "s_nationkey").alias("key"), F.lit("suppliers").alias("name"), F.lit("free").alias("license"))
    # a supplier that occurs twice stays twice, which a load refuses
    sources = F.flatten(F.transform("s", lambda x: F.array_repeat(source(x), x["_times"].cast("int"))))
    path = f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
    lines = whole.select(F.to_json(F.struct(dataset.alias("dataset"), sources.alias("sources"), F.transform("p", passage).alias("passages"), F.transform("e", event).alias("events"))).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return path


_OWN = "s_suppkey, concat('s', s_suppkey) AS slug, s_name, s_acctbal < 0 AS revised, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"


@query("u5_loaded_bundles", f"""WITH s AS (SELECT {_OWN}), e AS (SELECT DISTINCT event_id, event_type, user_id FROM events)
SELECT 'sources' AS part, slug AS name, CASE WHEN revised THEN concat(s_name, ', revised') ELSE s_name END AS content FROM s
UNION ALL SELECT 'passages', concat(slug, ' ', l_orderkey, '.', l_linenumber), concat('part ', max(l_partkey)) FROM s JOIN lineitem ON l_suppkey = s_suppkey GROUP BY slug, l_orderkey, l_linenumber
UNION ALL SELECT 'events', concat('e', event_id), concat('seen by ', slug) FROM s JOIN e ON user_id = s_suppkey
UNION ALL SELECT 'events', concat('e', event_id + 1000000000), concat('seen by ', slug) FROM s JOIN e ON user_id = s_suppkey WHERE revised
UNION ALL SELECT DISTINCT 'datasets', concat('nation ', s_nationkey), 'suppliers' FROM s""")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a load of all bundles and one of the revised ones, whose rows replace those of their keys."""
    store = corpus_store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 8)
    load(store, _bundles(spark, sf_dir, False), lines=True)
    load(store, _bundles(spark, sf_dir, True), lines=True)
    s, p, e, d = (store.read(t) for t in ("sources", "passages", "events", "datasets"))
    show = lambda df, part, name, content: df.select(F.lit(part).alias("part"), name.alias("name"), F.col(content).alias("content"))
    rows = show(s, "sources", F.col("slug"), "title").unionByName(show(p, "passages", F.concat_ws(" ", "source_slug", "reference_label"), "translation"))
    return rows.unionByName(show(e, "events", F.col("designation"), "label")).unionByName(show(d, "datasets", F.col("key"), "name"))
