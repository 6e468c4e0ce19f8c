"""Filtered pages, latest rows, link tables and masking: relational reads, for all owners at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import views
from ..plans.registry import query, table

# fixed values: what a masked claim says, and which types are masked
LOCKED_TEXT = "Available with a subscription."
LOCKED_TYPES = ["astronomical_dating_candidate", "scholarly_interpretation", "traditional_interpretation"]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, *filters: Column) -> DataFrame:
    """Rows offset to offset + limit of df after the filters, in a total order: a top-k, never a full sort to one task."""
    for f in filters:
        df = df.where(f)
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def mask(claims: DataFrame, paying: Column) -> DataFrame:
    """Claims as a reader without a subscription sees them."""
    locked = ~paying & F.col("claim_type").isin(LOCKED_TYPES)
    hide = lambda c, v: F.when(locked, v).otherwise(F.col(c)).alias(c)
    rest = [c for c in claims.columns if c not in ("statement", "quoted_text")]
    return claims.select(*rest, hide("statement", F.lit(LOCKED_TEXT)), hide("quoted_text", F.lit(None)), locked.alias("locked"))


@query("b1_analyses_page", views.WITH + """
SELECT analysis_id, owner_id, title, count(*) OVER () AS total FROM analyses
WHERE status = 'completed' AND is_favorite AND lower(title) LIKE '%high%'
ORDER BY created_at DESC, analysis_id LIMIT 20 OFFSET 10""")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.analyses(spark, sf_dir).where((F.col("status") == "completed") & F.col("is_favorite") & F.col("title").ilike("%high%"))
    total = found.agg(F.count("*").alias("total"))  # one row
    return page(found, [F.desc("created_at"), F.col("analysis_id")], 20, 10).crossJoin(F.broadcast(total)).select("analysis_id", "owner_id", "title", "total")


@query("b2_audit_page", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC, event_id LIMIT 25")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return page(events, [F.desc("ts"), F.col("event_id")], 25, 0, F.col("event_type") == "error", F.col("value") > 10).select("event_id", "user_id", "event_type")


@query("b3_users_page", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%7%' AND c_acctbal > 0 ORDER BY c_custkey DESC LIMIT 30 OFFSET 5")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "customer"), [F.desc("c_custkey")], 30, 5, F.col("c_name").ilike("%7%"), F.col("c_acctbal") > 0).select("c_custkey", "c_name")


@query("b4_jobs_by_status", views.WITH + " SELECT analysis_id, status, duration_ms FROM analyses WHERE status = 'running' ORDER BY created_at DESC, analysis_id LIMIT 50")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(views.analyses(spark, sf_dir), [F.desc("created_at"), F.col("analysis_id")], 50, 0, F.col("status") == "running").select("analysis_id", "status", "duration_ms")


@query("b5_sources_by_tradition", "SELECT s_suppkey, s_name, n_name AS tradition FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 ORDER BY s_name")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("tradition")).orderBy("s_name")


@query("b6_events_by_type_and_years", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    return orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))


@query("b7_source_with_passages", views.WITH + """
SELECT o_orderkey AS source_id, count(l_linenumber) AS passages,
       string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS labels
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("l_linenumber")).alias("of"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("source_id"), F.coalesce("n", F.lit(0)).alias("passages"), F.array_join(F.col("of").cast("array<string>"), ",").alias("labels"))


@query("b8_latest_searches", """
SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INT) AS rank
FROM events WHERE event_type = 'click') WHERE rank <= 5""")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    return latest(clicks, ["user_id"], [F.desc("ts"), F.col("event_id")], 5).select("user_id", "event_id", "rank")


@query("b9_masked_claims", views.WITH + f"""
SELECT analysis_id, ordering, claim_type, CASE WHEN locked THEN '{LOCKED_TEXT}' ELSE statement END AS statement,
       CASE WHEN locked THEN NULL ELSE quoted_text END AS quoted_text, locked
FROM (SELECT *, part % 4 <> 0 AND claim_type IN ({", ".join(f"'{t}'" for t in LOCKED_TYPES)}) AS locked FROM claims)""")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(views.claims(spark, sf_dir), F.col("part") % 4 == 0).select("analysis_id", "ordering", "claim_type", "statement", "quoted_text", "locked")


@query("c1_claims_with_analyses", views.WITH + """
SELECT c.analysis_id, c.ordering, a.status FROM claims c JOIN analyses a USING (analysis_id)
WHERE a.created_at >= TIMESTAMP '2000-01-01'""")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = views.analyses(spark, sf_dir).where("created_at >= timestamp_ntz'2000-01-01'").select("analysis_id", "status")
    return views.claims(spark, sf_dir).select("analysis_id", "ordering").join(recent, "analysis_id")


@query("c2_many_to_many", """
SELECT o_orderkey AS analysis_id, p_partkey AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey WHERE p_size = 7""")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("tag"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").alias("tag"))
    return links.join(tags, "tag").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id")), "analysis_id").select("analysis_id", "tag")


@query("c3_citations_of_claims", """
SELECT o_orderkey AS analysis_id, string_agg(CAST(l_suppkey AS VARCHAR), ' | ' ORDER BY l_linenumber, l_suppkey) AS citations
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("c"))
    joined = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id")).join(cited, "analysis_id", "left")
    return joined.select("analysis_id", F.array_join(F.transform("c", lambda x: x["l_suppkey"].cast("string")), " | ").alias("citations"))


@query("c4_semi_join", views.WITH + " SELECT analysis_id, status FROM analyses WHERE analysis_id IN (SELECT analysis_id FROM claims WHERE confidence > 0.97)")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.analyses(spark, sf_dir).join(views.claims(spark, sf_dir).where("confidence > 0.97"), "analysis_id", "left_semi").select("analysis_id", "status")


@query("c5_anti_join", "SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("c14_merge_extractors", """
WITH a AS (SELECT lower(l_returnflag) || '-' || CAST(l_suppkey AS VARCHAR) AS name, l_linestatus AS kind, min(CAST(l_partkey % 100 AS DOUBLE) / 100) AS c FROM lineitem GROUP BY ALL),
b AS (SELECT lower(l_returnflag) || '-' || CAST(l_partkey AS VARCHAR) AS name, l_linestatus AS kind, max(CAST(l_suppkey % 90 AS DOUBLE) / 100) AS c FROM lineitem GROUP BY ALL)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, a.name IS NOT NULL AND b.name IS NOT NULL AS corroborated,
       round(CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN least(0.98, a.c + 0.1) ELSE coalesce(a.c, b.c) END, 6) AS confidence
FROM a FULL JOIN b ON a.name = b.name AND a.kind = b.kind""")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    key = lambda c: [F.concat(F.lower("l_returnflag"), F.lit("-"), F.col(c)).alias("name"), F.col("l_linestatus").alias("kind")]
    a = line.groupBy(*key("l_suppkey")).agg(F.min((F.col("l_partkey") % 100).cast("double") / 100).alias("confidence"))
    b = line.groupBy(*key("l_partkey")).agg(F.max((F.col("l_suppkey") % 90).cast("double") / 100).alias("confidence"))
    return merge_extractors(a, b).withColumn("confidence", F.round("confidence", 6))


def merge_extractors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities (name, kind, confidence) of two extractors: found by both, 0.1 surer (0.98 at most); else uncorroborated."""
    b = b.withColumnsRenamed({c: f"b_{c}" for c in b.columns})
    both = F.col("name").isNotNull() & F.col("b_name").isNotNull()
    joined = a.join(b, (F.col("name") == F.col("b_name")) & (F.col("kind") == F.col("b_kind")), "full")
    surer = F.when(both, F.least(F.lit(0.98), F.col("confidence") + 0.1)).otherwise(F.coalesce("confidence", "b_confidence"))
    return joined.select(F.coalesce("name", "b_name").alias("name"), F.coalesce("kind", "b_kind").alias("kind"), both.alias("corroborated"), surer.alias("confidence"))
