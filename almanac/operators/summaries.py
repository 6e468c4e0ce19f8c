"""Aggregates over analyses, claims and logs, first rows, versions and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import views
from ..plans.registry import query, table

# fixed values: weights of claim types in the overall confidence, and which types are evidence
WEIGHTS = {
    "source_text": 1.0,
    "astronomical_calculation": 1.0,
    "verified_history": 1.0,
    "textual_analysis": 0.7,
    "astronomical_dating_candidate": 0.25,
    "scholarly_interpretation": 0.6,
    "traditional_interpretation": 0.3,
    "ai_hypothesis": 0.15,
    "uncertain": 0.1,
}
EVIDENCE = ["source_text", "verified_history", "astronomical_calculation"]


def is_evidence() -> Column:
    return F.col("claim_type").isin(EVIDENCE)


def band(c: Column) -> Column:
    return F.when(c >= 0.85, "very high").when(c >= 0.7, "high").when(c >= 0.5, "moderate").when(c >= 0.3, "low").otherwise("very low")


def confidence(claims: DataFrame, digits: int | None = 3) -> DataFrame:
    """Weighted confidence of each analysis, its band and what it rests on. Sums are decimal, so no order changes them."""
    exact = lambda c: F.sum(c).cast("double")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("claim_type")].cast("decimal(4,2)")
    sums = claims.groupBy("analysis_id").agg(
        (exact(F.col("confidence").cast("decimal(8,6)") * weight) / exact(weight)).alias("raw"),
        F.count_if(is_evidence()).alias("evidence"),
        F.count_if(F.col("claim_type") == "ai_hypothesis").alias("hypotheses"),
        F.count("*").alias("claims"),
    )
    rests_on = F.when(F.col("evidence") == 0, "no evidence").when(F.col("hypotheses") > F.col("evidence"), "mostly conjecture").otherwise("evidence")
    return sums.select("analysis_id", (F.col("raw") if digits is None else F.round("raw", digits)).alias("overall"), band(F.col("raw")).alias("band"), "evidence", "hypotheses", "claims", rests_on.alias("rests_on"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


_WEIGHT_CASE = "CASE claim_type " + " ".join(f"WHEN '{k}' THEN {v}::DECIMAL(4,2)" for k, v in WEIGHTS.items()) + " END"
_EVIDENCE_LIST = ", ".join(f"'{t}'" for t in EVIDENCE)


@query("d1_counts", views.WITH + """
SELECT 'status' AS what, status AS name, count(*) AS n FROM analyses GROUP BY status
UNION ALL SELECT 'claim_type', claim_type, count(*) FROM claims GROUP BY claim_type
UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY event_type
UNION ALL SELECT 'language', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(df: DataFrame, what: str, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")

    parts = [(views.analyses(spark, sf_dir), "status", "status"), (views.claims(spark, sf_dir), "claim_type", "claim_type"), (table(spark, sf_dir, "events"), "event_type", "event_type"), (table(spark, sf_dir, "documents"), "language", "lang")]
    out = one(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(one(*p))
    return out


_FROM, _TO = "1999-01-01", "1999-02-01"


@query("d2_usage_window", views.WITH + f""", w AS (SELECT * FROM analyses WHERE created_at >= TIMESTAMP '{_FROM}' AND created_at < TIMESTAMP '{_TO}'),
first AS (SELECT owner_id, min(created_at) AS since FROM analyses GROUP BY owner_id)
SELECT count(*) AS analyses, count(*) FILTER (WHERE status = 'completed') AS completed, round(avg(duration_ms), 3) AS mean_ms, count(*) FILTER (WHERE is_favorite) AS uploads, count(*) FILTER (WHERE analysis_id % 11 = 0) AS ocr_documents,
       (SELECT count(*) FROM first WHERE since >= TIMESTAMP '{_FROM}' AND since < TIMESTAMP '{_TO}') AS new_users,
       (SELECT round(CAST(count(*) FILTER (WHERE claim_type IN ({_EVIDENCE_LIST})) AS DOUBLE) / count(*), 3) FROM claims JOIN w USING (analysis_id)) AS evidence_ratio
FROM w""")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in a window of days: analyses, uploads and documents read by OCR, users seen first, evidence."""
    a = views.analyses(spark, sf_dir)
    within = lambda c: F.expr(f"{c} >= timestamp_ntz'{_FROM}' and {c} < timestamp_ntz'{_TO}'")
    window = a.where(within("created_at"))
    usage = window.agg(
        F.count("*").alias("analyses"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"),
        F.count_if("is_favorite").alias("uploads"), F.count_if(F.col("analysis_id") % 11 == 0).alias("ocr_documents"),
    )
    users = a.groupBy("owner_id").agg(F.min("created_at").alias("since")).agg(F.count_if(within("since")).alias("new_users"))
    ratio = views.claims(spark, sf_dir).join(window.select("analysis_id"), "analysis_id").agg(F.round(F.count_if(is_evidence()) / F.count("*"), 3).alias("evidence_ratio"))
    return usage.crossJoin(F.broadcast(users)).crossJoin(F.broadcast(ratio))  # one row each


@query("d3_dashboard", views.WITH + """, unread AS (SELECT user_id AS owner_id, count(*) AS unread FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT owner_id, total, favorites, coalesce(unread, 0) AS unread, mean_confidence, newest FROM (
SELECT owner_id, count(*) AS total, count(*) FILTER (WHERE is_favorite) AS favorites, round(avg(overall_confidence), 6) AS mean_confidence,
       array_to_string((array_agg(CAST(analysis_id AS VARCHAR) ORDER BY created_at DESC, analysis_id))[1:5], ',') AS newest
FROM analyses GROUP BY owner_id) LEFT JOIN unread USING (owner_id)""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.analyses(spark, sf_dir)
    newest = a.withColumn("_n", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "analysis_id"))).withColumn("_id", F.when(F.col("_n") <= 5, F.struct("_n", "analysis_id")))
    out = newest.groupBy("owner_id").agg(F.count("*").alias("total"), F.count_if("is_favorite").alias("favorites"), F.round(F.avg("overall_confidence"), 6).alias("mean_confidence"), F.array_sort(F.collect_list("_id")).alias("ids"))
    unread = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("owner_id")).agg(F.count("*").alias("unread"))
    return out.join(unread, "owner_id", "left").select("owner_id", "total", "favorites", F.coalesce("unread", F.lit(0)).alias("unread"), "mean_confidence", F.array_join(F.transform("ids", lambda x: x["analysis_id"].cast("string")), ",").alias("newest"))


@query("d4_stuck_runs", views.WITH + " SELECT count(*) AS stuck FROM analyses WHERE status = 'running' AND created_at < TIMESTAMP '2001-01-01' - INTERVAL 30 MINUTE")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.analyses(spark, sf_dir).agg(F.count_if(F.expr("status = 'running' and created_at < timestamp_ntz'2001-01-01' - interval 30 minutes")).alias("stuck"))


@query("d5_weighted_confidence", views.WITH + f"""
SELECT analysis_id, raw AS overall,
       CASE WHEN raw >= 0.85 THEN 'very high' WHEN raw >= 0.7 THEN 'high' WHEN raw >= 0.5 THEN 'moderate' WHEN raw >= 0.3 THEN 'low' ELSE 'very low' END AS band,
       evidence, hypotheses, claims,
       CASE WHEN evidence = 0 THEN 'no evidence' WHEN hypotheses > evidence THEN 'mostly conjecture' ELSE 'evidence' END AS rests_on
FROM (SELECT analysis_id, sum(CAST(confidence AS DECIMAL(8,6)) * {_WEIGHT_CASE})::DOUBLE / sum({_WEIGHT_CASE})::DOUBLE AS raw, count(*) FILTER (WHERE claim_type IN ({_EVIDENCE_LIST})) AS evidence,
             count(*) FILTER (WHERE claim_type = 'ai_hypothesis') AS hypotheses, count(*) AS claims FROM claims GROUP BY analysis_id)""")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence(views.claims(spark, sf_dir), None)


@query("d6_confidence_by_type", views.WITH + " SELECT analysis_id, claim_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM claims GROUP BY ALL")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.claims(spark, sf_dir).groupBy("analysis_id", "claim_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("d7_claim_breakdown", views.WITH + " SELECT produced_by, " + ", ".join(f"count(*) FILTER (WHERE claim_type = '{t}') AS {t}" for t in views.CLAIM_TYPES) + " FROM claims GROUP BY produced_by")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.claims(spark, sf_dir).groupBy("produced_by").agg(*[F.count_if(F.col("claim_type") == t).alias(t) for t in views.CLAIM_TYPES])


@query("d8_mentions", "SELECT l_orderkey AS doc_id, l_returnflag AS name, l_linestatus AS kind, count(*) AS mentions, round(least(0.95, 0.6 + 0.1 * (count(*) - 1)), 6)::DOUBLE AS confidence FROM lineitem GROUP BY ALL")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("kind")))


def mentions(found: DataFrame) -> DataFrame:
    """Findings (doc_id, name, kind) by entity: the more mentions, the surer, 0.95 at most."""
    return found.groupBy("doc_id", "name", "kind").agg(F.count("*").alias("mentions")).withColumn("confidence", F.round(F.least(F.lit(0.95), 0.6 + 0.1 * (F.col("mentions") - 1)), 6))


@query("d9_quota", """
SELECT c_custkey AS user_id, CAST(count(o_orderkey) AS BIGINT) AS used, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE greatest(0, 5 - count(o_orderkey)) END AS remaining
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5 == 0).alias("paying"))
    return quota(users, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")))


def quota(users: DataFrame, uses: DataFrame, free: int = 5) -> DataFrame:
    """user_id, used, remaining (null: unlimited) for users (user_id, paying)."""
    used = uses.groupBy("user_id").agg(F.count("*").alias("used"))
    n = F.coalesce("used", F.lit(0))
    return users.join(used, "user_id", "left").select("user_id", n.alias("used"), F.when(~F.col("paying"), F.greatest(F.lit(0), free - n)).alias("remaining"))


@query("d10_stage_rollup", """
SELECT l_orderkey AS analysis_id, sum(coalesce(l_partkey, 0))::BIGINT AS tokens,
       CASE WHEN bool_and(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'completed' END AS status
FROM lineitem GROUP BY l_orderkey""")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("l_returnflag") == "R"
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.sum(F.coalesce("l_partkey", F.lit(0))).alias("tokens"), F.bool_and(failed).alias("all"), F.bool_or(failed).alias("any"))
    return sums.select("analysis_id", "tokens", F.when(F.col("all"), "failed").when(F.col("any"), "partial").otherwise("completed").alias("status"))


@query("d11_text_counts", r"SELECT doc_id, length(text) AS char_count, len(regexp_extract_all(text, '[^\s]+')) AS word_count FROM documents")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("char_count"), F.regexp_count("text", F.lit(r"[^\s]+")).cast("long").alias("word_count"))


@query("d12_evidence_audit", views.WITH + f" SELECT analysis_id, concat(CAST(count(*) FILTER (WHERE claim_type IN ({_EVIDENCE_LIST})) AS VARCHAR), ' of ', CAST(count(*) AS VARCHAR), ' claims are evidence') AS line FROM claims GROUP BY analysis_id")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.claims(spark, sf_dir).groupBy("analysis_id").agg(F.concat(F.count_if(is_evidence()).cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(" claims are evidence")).alias("line"))


@query("d14_entities_by_type", """
SELECT doc_id, kind, name, mentions, sum(mentions) OVER (PARTITION BY doc_id, kind)::BIGINT AS group_size,
       CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY mentions DESC, name) AS INT) AS place
FROM (SELECT l_orderkey AS doc_id, l_linestatus AS kind, l_returnflag AS name, count(*) AS mentions FROM lineitem GROUP BY ALL)""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("name")).agg(F.count("*").alias("mentions"))
    w = Window.partitionBy("doc_id", "kind")
    return counts.withColumns({"group_size": F.sum("mentions").over(w), "place": F.row_number().over(w.orderBy(F.desc("mentions"), "name"))})


@query("e1_first_per_key", "SELECT conv_id, role, turn, substr(text, 1, 40) AS head FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn", F.substring("text", 1, 40).alias("head"))


@query("e2_sequence_numbers", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS sequence FROM conversations")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("sequence"))


@query("e11_latest_version", """
SELECT lineage, version, analysis_id, next_version FROM (SELECT o_custkey AS lineage, o_orderkey AS analysis_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version,
  CAST(count(*) OVER (PARTITION BY o_custkey) + 1 AS BIGINT) AS next_version FROM orders) WHERE version = next_version - 1""")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("lineage")).agg(F.count("*").cast("int").alias("version"), newest.alias("analysis_id"), (F.count("*") + 1).alias("next_version"))


@query("m13_claim_vocabulary", views.WITH + f"""
SELECT claim_type, claim_type IN ({_EVIDENCE_LIST}) AS is_evidence, claim_type IN ('verified_history', 'scholarly_interpretation') AS requires_citation, count(*) AS claims
FROM claims GROUP BY claim_type""")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(t, t in EVIDENCE, t in ("verified_history", "scholarly_interpretation")) for t in views.CLAIM_TYPES], "claim_type string, is_evidence boolean, requires_citation boolean")
    return views.claims(spark, sf_dir).groupBy("claim_type").agg(F.count("*").alias("claims")).join(F.broadcast(kinds), "claim_type")  # nine rows
