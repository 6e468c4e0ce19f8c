"""Claim rules as a table transform: validation, ordered downgrades, vocabulary checks, report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views
from ..plans.views import SECTIONS
from ..plans.registry import query
from .summaries import confidence, is_evidence

# fixed values: which types need what, the cap, and wording that states the future as settled
NEEDS_CITATION = ["verified_history", "scholarly_interpretation"]
NEEDS_ENGINE = ["astronomical_calculation", "astronomical_dating_candidate"]
CAPPED = ["ai_hypothesis", "astronomical_dating_candidate"]
CAP = 0.55
RESTRICTED_MODES = ["eschatological", "historicizing"]
RESTRICTED_PRODUCERS = ["astronomical_dating", "advanced_dating"]
FORBIDDEN_WHEN_RESTRICTED = ["verified_history", "astronomical_calculation"]
FUTURE = r"(?i)\bwill (?:certainly|definitely|surely) \w+|\bis going to happen\b|\bthe world will end\b|\bwill occur on\b|\bis prophesied to happen in \d{4}\b"

def states_the_future(statement: Column) -> Column:
    return F.coalesce(statement.rlike(FUTURE), F.lit(False))


def problems(claims: DataFrame) -> DataFrame:
    """claims with `problems`: everything that a claim lacks. Columns: claim_type, statement, confidence, n_citations,
    engine, quoted_text, n_matched (criteria shown to match)."""
    kind, conf = F.col("claim_type"), F.col("confidence")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [
        (empty(F.col("statement")), "statement is empty"),
        (~conf.between(0, 1) | conf.isNull(), "confidence outside 0 to 1"),
        (kind.isin(NEEDS_CITATION) & (F.coalesce("n_citations", F.lit(0)) == 0), "citation missing"),
        (kind.isin(NEEDS_ENGINE) & empty(F.col("engine")), "engine missing"),
        ((kind == "source_text") & empty(F.col("quoted_text")), "quotation missing"),
        ((kind == "astronomical_dating_candidate") & (F.coalesce("n_matched", F.lit(0)) == 0), "match evidence missing"),
        (kind.isin(CAPPED) & (conf > CAP), "confidence above the cap"),
        (kind.isin(CAPPED) & states_the_future(F.col("statement")), "states the future as settled"),
    ]
    return claims.withColumn("problems", F.array_compact(F.array(*[F.when(bad, F.lit(said)) for bad, said in checks])))


def coerce(claims: DataFrame, mode: Column | None = None) -> DataFrame:
    """Claims that meet the rules: types lowered and confidence cut in order, each step noted in `adjustments`.

    Every rule sees what the rules before it made of the claim.
    """
    out = claims.withColumn("adjustments", F.array().cast("array<string>"))
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    kind = F.col("claim_type")
    steps: list[tuple[Column, str, str]] = []
    if mode is not None:
        steps.append((mode.isin(RESTRICTED_MODES) & F.col("produced_by").isin(RESTRICTED_PRODUCERS) & kind.isin(FORBIDDEN_WHEN_RESTRICTED), "ai_hypothesis", "restricted mode"))
    steps += [
        (kind.isin(NEEDS_CITATION) & (F.coalesce("n_citations", F.lit(0)) == 0), "ai_hypothesis", "no citation"),
        (kind.isin(NEEDS_ENGINE) & empty("engine"), "ai_hypothesis", "no engine"),
        ((kind == "source_text") & empty("quoted_text"), "textual_analysis", "no quotation"),
        ((kind == "astronomical_dating_candidate") & (F.coalesce("n_matched", F.lit(0)) == 0), "ai_hypothesis", "no match evidence"),
    ]
    for bad, to, why in steps:
        out = out.withColumns({"adjustments": F.when(bad, F.array_append("adjustments", F.concat(kind, F.lit(f" -> {to} ({why})")))).otherwise(F.col("adjustments")), "claim_type": F.when(bad, to).otherwise(kind)})
    over = kind.isin(CAPPED) & (F.col("confidence") > CAP)
    future = kind.isin(CAPPED) & states_the_future(F.col("statement"))
    out = out.withColumns({"adjustments": F.when(over, F.array_append("adjustments", F.lit("confidence cut to the cap"))).otherwise(F.col("adjustments")), "confidence": F.when(over, CAP).otherwise(F.col("confidence"))})
    out = out.withColumns({"adjustments": F.when(future, F.array_append("adjustments", F.concat(kind, F.lit(" -> uncertain (states the future as settled)")))).otherwise(F.col("adjustments")), "claim_type": F.when(future, "uncertain").otherwise(kind)})
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))


def proposed_type(raw: Column, cited: Column) -> Column:
    """The type of a proposal: unknown types, and history or scholarship without a citation, are hypotheses."""
    return F.when(raw.isin(views.CLAIM_TYPES) & ~(raw.isin(NEEDS_CITATION) & ~cited), raw).otherwise("ai_hypothesis")


def allowed(value: Column, known: list[str], default: str = "other") -> Column:
    return F.when(value.isin(known), value).otherwise(default)


def sections(claims: DataFrame, section: Column) -> DataFrame:
    """Every analysis with all report sections in order, the number of claims of each, and why one is empty."""
    names = claims.sparkSession.createDataFrame(list(enumerate(SECTIONS)), "place int, section string")
    counts = claims.groupBy("analysis_id", section.alias("section")).agg(F.count("*").alias("claims"), F.count_if(is_evidence()).alias("evidence"))
    frame = claims.select("analysis_id").distinct().crossJoin(F.broadcast(names))  # nineteen sections
    out = frame.join(counts, ["analysis_id", "section"], "left")
    return out.select("analysis_id", "place", "section", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.when(F.col("claims").isNull(), "nothing was found for this section").alias("empty_reason"))


_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_FUTURE_SQL = "statement LIKE '%will occur on%'"


@query("m1_problems", views.WITH + f"""
SELECT analysis_id, ordering, part, array_to_string(list_filter([
  CASE WHEN claim_type IN {_LIST(NEEDS_CITATION)} AND n_citations = 0 THEN 'citation missing' END,
  CASE WHEN claim_type IN {_LIST(NEEDS_ENGINE)} AND engine IS NULL THEN 'engine missing' END,
  CASE WHEN claim_type = 'source_text' AND quoted_text IS NULL THEN 'quotation missing' END,
  CASE WHEN claim_type = 'astronomical_dating_candidate' AND n_matched = 0 THEN 'match evidence missing' END,
  CASE WHEN claim_type IN {_LIST(CAPPED)} AND confidence > {CAP} THEN 'confidence above the cap' END,
  CASE WHEN claim_type IN {_LIST(CAPPED)} AND {_FUTURE_SQL} THEN 'states the future as settled' END], lambda x: x IS NOT NULL), '; ') AS problems FROM claims""")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems(views.claims(spark, sf_dir)).select("analysis_id", "ordering", "part", F.array_join("problems", "; ").alias("problems"))


def _coerced_sql(first: str = "claim_type") -> str:
    return f""", k0 AS (SELECT *, {first} AS t0 FROM claims),
k1 AS (SELECT *, CASE WHEN t0 IN {_LIST(NEEDS_CITATION)} AND n_citations = 0 THEN 'ai_hypothesis' WHEN t0 IN {_LIST(NEEDS_ENGINE)} AND engine IS NULL THEN 'ai_hypothesis'
  WHEN t0 = 'source_text' AND quoted_text IS NULL THEN 'textual_analysis' WHEN t0 = 'astronomical_dating_candidate' AND n_matched = 0 THEN 'ai_hypothesis' ELSE t0 END AS t1 FROM k0),
k2 AS (SELECT *, CASE WHEN t1 IN {_LIST(CAPPED)} AND confidence > {CAP} THEN {CAP} ELSE confidence END::DOUBLE AS c2, CASE WHEN t1 IN {_LIST(CAPPED)} AND {_FUTURE_SQL} THEN 'uncertain' ELSE t1 END AS t2,
  CAST((t0 <> claim_type) AS INT) + CAST((t1 <> t0) AS INT) + CAST((t1 IN {_LIST(CAPPED)} AND confidence > {CAP}) AS INT) + CAST((t1 IN {_LIST(CAPPED)} AND {_FUTURE_SQL}) AS INT) AS steps FROM k1)"""


@query("m2_coerced", views.WITH + _coerced_sql() + " SELECT analysis_id, ordering, part, t2 AS claim_type, c2 AS confidence, steps FROM k2")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce(views.claims(spark, sf_dir)).select("analysis_id", "ordering", "part", "claim_type", "confidence", F.size("adjustments").alias("steps"))


@query("m3_restricted_mode", views.WITH + _coerced_sql(f"CASE WHEN part % 2 = 0 AND produced_by IN {_LIST(RESTRICTED_PRODUCERS)} AND claim_type IN {_LIST(FORBIDDEN_WHEN_RESTRICTED)} THEN 'ai_hypothesis' ELSE claim_type END") + " SELECT analysis_id, ordering, part, t2 AS claim_type, c2 AS confidence FROM k2")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("part") % 2 == 0, "eschatological").otherwise("open")
    return coerce(views.claims(spark, sf_dir), mode).select("analysis_id", "ordering", "part", "claim_type", "confidence")


@query("m4_proposed_types", views.WITH + f" SELECT analysis_id, ordering, part, CASE WHEN part % 13 = 0 OR (claim_type IN {_LIST(NEEDS_CITATION)} AND n_citations = 0) THEN 'ai_hypothesis' ELSE claim_type END AS claim_type FROM claims")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("part") % 13 == 0, "guess").otherwise(F.col("claim_type"))
    return views.claims(spark, sf_dir).select("analysis_id", "ordering", "part", proposed_type(raw, F.col("n_citations") > 0).alias("claim_type"))


@query("m7_report_sections", views.WITH + f""", s(place, section) AS (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(SECTIONS))}),
c AS (SELECT analysis_id, part % 19 AS place, count(*) AS claims, count(*) FILTER (WHERE claim_type IN ('source_text', 'verified_history', 'astronomical_calculation')) AS evidence FROM claims GROUP BY ALL)
SELECT a.analysis_id, s.place, s.section, coalesce(c.claims, 0) AS claims, coalesce(c.evidence, 0) AS evidence, CASE WHEN c.claims IS NULL THEN 'nothing was found for this section' END AS empty_reason
FROM (SELECT DISTINCT analysis_id FROM claims) a CROSS JOIN s LEFT JOIN c ON c.analysis_id = a.analysis_id AND c.place = s.place""")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("part") % 19 + 1).cast("int"))
    return sections(views.claims(spark, sf_dir), section)


@query("m8_summaries", views.WITH + """
SELECT analysis_id, concat_ws(' ', concat('It holds ', count(*), ' claims.'), CASE WHEN count(*) FILTER (WHERE claim_type = 'ai_hypothesis') > 0 THEN concat(count(*) FILTER (WHERE claim_type = 'ai_hypothesis'), ' are conjecture.') END) AS summary
FROM claims GROUP BY analysis_id""")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = confidence(views.claims(spark, sf_dir))
    return sums.select("analysis_id", F.concat_ws(" ", F.format_string("It holds %d claims.", "claims"), F.when(F.col("hypotheses") > 0, F.format_string("%d are conjecture.", "hypotheses"))).alias("summary"))


@query("m9_references", "SELECT l_orderkey AS analysis_id, l_suppkey AS reference, bool_or(l_returnflag = 'A') AS verified FROM lineitem GROUP BY ALL")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = views.table(spark, sf_dir, "lineitem")
    return cited.groupBy(F.col("l_orderkey").alias("analysis_id"), F.col("l_suppkey").alias("reference")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("verified"))


@query("m12_allowed_kinds", "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'other' END AS kind, substr(props, 1, 300) AS name FROM events")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", allowed(F.col("event_type"), ["view", "click", "purchase"]).alias("kind"), F.substring("props", 1, 300).alias("name"))


@query("h19_future_assertions", views.WITH + f" SELECT analysis_id, ordering, part FROM claims WHERE {_FUTURE_SQL}")
def h19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.claims(spark, sf_dir).where(states_the_future(F.col("statement"))).select("analysis_id", "ordering", "part")
