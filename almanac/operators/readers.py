"""Readers of texts and requests: eclipse totality, days of darkness, season words, era labels, entitlement verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import views
from ..plans.registry import query, table
from .lunations import _years, phases

# fixed values: wording of totality, numbers of days, words of seasons (found anywhere in a text)
TOTALITY = r"(?i)\btotal(?:ly)?\s+(?:eclipse|dark|obscur)|\bblack as sackcloth\b|\bthe sun (?:was|became) (?:wholly |utterly |completely )?(?:black|dark)|\bcomplete darkness\b|\bday (?:became|turned to) night\b"
DARK_DAYS = r"(?i)\b(?:darkness|dark)\b[^.]{0,60}?\b(one|two|three|four|five|\d+)\s+days?\b|\b(one|two|three|four|five|\d+)\s+days?\s+of\s+(?:thick\s+)?darkness\b"
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
SEASON_WORDS = {
    "spring": ["spring", "springtime", "the month of abib", "barley harvest"],
    "summer": ["summer", "summertime", "wheat harvest"],
    "autumn": ["autumn", "fall of the year", "harvest home", "ingathering"],
    "winter": ["winter", "wintertime", "the rainy season"],
}
# fixed values: modes for paying readers only, free searches, years that one search may span
PAID_MODES = ["rectification", "eschatological", "historicizing"]
FREE_SEARCHES, FREE_SPAN, PAID_SPAN = 5, 500, 5000


def claims_totality(text: Column) -> Column:
    return F.coalesce(text.rlike(TOTALITY), F.lit(False))


def darkness_days(text: Column) -> Column:
    """The number of days of darkness that a text tells of first; null if none."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    said = lambda group: F.nullif(F.lower(F.regexp_extract(text, DARK_DAYS, group)), F.lit(""))
    found = F.coalesce(said(1), said(2))
    return F.coalesce(words[found], found.try_cast("int"))


# fixed values: wording of how often something happened
REPETITIONS = [(r"(?i)\b(?:triple|thrice|a third time|three times|third occasion)\b", 3), (r"(?i)\b(?:twice|a second time|two times|again)\b", 2)]


def repetitions(text: Column) -> Column:
    """How many times a text says that something happened; null if it names no number."""
    return F.coalesce(*[F.when(text.rlike(p), n) for p, n in REPETITIONS])


def years_in(text: Column) -> Column:
    """The years with an era that a text names, in astronomical counting, from -3000 to 3000."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(\d{1,4})\s*(?:BCE|BC|CE|AD)\b"), F.lit(0))
    number = lambda x: F.regexp_extract(x, r"^\d+", 0).cast("int")
    years = F.transform(found, lambda x: F.when(x.rlike("(?i)BCE?$"), 1 - number(x)).otherwise(number(x)))
    return F.filter(years, lambda y: y.between(-3000, 3000))


def season_word(text: Column) -> Column:
    """The first season, in the order of the year, one of whose words occurs in the text, within words too."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, words in reversed(SEASON_WORDS.items()):
        hit = low.contains(words[0])
        for w in words[1:]:
            hit |= low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def year_label(year: Column) -> Column:
    """An astronomical year in words: 0 is 1 BCE."""
    return F.when(year <= 0, F.concat((1 - year).cast("string"), F.lit(" BCE"))).otherwise(F.concat(year.cast("string"), F.lit(" CE")))


def entitlement(requests: DataFrame) -> DataFrame:
    """requests (user_id, mode, paying, used, span) with `verdict`, and span cut to what the account may search."""
    verdict = F.when(F.col("user_id").isNull(), "sign in").when(F.col("mode").isin(PAID_MODES) & ~F.col("paying"), "paid only").when(~F.col("paying") & (F.col("used") >= FREE_SEARCHES), "allowance used up").otherwise("ok")
    cap = F.when(F.col("paying"), PAID_SPAN).otherwise(FREE_SPAN)
    return requests.withColumns({"verdict": verdict, "granted_span": F.least(F.col("span"), cap)})


@query("h20_readers", views.WITH + """
SELECT doc_id, doc_id % 12 IN (1, 6) AS totality, CASE doc_id % 12 WHEN 1 THEN 2 END AS days, CASE doc_id % 12 WHEN 5 THEN 'spring' WHEN 6 THEN 'winter' WHEN 9 THEN 'autumn' END AS season,
  CASE doc_id % 12 WHEN 8 THEN 3 END AS times, CASE doc_id % 12 WHEN 0 THEN - (doc_id % 900) WHEN 1 THEN 1 + doc_id % 900 END AS year FROM dated""")
def h20(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return views.dated(spark, sf_dir).select("doc_id", claims_totality(c).alias("totality"), darkness_days(c).alias("days"), season_word(c).alias("season"), repetitions(c).alias("times"), F.get(years_in(c), F.lit(0)).cast("long").alias("year"))


@query("h21_labels", "SELECT o_orderkey, CASE WHEN y <= 0 THEN concat(1 - y, ' BCE') ELSE concat(y, ' CE') END AS label FROM (SELECT o_orderkey, o_orderkey % 4000 - 2000 AS y FROM orders)")
def h21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", year_label(F.col("o_orderkey") % 4000 - 2000).alias("label"))


@query("m14_entitlements", """
WITH u AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, ['date', 'rectification', 'eschatological'][o_orderkey % 3 + 1] AS mode, o_custkey % 5 = 0 AS paying,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS used, o_orderkey % 6000 AS span FROM orders)
SELECT request_id, CASE WHEN mode <> 'date' AND NOT paying THEN 'paid only' WHEN NOT paying AND used >= 5 THEN 'allowance used up' ELSE 'ok' END AS verdict,
  least(span, CASE WHEN paying THEN 5000 ELSE 500 END)::BIGINT AS granted_span FROM u""")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ["date", "rectification", "eschatological"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    used = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), mode.alias("mode"), (F.col("o_custkey") % 5 == 0).alias("paying"), used.alias("used"), (F.col("o_orderkey") % 6000).alias("span"))
    return entitlement(asked).select("request_id", "verdict", "granted_span")


@query("m10_stage_trace", views.WITH + """
SELECT c.analysis_id, c.produced_by AS stage, count(*) AS claims, any_value(a.status) AS status FROM claims c JOIN analyses a USING (analysis_id) GROUP BY c.analysis_id, c.produced_by""")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_stage = views.claims(spark, sf_dir).groupBy("analysis_id", F.col("produced_by").alias("stage")).agg(F.count("*").alias("claims"))
    return per_stage.join(views.analyses(spark, sf_dir).select("analysis_id", "status"), "analysis_id").select("analysis_id", "stage", "claims", "status")


@query("e10_new_moon_gaps")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days from each new moon to the next over the years that orders span, by century so that no window is whole."""
    new = phases(spark, *_years(spark, sf_dir)).where("phase = 'new moon'").withColumn("century", F.floor(F.col("lunation") / 1237))
    return new.select("lunation", (F.lead("jd_tt").over(Window.partitionBy("century").orderBy("lunation")) - F.col("jd_tt")).alias("days"))
