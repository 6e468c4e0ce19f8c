"""Analyses, claims, requests and dated texts as projections of the given tables, in one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

# fixed values: the claim types, in order
CLAIM_TYPES = [
    "source_text",
    "verified_history",
    "astronomical_calculation",
    "astronomical_dating_candidate",
    "textual_analysis",
    "traditional_interpretation",
    "scholarly_interpretation",
    "ai_hypothesis",
    "uncertain",
]
# fixed values: report sections in order
SECTIONS = [
    "executive_summary", "original_text", "detected_language", "translation", "source_identification", "historical_context",
    "astronomical_references", "dating_candidates", "calendar_conversion", "timeline", "key_entities", "symbolism",
    "traditional_interpretations", "scholarly_views", "alternative_interpretations", "evidence", "confidence_ratings", "references", "further_reading",
]
_SECTION_CASE = "CASE l_partkey % 19 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(SECTIONS)) + " END"
#: Of lines that agree in order, line, part and supplier each has a number of its own; equal lines are interchangeable.
_ROW = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_shipdate, l_quantity)"
_CLAIM_ID = f"concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ROW}) AS claim_id"
_TYPE_CASE = "CASE l_partkey % 9 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(CLAIM_TYPES)) + " END"

ANALYSES = """
SELECT o_orderkey AS analysis_id, o_custkey AS owner_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'partial' END AS status,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS overall_confidence,
       o_orderkey % 5000 AS duration_ms, o_orderkey % 7 = 0 AS is_favorite, o_orderpriority AS title
FROM orders"""

CLAIMS = f"""
SELECT {_CLAIM_ID}, l_orderkey AS analysis_id, l_linenumber AS ordering, {_TYPE_CASE} AS claim_type,
       CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence,
       CASE WHEN l_suppkey % 2 = 1 THEN NULL ELSE 'series' END AS engine,
       CAST(l_suppkey % 3 AS INT) AS n_citations,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'quoted words' END AS quoted_text,
       CASE WHEN l_partkey % 11 = 0 THEN 'this will occur on Friday' ELSE 'the moon was seen' END AS statement,
       CASE l_suppkey % 4 WHEN 0 THEN 'astronomical_dating' WHEN 1 THEN 'source' WHEN 2 THEN 'language' ELSE 'calendar' END AS produced_by,
       CAST(l_quantity AS INT) % 3 AS n_matched, l_shipdate AS shipped_at, l_partkey AS part, l_suppkey AS supp,
       {_SECTION_CASE} AS section, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'it is said so' END AS reasoning,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'read from the text' END AS confidence_basis,
       CASE WHEN l_suppkey % 2 = 1 THEN NULL ELSE 'mean elements' END AS algorithm_reference
FROM lineitem"""

#: Citations of claims: none, one or two for each.
CITATIONS = f"""
SELECT claim_id, analysis_id, ordering, part, k AS place, concat('work ', supp + k) AS citation, (supp + k) % 2 = 0 AS verified
FROM (SELECT {_CLAIM_ID}, l_orderkey AS analysis_id, l_linenumber AS ordering, l_partkey AS part, l_suppkey AS supp FROM lineitem) AS cited {{explode}} WHERE k < supp % 3"""

REQUESTS = "SELECT event_id, user_id AS identity, event_type AS bucket, ts FROM events"

#: Sentences of the dated texts; # is a number from 1 to 900. Together they hold every kind of date expression.
FORMS = [
    "In # BC, in the third year of Cyrus, the moon became as blood and Jupiter and Saturn met in the fishes; 40 days and 666.",
    "In # AD the sun was darkened, and it was dark for two days; the Torah and the gospel tell it.",
    "It lasted # years, and a comet stood over Jerusalem for seven days of darkness.",
    "Anno Domini #, on the 14th day of Nisan, the full moon rose over Babylon.",
    "In A.M. 3#0 and A.H. #, thus saith the Lord: woe unto Nineveh.",
    "Of baktun 9.12.11.5.18 in the long count, the third day of the month, it was spring at the equinox.",
    "In Olympiad #, Mars and Venus stood by Aldebaran in winter; a total eclipse of the sun.",
    "In the 5th year of the reign of Artaxerxes, 40 days after the solstice, stars fell and the dragon rose.",
    "Behold, I will send Mercury, Venus and Mars a third time into Gemini in the last days.",
    "Six hundred threescore and six is the number of the beast; the new moon in autumn, 12 years on.",
    "The oracle of Delphi foretold a guest star in the ram; Christian and Hebrew books speak of it.",
    "On the third day of Nisan, the 14th day of the 7th month, no portent was seen.",
]
DATED = """
SELECT o_orderkey AS doc_id, replace(CASE o_orderkey % 12 """ + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FORMS)) + """ END, '#', CAST(1 + o_orderkey % 900 AS {text})) AS text
FROM orders"""

CITATIONS_SQL = CITATIONS.format(explode="CROSS JOIN (VALUES (0), (1)) AS t(k)")
#: For DuckDB: the views as common table expressions.
WITH = f"WITH analyses AS ({ANALYSES}), claims AS ({CLAIMS}), requests AS ({REQUESTS}), dated AS ({DATED.format(text='VARCHAR')})"


def gregorian_year_sql(rd: str) -> str:
    """DuckDB expression of the Gregorian year that a day number falls in: guessed, then put right by its first day."""
    first = lambda y: f"(365 * ({y} - 1) + CAST(floor(({y} - 1) / 4.0) AS BIGINT) - CAST(floor(({y} - 1) / 100.0) AS BIGINT) + CAST(floor(({y} - 1) / 400.0) AS BIGINT) + 1)"
    guess = f"(CAST(floor(({rd} - 1) / 365.2425) AS BIGINT) + 1)"
    return f"(CASE WHEN {rd} < {first(guess)} THEN {guess} - 1 WHEN {rd} >= {first(f'({guess} + 1)')} THEN {guess} + 1 ELSE {guess} END)"


def expected(rows: list[tuple], columns: str) -> str:
    """A DuckDB query over `dated`: for each text the rows (form, surface, ...) of its sentence form, with the surface's
    first place in the text and num, the text's number."""
    quote = lambda x: "NULL" if x is None else repr(x) if isinstance(x, (int, float)) else f"'{x}'"
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"""SELECT doc_id, text, 1 + doc_id % 900 AS num, CAST(strpos(text, surface) - 1 AS INT) AS start, CAST(strpos(text, surface) - 1 + length(surface) AS INT) AS stop, * EXCLUDE (doc_id, text)
    FROM (SELECT doc_id, text, v.* REPLACE (replace(v.surface, '#', CAST(1 + doc_id % 900 AS VARCHAR)) AS surface) FROM dated JOIN (VALUES {values}) AS v(form, surface, {columns}) ON doc_id % 12 = v.form)"""


def _view(spark: SparkSession, sf_dir: str, source: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", ANALYSES)


def _lines_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over lineitem. Lines are numbered first: beside the number, the texts made of a line would be sent with it."""
    numbered = table(spark, sf_dir, "lineitem").withColumn("_row", F.expr(_ROW))
    return spark.sql(sql.replace(_ROW, "_row").replace("FROM lineitem", "FROM {numbered}"), numbered=numbered)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_view(spark, sf_dir, CLAIMS)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_view(spark, sf_dir, CITATIONS.format(explode="LATERAL VIEW explode(array(0, 1)) t AS k"))


#: What a claim_id is made of; where none of it is null, no other claim has that claim_id.
CLAIM_KEYS = ["analysis_id", "ordering", "part", "supp"]


def cited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the citations that are their own as an array of place, citation and verified."""
    own = "filter(transform(array(0, 1), k -> struct(k AS place, concat('work ', supp + k) AS citation, (supp + k) % 2 = 0 AS verified)), c -> c.place < supp % 3)"
    return claims(spark, sf_dir).withColumn("citations", F.expr(own))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", REQUESTS)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", DATED.format(text="STRING"))
