"""Claims from annotations: what the readers of texts found, as typed rows that meet the claim rules, and timelines."""

from __future__ import annotations

import dataclasses
import functools
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans import views
from ..plans.registry import query, table
from ..plans.written import written
from .annotations import _DATES_SQL, _ENTITIES_OF_FORMS, _MARKERS_OF_FORMS, _NUMBERS_SQL, _PROFILE_SQL, _RESOLVED, EMPIRE_YEARS, SKY_KINDS, annotate, certainty, hebrew_years_sql, resolution, year_of
from .catalogues import FIRST_YEAR, LAST_YEAR, comets
from .claims import coerce, problems
from .joins import range_join
from .lunations import eclipses
from .retrieval import identify_sources

# fixed values: how many findings of a kind become claims, and eclipses and comets of how many years
MOST_NUMBERS, MOST_MARKERS, MOST_YEARS, MOST_ECLIPSES, MOST_COMETS, TIMELINE_ECLIPSES = 12, 10, 3, 6, 4, 8
QUOTED = 2000


_FIELDS = ["turn", "start", "statement", "section", "claim_type", "confidence", "quoted_text", "engine", "n_citations", "n_matched", "produced_by"]


def _claim(stage: str, turn: int, section: str, kind: Column | str, statement: Column, confidence: Column | float, quote: Column | None = None, at: Column | None = None, engine: str | None = None, citations: int | Column = 0) -> Column:
    """A claim as a struct; of several the order is that of turn, start and statement."""
    null = lambda t: F.lit(None).cast(t)
    made = {
        "turn": F.lit(turn), "start": (null("int") if at is None else at).cast("int"), "statement": statement, "section": F.lit(section), "claim_type": F.lit(kind) if isinstance(kind, str) else kind,
        "confidence": F.lit(confidence) if isinstance(confidence, float) else confidence, "quoted_text": null("string") if quote is None else quote, "engine": F.lit(engine).cast("string"),
        "n_citations": citations if isinstance(citations, Column) else F.lit(citations), "n_matched": F.lit(0), "produced_by": F.lit(stage),
    }
    return F.struct(*(made[f].alias(f) for f in _FIELDS))


def _numbered(df: DataFrame, claims: Column) -> DataFrame:
    """A row for each claim of an array, numbered in its order; the rules have passed over all of them."""
    rows = df.select("doc_id", "text_key", F.posexplode(F.array_sort(claims)).alias("_at", "_c"))
    return coerce(rows.select("doc_id", "text_key", *(F.col(f"_c.{f}").alias(f) for f in _FIELDS if f != "turn"), (F.col("_at") + 1).alias("ordering")))


def _texts(docs: DataFrame) -> DataFrame:
    """Texts with text_key, which tells rows of one doc_id or of none apart."""
    return docs.select("doc_id", "text", F.sha2("text", 256).alias("text_key")).where("text is not null")


def _resolved(dates: Column) -> Column:
    """An array of date expressions with what they come to."""
    return F.transform(dates, lambda d: F.struct(d["start"].alias("start"), d["surface"].alias("surface"), *(v.alias(k) for k, v in resolution(d["kind"], d["groups"]).items())))


def _years(dates: Column) -> Column:
    """Array of (start, year) of the years from -3000 to 3000 that dates fall in, each at its first mention."""
    placed = F.transform(F.filter(_resolved(dates), lambda d: d["resolvable"]), lambda d: F.struct(d["start"].alias("start"), year_of(d["calendar"], d["year"]).cast("long").alias("year")))
    placed = F.array_sort(F.filter(placed, lambda d: d["year"].between(-3000, 3000)))
    return F.filter(placed, lambda d, k: ~F.exists(F.slice(placed, 1, k), lambda e: e["year"] == d["year"]))


def named_years(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, year, start: the years that a text's dates fall in, from -3000 to 3000, each at its first
    mention. Rows that agree in doc_id and text are one text."""
    found = annotate(_texts(docs), "dates", keep=["text_key"]).where("size(dates) > 0").select("doc_id", "text_key", F.explode(_years(F.col("dates"))).alias("y"))
    return found.select("doc_id", "text_key", "y.year", "y.start").distinct()


def claims_of_annotations(docs: DataFrame) -> DataFrame:
    """Claims of each text of docs (doc_id, text): the text itself, its language and register, numbers, formulae, dates,
    mentions of the sky, and what its eclipse wording can be worth. All rows pass through the claim rules.

    Null texts have no claims. The claims of a row of docs are numbered in `ordering`, sort by sort and then by place.
    Texts are read once, and nothing is shuffled: a row's claims are made from what its one pass has found.
    """
    quoted = F.substring("text", 1, QUOTED)
    rows = _texts(docs).withColumns({"quoted": quoted, "lang": tx.language(F.col("text"))})
    rows = annotate(rows, keep=["text_key", "quoted", "lang"])
    rows = rows.withColumns({"found": _resolved(F.col("dates")), "terms": F.filter("entities", lambda e: e["kind"].isin(SKY_KINDS))})
    rows = rows.withColumns({"dark": F.exists("terms", lambda e: e["kind"] == "eclipse"), "dated": F.size(_years(F.col("dates"))) > 0})
    said, lang = F.format_string, F.col("lang")
    one = lambda on, claim: F.when(on, F.array(claim)).otherwise(F.slice(F.array(claim), 1, 0))
    each = lambda items, claim: F.transform(items, claim)
    first = lambda name, n: F.slice(F.array_sort(name), 1, n)
    marked = F.slice("numbers", 1, MOST_NUMBERS)
    formulae = first(F.transform("markers", lambda m: F.struct(m["start"].alias("start"), m["marker"].alias("marker"), m["surface"].alias("surface"))), MOST_MARKERS)
    parts = [
        F.array(
            _claim("orchestrator", 0, "original_text", "source_text", F.lit("The text, as it was given."), 1.0, F.col("quoted"), F.lit(0)),
            _claim("language", 1, "detected_language", "textual_analysis", said("The text is written in %s (%s script).", lang["code"], lang["script"]), lang["confidence"]),
        ),
        one(lang["register"].isNotNull(), _claim("language", 2, "detected_language", "textual_analysis", said("Register: %s.", lang["register"]), F.greatest(F.lit(0.3), F.round(lang["confidence"] - 0.1, 3)))),
        each(marked, lambda n: _claim("entities", 3, "key_entities", "source_text", said("The number %s occurs (as “%s”).", n["number"], n["surface"]), 1.0, n["surface"], n["start"])),
        each(marked, lambda n: _claim("entities", 4, "symbolism", "traditional_interpretation", said("%s is a number that traditions mark.", n["number"]), 0.55, None, n["start"])),
        each(formulae, lambda m: _claim("entities", 5, "key_entities", "textual_analysis", said("%s: “%s”.", m["marker"], m["surface"]), 0.85, m["surface"], m["start"])),
        each(F.filter("found", lambda d: ~d["resolvable"]), lambda d: _claim("calendar", 6, "calendar_conversion", "uncertain", said("“%s” can't be placed on a day or year.", d["surface"]), 0.9, d["surface"], d["start"])),
        each(F.filter("found", lambda d: d["resolvable"]), lambda d: _claim("calendar", 7, "calendar_conversion", "astronomical_calculation", said("“%s” is placed by the %s reckoning.", d["surface"], d["calendar"]), certainty(d["calendar"]), d["surface"], d["start"], "calendars")),
        each("terms", lambda e: _claim("astronomy", 8, "astronomical_references", "source_text", said("The text refers to %s (as “%s”).", e["name"], e["surface"]), 0.9, e["surface"], e["start"])),
        one(F.col("dark") & F.col("dated"), _claim("astronomy", 11, "alternative_interpretations", "ai_hypothesis", F.lit("The eclipse wording may go back to an eclipse of a year that the text names."), 0.3)),
        one(F.col("dark") & ~F.col("dated"), _claim("astronomy", 12, "astronomical_references", "uncertain", F.lit("Eclipse wording without a date: no eclipse can be proposed."), 0.85)),
    ]
    return _numbered(rows, F.concat(*parts))


def _ranked(claims: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, claim) as claims numbered within each text."""
    w = Window.partitionBy("doc_id", "text_key").orderBy("claim")
    rows = claims.withColumn("ordering", F.row_number().over(w))
    return coerce(rows.select("doc_id", "text_key", *(F.col(f"claim.{f}").alias(f) for f in _FIELDS if f != "turn"), "ordering"))


def claims_of_sky(docs: DataFrame) -> DataFrame:
    """Claims of what the sky held in the first three years that each text names: eclipses and recorded comets. Rows that
    agree in doc_id and text are one text."""
    found = annotate(_texts(docs), "dates", keep=["text_key"]).where("size(dates) > 0")
    years = found.select("doc_id", "text_key", F.slice(F.transform(_years(F.col("dates")), lambda y: y["year"]), 1, MOST_YEARS).alias("years")).where("size(years) > 0").dropDuplicates(["doc_id", "text_key"])
    spark = docs.sparkSession
    seen = eclipses(spark, FIRST_YEAR, LAST_YEAR).select(F.col("date.year").alias("y"), "body", "kind", "magnitude", "rd", F.concat_ws("-", "date.year", F.lpad("date.month", 2, "0"), F.lpad("date.day", 2, "0")).alias("day"))
    seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy("y").orderBy("rd"))).where(F.col("_n") <= MOST_ECLIPSES)
    tails = range_join(spark.range(FIRST_YEAR, LAST_YEAR + 1).select(F.col("id").alias("y")), F.broadcast(comets(spark)), "y", "comet_year", 3)
    tails = tails.withColumn("_n", F.row_number().over(Window.partitionBy("y").orderBy("comet_year", "designation"))).where(F.col("_n") <= MOST_COMETS)
    kind = F.when(F.col("evidence") == "historical_record", "verified_history").otherwise("astronomical_calculation")
    parts = [
        seen.select("y", _claim("astronomy", 9, "astronomical_references", "astronomical_calculation", F.format_string("%s %s eclipse on %s (magnitude %.2f).", "kind", "body", "day", "magnitude"), 0.9, None, F.col("rd"), "series").alias("claim")),
        tails.select("y", _claim("astronomy", 10, "astronomical_references", kind, F.format_string("%s (%s).", "comet", "designation"), 0.75, None, F.col("comet_year"), "series", 1).alias("claim")),
    ]
    # a few claims for each of six thousand years: they are made once, and broadcast to the few years of each text
    of_year = parts[0].unionByName(parts[1]).groupBy("y").agg(F.collect_list("claim").alias("claims"))
    for k in range(MOST_YEARS):
        years = years.join(F.broadcast(of_year.withColumnsRenamed({"y": f"_y{k}", "claims": f"_c{k}"})), F.get("years", F.lit(k)) == F.col(f"_y{k}"), "left")
    every = F.concat(*(F.coalesce(F.col(f"_c{k}"), F.array().cast(of_year.schema["claims"].dataType)) for k in range(MOST_YEARS)))
    return _numbered(years, every)


def claims_of_sources(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Claims of the works that each row of docs may come from, by place; see identify_sources(). Where the corpus
    (item_id, text) has a dating_note, what is disputed about the date of the closest work is told last, as it decides
    whether a text could have been written before what it tells. Rows that agree in doc_id and text are one text."""
    found = identify_sources(_texts(docs), corpus, keep=["text_key"])
    said = F.when(F.col("item_id").isNull(), "No work of the corpus is close to this text.").when(F.col("identified"), F.format_string("The text corresponds to work %d.", "item_id")).when(F.col("place") == 1, F.format_string("The closest work is %d, not close enough to identify it.", "item_id")).otherwise(F.format_string("Work %d was considered too.", "item_id"))
    cited = F.when(F.col("claim_type") == "scholarly_interpretation", 1).otherwise(0)
    rows = found.select("doc_id", "text_key", _claim("source", 13, "source_identification", F.col("claim_type"), said, F.col("confidence"), None, F.col("place"), None, cited).alias("claim"))
    if "dating_note" in corpus.columns:
        notes = corpus.where("trim(dating_note) <> ''").groupBy(F.col("item_id").alias("work")).agg(F.min("dating_note").alias("note"))
        noted = found.where("place = 1").join(notes, F.col("item_id") == F.col("work"))
        rows = rows.unionByName(noted.select("doc_id", "text_key", _claim("source", 14, "source_identification", "scholarly_interpretation", F.format_string("The date of work %d: %s", "item_id", "note"), 0.8, None, None, None, 1).alias("claim")))
    return _ranked(rows.distinct())


def timeline(docs: DataFrame, sky: bool = True) -> DataFrame:
    """doc_id, year, kind, description, year_end, confidence: the dates that a text names, the first eight eclipses of
    each such year (with sky), and the usual spans of the empires and peoples in it. Of entries that share year and the
    first 80 characters of the description the first kind stays. Rows that agree in doc_id and text are one text."""
    null = F.lit(None).cast("long")
    spans = F.create_map(*[x for name, (a, b) in EMPIRE_YEARS.items() for x in (F.lit(name), F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")))])
    entry = lambda year, kind, description, end, sure: F.struct(year.cast("long").alias("year"), F.lit(kind).alias("kind"), description.alias("description"), end.alias("year_end"), sure.alias("confidence"))
    rows = annotate(_texts(docs), "dates", "entities", keep=["text_key"])
    dated = F.transform(F.filter(_resolved(F.col("dates")), lambda d: d["resolvable"]), lambda d: entry(year_of(d["calendar"], d["year"]), "calendar_conversion", d["surface"], null, certainty(d["calendar"])))
    known = F.filter("entities", lambda e: e["name"].isin(list(EMPIRE_YEARS)))
    known = F.transform(known, lambda e: entry(spans[e["name"]]["a"], "entity_span", F.format_string("%s (%s)", e["name"], e["kind"]), spans[e["name"]]["b"], F.lit(0.5)))
    entry_of = F.concat(F.filter(dated, lambda x: x["year"].isNotNull()), known)
    if sky:
        rows = written(rows.where("size(dates) > 0 or size(entities) > 0").select("doc_id", "text_key", entry_of.alias("entries"), F.transform(_years(F.col("dates")), lambda y: y["year"]).alias("years")))
        entry_of = F.col("entries")
    entries = rows.select("doc_id", "text_key", F.explode(entry_of).alias("x")).select("doc_id", "text_key", "x.*")
    if sky:
        years = rows.select("doc_id", "text_key", F.explode("years").alias("year"))
        seen = eclipses(docs.sparkSession, FIRST_YEAR, LAST_YEAR)
        seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy("date.year").orderBy("rd"))).where(F.col("_n") <= TIMELINE_ECLIPSES)
        seen = seen.select(F.col("date.year").alias("y"), F.format_string("%s %s eclipse, day %d", "kind", "body", "rd").alias("description"))
        # at most eight for each of six thousand years
        entries = entries.unionByName(years.join(F.broadcast(seen), F.col("year") == F.col("y")).select("doc_id", "text_key", "year", F.lit("astronomical_event").alias("kind"), "description", null.alias("year_end"), F.lit(0.9).alias("confidence")))
    first = entries.groupBy("doc_id", "text_key", "year", F.substring("description", 1, 80).alias("_key")).agg(F.min(F.struct("kind", "description", "year_end", "confidence")).alias("x"))
    return first.select("doc_id", "year", "x.*")


#: What is done with texts in each mode, in order. Unknown modes are done as "standard".
MODES: dict[str, list] = {"quick": [claims_of_annotations], "standard": [claims_of_annotations, claims_of_sky]}


def claims_by_mode(docs: DataFrame, mode: str | None = None) -> DataFrame:
    """The claims of all stages of a mode, numbered in order of the stages. MODES may be extended. Rows that agree in
    doc_id and text are numbered together."""
    stages = MODES.get(mode or "standard", MODES["standard"])
    parts = [stage(docs).withColumn("_stage", F.lit(k)) for k, stage in enumerate(stages)]
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.withColumn("ordering", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("_stage", "ordering"))).drop("_stage")


@dataclasses.dataclass(frozen=True)
class StageRun:
    """How a stage went: what it wrote, as counted while it wrote, or why it failed."""

    stage: str
    ordinal: int
    status: str
    claims: int
    evidence: int
    confidence: float | None
    error: str | None


def run_mode(docs: DataFrame, mode: str | None = None, stages: list | None = None) -> tuple[DataFrame, list[StageRun]]:
    """The claims of a mode's stages, and a trace of them.

    Each stage is written before the next begins, and its counts are taken on the way by observe(), so nothing is read
    again for them. A stage that fails leaves no claims, is told of in the trace, and doesn't stop the others. Stages
    may be given in place of the mode's.
    """
    spark, runs, parts = docs.sparkSession, [], []
    for k, stage in enumerate(stages or MODES.get(mode or "standard", MODES["standard"])):
        seen = Observation(f"{stage.__name__}-{uuid.uuid4().hex}")
        grade = F.col("claim_type").isin("source_text", "verified_history", "astronomical_calculation")
        try:
            rows = stage(docs).observe(seen, F.count(F.lit(1)).alias("claims"), F.count_if(grade).alias("evidence"), F.avg("confidence").alias("confidence"))
            parts.append(written(rows).withColumn("_stage", F.lit(k)))
            found = seen.get
            runs.append(StageRun(stage.__name__, k, "completed", found["claims"], found["evidence"], found["confidence"], None))
        except Exception as e:  # noqa: BLE001  whatever a stage fails with belongs in the trace
            runs.append(StageRun(stage.__name__, k, "failed", 0, 0, None, str(e).strip().splitlines()[0][:500]))
    if not parts:
        return claims_of_annotations(docs.limit(0)), runs
    w = Window.partitionBy("doc_id", "text_key").orderBy("_stage", "ordering")
    return functools.reduce(DataFrame.unionByName, parts).withColumn("ordering", F.row_number().over(w)).drop("_stage"), runs


def outcome(runs: list[StageRun]) -> str:
    """completed, partial or failed, of all stages together."""
    failed = sum(r.status == "failed" for r in runs)
    return "completed" if not failed else "failed" if failed == len(runs) else "partial"


def trace_table(spark: SparkSession, runs: list[StageRun]) -> DataFrame:
    rows = [(r.ordinal, r.stage, r.status, r.claims, r.evidence, r.confidence, r.error, outcome(runs)) for r in runs]
    return spark.createDataFrame(rows, "ordinal int, stage string, status string, claims long, evidence long, confidence double, error string, outcome string")


_BEST = "greatest(" + ", ".join(tx.PROFILES) + ")"
_ECLIPSE_FORMS = [f for f, _, _, kind in _ENTITIES_OF_FORMS if kind == "eclipse"]


@query("m5_claims_of_texts", _NUMBERS_SQL + f""", found AS (SELECT * FROM ({_DATES_SQL.split("found AS (", 1)[1][:-1]})){_RESOLVED},
lang AS (SELECT doc_id, CASE WHEN {_BEST} < 2 THEN 0.25 ELSE round(least(0.92, 0.4 + {_BEST} / 10.0 * 2), 3) END::DOUBLE AS c FROM (SELECT doc_id, {_PROFILE_SQL} FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM dated))),
u AS (SELECT doc_id, 'original_text' AS section, 'source_text' AS claim_type, text AS quoted_text, 1.0 AS confidence, 0 AS start FROM dated
UNION ALL SELECT doc_id, 'detected_language', 'textual_analysis', NULL, c, NULL FROM lang
UNION ALL SELECT doc_id, 'detected_language', 'textual_analysis', NULL, greatest(0.3, round(c - 0.1, 3)), NULL FROM lang WHERE doc_id % 12 = 4
UNION ALL SELECT doc_id, 'key_entities', 'source_text', surface, 1.0, start FROM found_numbers
UNION ALL SELECT doc_id, 'symbolism', 'traditional_interpretation', NULL, 0.55, start FROM found_numbers
UNION ALL SELECT doc_id, 'key_entities', 'textual_analysis', surface, 0.85, start FROM ({views.expected(_MARKERS_OF_FORMS, "marker")})
UNION ALL SELECT doc_id, 'calendar_conversion', CASE WHEN resolvable THEN 'astronomical_calculation' ELSE 'uncertain' END, surface, CASE WHEN NOT resolvable THEN 0.9 ELSE CASE calendar WHEN 'maya' THEN 0.75 WHEN 'julian' THEN 0.85 WHEN 'olympiad' THEN 0.6 ELSE 0.7 END END, start FROM r
UNION ALL SELECT doc_id, 'astronomical_references', 'source_text', surface, 0.9, start FROM ({views.expected([r for r in _ENTITIES_OF_FORMS if r[3] in SKY_KINDS], "name, kind")})
UNION ALL SELECT doc_id, 'alternative_interpretations', 'ai_hypothesis', NULL, 0.3, NULL FROM dated WHERE doc_id % 12 IN ({", ".join(map(str, _ECLIPSE_FORMS))}))
SELECT doc_id, section, claim_type, quoted_text, confidence::DOUBLE AS confidence, CAST(start AS INT) AS start, 0 AS problems FROM u""")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = problems(claims_of_annotations(views.dated(spark, sf_dir)))
    return found.select("doc_id", "section", "claim_type", "quoted_text", "confidence", "start", F.size("problems").alias("problems"))


@query("m5_claims_of_documents")
def m5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of whole documents, with those of the sky; SQL can't follow the patterns over arbitrary texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return claims_by_mode(docs).select("doc_id", "ordering", "section", "claim_type", "statement", "confidence", "quoted_text", "start", "engine")


@query("m10_stage_metrics", views.WITH + """, shape AS (SELECT doc_id % 12 AS form, count(*) AS texts FROM dated GROUP BY 1)
SELECT 0 AS ordinal, 'claims_of_annotations' AS stage, 'completed' AS status, sum(texts) > 0 AS any_claims, 'completed' AS outcome FROM shape UNION ALL SELECT 1, 'claims_of_sky', 'completed', sum(texts) FILTER (WHERE form IN (0, 1, 3, 4, 6)) > 0, 'completed' FROM shape""")
def m10_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a run over the dated texts, with whether each stage made claims; tests compare the counts."""
    trace = trace_table(spark, run_mode(views.dated(spark, sf_dir))[1])
    return trace.select("ordinal", "stage", "status", (F.col("claims") > 0).alias("any_claims"), "outcome")


@query("m5_claims_of_sky")
def m5_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed eclipses and comets of the years that texts name; SQL has no series for them."""
    return claims_of_sky(views.dated(spark, sf_dir)).select("doc_id", "ordering", "claim_type", "statement", "confidence", "engine")


_SPANS = [(f, s, name, kind, *EMPIRE_YEARS[name]) for f, s, name, kind in _ENTITIES_OF_FORMS if name in EMPIRE_YEARS]


@query("g1_timeline_of_texts", _DATES_SQL + _RESOLVED + hebrew_years_sql(300, 40000) + f""",
islamic AS (SELECT r.*, 227015 + (year - 1) * 354 + CAST(floor((3 + 11 * year) / 30.0) AS BIGINT) AS rd FROM r WHERE calendar = 'islamic'), hebrew AS (SELECT r.*, a.nisan AS rd FROM r JOIN hn a ON a.y = year WHERE calendar = 'hebrew'),
dated_rows AS (SELECT doc_id, CASE WHEN calendar IN ('islamic', 'hebrew') THEN {views.gregorian_year_sql("rd")} ELSE year END AS year, surface, calendar FROM (SELECT * FROM islamic UNION ALL SELECT * FROM hebrew UNION ALL SELECT r.*, NULL FROM r WHERE calendar IN ('julian', 'olympiad')))
SELECT doc_id, year, 'calendar_conversion' AS kind, surface AS description, NULL::BIGINT AS year_end, CASE calendar WHEN 'julian' THEN 0.85 WHEN 'olympiad' THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM dated_rows
UNION ALL SELECT doc_id, a::BIGINT, 'entity_span', concat(name, ' (', kind, ')'), b::BIGINT, 0.5 FROM ({views.expected(_SPANS, "name, kind, a, b")})""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without eclipses: tests cover them."""
    return timeline(views.dated(spark, sf_dir), sky=False)


@query("g1_timeline_with_sky")
def g1_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(views.dated(spark, sf_dir))
