"""Search for dates whose sky fits what texts tell: criteria of texts, spans of years, candidate days, fit and rank.

Everything that depends on a day alone (which season it lay in, its moon, the comet next to it) is worked out once for
each day of a table; texts that ask for the same thing in the same span are searched once. Planets are not modelled,
so conjunctions count as criteria that can't be searched: they are kept, but stay outside the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendars as cal
from ..plans import views
from ..plans.registry import query, table
from ..plans.written import written
from .annotations import annotate, resolution, year_of
from .calendar_tables import hebrew_years_sql
from .catalogues import FIRST_YEAR, LAST_YEAR, comets
from .claims import CAP
from .joins import range_join
from .lunations import eclipses, phases
from .readers import claims_totality, darkness_days, repetitions, season_word
from .sky_tables import seasons

# fixed values: days within which two events are one occasion, days beyond which they have nothing to do with each
# other, credit at that distance; days for searches to the hour; weights of the criteria
SAME, FAR, FLOOR, HOURS = 15, 180, 0.4, 2
WEIGHTS = {"eclipse": 1.0, "comet": 0.6, "moon_phase": 0.5, "season": 0.25}
#: Matching nothing but these says little: they fit most dates.
WEAK = ["eclipse", "season"]
# fixed values: years searched where a text names none; years around those that it names; most years of a capped search
ERA, AROUND, SPAN = (-800, 200), 200, 500
ECLIPSE_YEARS, PAIR_YEARS = 1200, 2000
TOP = 10


_CRITERIA = ["eclipse", "total", "bodies", "sign", "times", "phase", "comet", "dark_days", "season"]


def searches(docs: DataFrame, cap: int | None = None) -> DataFrame:
    """doc_id with the columns of criteria() and spans(), a row for each row of docs, from one pass over its texts. Spans
    are whole, but for those that a cap is given for."""
    c = F.col("text")
    given = [F.col(n).cast("long") if n in docs.columns else F.lit(None).cast("long") for n in ("given_first", "given_last")]
    read = docs.select("doc_id", "text", claims_totality(c).alias("says_total"), repetitions(c).alias("says_times"), darkness_days(c).alias("dark_days"), season_word(c).alias("season"), *(g.alias(f"given_{k}") for k, g in enumerate(given)))
    rows = annotate(read, "dates", "entities", keep=read.columns[2:])
    any_ = lambda test: F.exists("entities", lambda e: F.coalesce(test(e), F.lit(False)))
    first = lambda field, test: F.get(F.filter("entities", lambda e: F.coalesce(test(e), F.lit(False))), F.lit(0))[field]
    solar, lunar = (any_(lambda e, k=k: e["event"] == f"{k}_eclipse") for k in ("solar", "lunar"))
    bodies = F.array_sort(F.array_distinct(F.transform(F.filter("entities", lambda e: (e["kind"] == "planet") & e["body"].isNotNull()), lambda e: e["body"])))
    found = F.transform("dates", lambda d: F.struct(*(v.alias(k) for k, v in resolution(d["kind"], d["groups"]).items())))
    years = F.filter(F.transform(F.filter(found, lambda d: d["resolvable"]), lambda d: year_of(d["calendar"], d["year"]).cast("long")), lambda y: y.between(FIRST_YEAR, LAST_YEAR))
    rows = rows.withColumns({
        "solar": solar, "lunar": lunar, "met": bodies, "sign": first("name", lambda e: e["kind"] == "zodiac_sign"), "phase": first("phase", lambda e: (e["kind"] == "moon_phase") & e["phase"].isNotNull()),
        "comet": any_(lambda e: e["kind"] == "comet"), "years": years,
    })
    eclipse = F.when(F.col("solar") & F.col("lunar"), "either").when(F.col("solar"), "solar").when(F.col("lunar"), "lunar")
    several, half = F.size("met") >= 2, AROUND if cap is None else min(cap, 2 * AROUND) // 2
    centre = F.when(F.size("years") > 0, F.floor(F.aggregate("years", F.lit(0).cast("long"), lambda s, y: s + y) / F.size("years")).cast("long"))
    asked = F.col("given_0").isNotNull() & F.col("given_1").isNotNull()
    rows = rows.withColumns({
        "low": F.when(asked, F.least("given_0", "given_1")).otherwise(F.coalesce(centre - half, F.lit(ERA[0]))).cast("long"),
        "high": F.when(asked, F.greatest("given_0", "given_1")).otherwise(F.coalesce(centre + half, F.lit(ERA[1]))).cast("long"),
    })
    window = F.struct(F.col("low").alias("first"), F.col("high").alias("last")) if cap is None else covered(F.col("low"), F.col("high"), F.lit(cap))
    return rows.select(
        "doc_id", eclipse.alias("eclipse"), F.when(eclipse.isNotNull(), F.col("says_total")).alias("total"), F.when(several, F.col("met")).alias("bodies"), F.when(several, F.col("sign")).alias("sign"),
        F.when(several, F.col("says_times")).alias("times"), "phase", "comet", "dark_days", "season",
        F.greatest(window["first"], F.lit(FIRST_YEAR)).alias("first"), F.least(window["last"], F.lit(LAST_YEAR)).alias("last"),
    )


def criteria(docs: DataFrame) -> DataFrame:
    """doc_id, eclipse (solar, lunar, either or null), total, bodies, sign, times, phase, comet, dark_days, season: what
    each text of docs (doc_id, text) says of the sky. Texts that say nothing have a row of nulls."""
    return searches(docs).select("doc_id", *_CRITERIA)


def spans(docs: DataFrame, cap: int | None = SPAN) -> DataFrame:
    """doc_id, first, last: the years to search for each text of docs (doc_id, text, and optionally given_first and
    given_last): the given ones, else those around the mean of the years that the text names, else the default era; of
    these at most cap years about their middle (None: all), within those that the series hold for."""
    return searches(docs, cap).select("doc_id", "first", "last")


def covered(first: Column, last: Column, width: Column) -> Column:
    """Struct of the middle `width` years of a span, and whether that is all of it."""
    start = F.floor((first + last) / 2).cast("long") - F.floor(width / 2).cast("long")
    fits = last - first + 1 <= width
    return F.struct(F.when(fits, first).otherwise(start).cast("long").alias("first"), F.when(fits, last).otherwise(start + width - 1).cast("long").alias("last"), fits.alias("complete"))


def coverage(asked: DataFrame, eclipse_years: int = ECLIPSE_YEARS, pair_years: int = PAIR_YEARS) -> DataFrame:
    """asked (eclipse, bodies, first, last) with what a budget of scanned years leaves of each span, as an interactive
    search would have it; candidates() itself scans whole spans."""
    pairs = F.size("bodies") * (F.size("bodies") - 1) / 2
    return asked.withColumns({
        "eclipse_window": F.when(F.col("eclipse").isNotNull(), covered(F.col("first"), F.col("last"), F.lit(eclipse_years))),
        "pair_window": F.when(F.col("bodies").isNotNull(), covered(F.col("first"), F.col("last"), F.greatest(F.floor(pair_years / pairs), F.lit(50)))),
    })


def proximity(days: Column, to_the_hour: bool = False) -> Column:
    """Credit of an event so many days away: whole for one occasion, then falling, then none."""
    off = F.abs(days)
    if to_the_hour:
        return F.when(off <= HOURS, 1 - 0.5 * off / HOURS).otherwise(0.0)
    return F.when(off <= SAME, 1.0).when(off <= FAR, 1 - (1 - FLOOR) * (off - SAME) / (FAR - SAME)).otherwise(0.0)


def sky_days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """day_id, kind (solar, lunar, comet), year, month, day, is_total, phase, season, comet_gap: every day of the years
    that can be a candidate: those with an eclipse, and the first of the year for recorded comets."""
    dark = eclipses(spark, first, last).select(F.xxhash64("lunation", "body").alias("day_id"), F.col("body").alias("kind"), "rd", (F.col("kind") == "total").alias("is_total"))
    seen = comets(spark).where(F.col("comet_year").between(first, last))
    seen = seen.select(F.xxhash64("designation").alias("day_id"), F.lit("comet").alias("kind"), cal.from_gregorian(F.col("comet_year").cast("long"), F.lit(1).cast("long"), F.lit(1).cast("long")).alias("rd"), F.lit(False).alias("is_total"))
    days = dark.unionByName(seen).withColumn("date", cal.to_gregorian(F.col("rd")))
    days = days.select("day_id", "kind", "rd", F.col("date.year").alias("year"), F.col("date.month").alias("month"), F.col("date.day").alias("day"), "is_total", (F.col("rd") - cal.JDN_OFFSET).cast("double").alias("noon"))
    # the moon is new or full by name within 1.5 degrees of it, which it passes in about three hours
    named = phases(spark, first - 1, last + 1).select(F.element_at(F.split("phase", " "), 1).alias("word"), F.col("jd_ut").alias("moon_at"))
    moons = range_join(days.select("day_id", "noon"), named, "noon", "moon_at", 1.5 / 12.19).groupBy("day_id").agg(F.min("word").alias("phase"))
    turns = seasons(spark.range(first, last + 1).select(F.col("id").alias("year"))).groupBy(F.col("year").alias("y")).agg(F.array_sort(F.collect_list("jd_tt")).alias("turns"))
    passed = F.size(F.filter("turns", lambda t: t <= F.col("noon")))
    season = F.element_at(F.array(*map(F.lit, ["winter", "spring", "summer", "autumn", "winter"])), passed + 1)
    gaps = range_join(days.select("day_id", "year"), comets(spark).select("comet_year"), "year", "comet_year", 3).groupBy("day_id").agg(F.min(F.abs(F.col("year") - F.col("comet_year"))).alias("comet_gap"))
    out = days.join(F.broadcast(turns), F.col("year") == F.col("y")).join(moons, "day_id", "left").join(gaps, "day_id", "left")  # a row a year
    return out.select("day_id", "kind", "year", "month", "day", "is_total", "phase", season.alias("season"), F.col("comet_gap").cast("int").alias("comet_gap"))


_NEAR = "struct<off:bigint,at:bigint,eclipse_id:bigint,whole:boolean>"
_ASKED = ["eclipse", "total", "phase", "comet", "season", "dark_days", "bodies", "first", "last"]


def near_eclipses(days: DataFrame) -> DataFrame:
    """day_id, near_solar, near_lunar (days off, is_total) of the days of comets: the nearest eclipse of either body, if
    there is one that can be the same occasion. Ties go to the earlier one."""
    rd = cal.from_gregorian(F.col("year").cast("long"), F.col("month").cast("long"), F.col("day").cast("long"))
    days = days.withColumn("rd", rd)
    # what is nearest depends on the date alone: each date meets each other once, however many days of a table share it
    first = F.min(F.struct(F.col("day_id").alias("eclipse_id"), F.col("is_total").alias("whole"))).alias("first")
    dark = days.where("kind <> 'comet'").groupBy(F.col("kind").alias("body"), F.col("rd").alias("at")).agg(first).select("body", "at", "first.*")
    comet = days.where("kind = 'comet'").select("day_id", F.col("rd").alias("own"))
    pairs = range_join(comet.select(F.col("own").alias("rd")).distinct(), dark, "rd", "at", FAR)
    nearest = F.struct(F.abs(F.col("rd") - F.col("at")).alias("off"), F.col("at"), F.col("eclipse_id"), F.col("whole"))
    near = pairs.groupBy("rd").agg(*(F.min(F.when(F.col("body") == k, nearest)).alias(f"near_{k}") for k in ("solar", "lunar")))
    return comet.join(near, F.col("own") == F.col("rd")).drop("own", "rd")


def foremost(days: DataFrame, alike: list[Column], top: int) -> DataFrame:
    """Of the days of a year that no search can tell apart (equal in all of alike) the first `top`: as they fit equally
    and ties go to the earlier day, no other of them can be among the best `top` of any search."""
    order = Window.partitionBy("year", "kind", "is_total", "moon", "time_of_year", "comet_gap", *alike).orderBy("month", "day", "day_id")
    return days.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


#: Up to how many ranked days are broadcast to the texts that ask for them.
FEW = 100_000


def candidates(asked: DataFrame, days: DataFrame, top: int = TOP) -> DataFrame:
    """The best days of each text: doc_id, place, day_id, kind, year, month, day, fit, matched, unmatched, unsearchable,
    siblings, weak and confidence.

    asked: doc_id with the columns of criteria() and spans(). Days are the eclipses of the wanted kind in the span; a
    comet's days only where there are none, or the text asks for none. An eclipse matches a comet's day by the credit
    of the nearest one. fit is the weight of the matched criteria, each times its strength, over that of all that can be
    searched. Ties go to the earlier day.
    """
    keyed = asked.withColumn("search", F.xxhash64(*_ASKED)).where("eclipse is not null or comet")
    searches = keyed.dropDuplicates(["search"]).select("search", *_ASKED)
    decade = lambda c: F.floor(F.col(c) / 10)
    wide = searches.withColumn("_decade", F.explode(F.sequence(decade("first"), decade("last"))))
    same_day = Window.partitionBy("year", "month", "day")
    all_days = days.withColumn("siblings", F.count("*").over(same_day) - 1).withColumn("_in", decade("year")).withColumnsRenamed({"phase": "moon", "season": "time_of_year"})
    meet = lambda left, right, on: left.join(right, (F.col("_decade") == F.col("_in")) & F.col("year").between(F.col("first"), F.col("last")) & on)
    of_eclipses = meet(wide.where("eclipse is not null"), foremost(all_days.where("kind <> 'comet'"), [], top), F.col("eclipse").isin("either", F.col("kind")))
    of_eclipses = of_eclipses.withColumns({f"near_{k}": F.lit(None).cast(_NEAR) for k in ("solar", "lunar")})
    met = of_eclipses.select(F.col("search").alias("has")).distinct()
    seen = all_days.where("kind = 'comet'").join(near_eclipses(days), "day_id", "left")
    seen = foremost(seen, [x[c] for x in (F.col("near_solar"), F.col("near_lunar"), F.least("near_solar", "near_lunar")) for c in ("off", "whole")], top)
    of_comets = meet(wide.where("comet").join(met, F.col("search") == F.col("has"), "left_anti"), seen, F.lit(True))
    pairs = of_eclipses.unionByName(of_comets)
    closest = F.when(F.col("kind") != "comet", F.struct(F.lit(0).cast("long").alias("off"), F.col("is_total").alias("whole"))).otherwise(
        F.struct(*(F.when(F.col("eclipse") == "solar", F.col(f"near_solar.{c}")).when(F.col("eclipse") == "lunar", F.col(f"near_lunar.{c}")).otherwise(F.least("near_solar", "near_lunar")[c]).alias(c) for c in ("off", "whole")))
    )
    # criterion -> (asked for, strength of the match, 0 if it fails)
    checks = {
        "eclipse": (F.col("eclipse").isNotNull(), F.coalesce(proximity(closest["off"]) * F.when(F.col("total") & ~closest["whole"], 0.7).otherwise(1.0), F.lit(0.0))),
        "moon_phase": (F.col("phase").isNotNull(), F.when(F.col("moon") == F.element_at(F.split("phase", "_"), 1), 1.0).otherwise(0.0)),
        "comet": (F.col("comet"), F.when(F.col("comet_gap").isNotNull(), 1 - 0.15 * F.least(F.col("comet_gap"), F.lit(3))).otherwise(0.0)),
        "season": (F.col("season").isNotNull(), F.when(F.col("season") == F.col("time_of_year"), 1.0).otherwise(0.0)),
    }
    hit = sum((F.when(on, WEIGHTS[c] * strength).otherwise(0.0) for c, (on, strength) in checks.items()), F.lit(0.0))
    total = sum((F.when(on, WEIGHTS[c]).otherwise(0.0) for c, (on, _) in checks.items()), F.lit(0.0))
    names = lambda pick: F.array_compact(F.array(*[F.when(on & pick(strength), F.lit(c)) for c, (on, strength) in checks.items()]))
    outside = F.array_compact(F.array(F.when(F.col("bodies").isNotNull(), "conjunction"), F.when(F.col("dark_days").isNotNull(), "unusual_darkness")))
    scored = pairs.withColumns({"fit": hit / total, "matched": names(lambda s: s > 0), "unmatched": names(lambda s: s <= 0), "unsearchable": outside})
    order = Window.partitionBy("search").orderBy(F.desc("fit"), "year", "month", "day", "day_id")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    weak = (F.size("matched") > 0) & (F.size(F.array_except("matched", F.array(*map(F.lit, WEAK)))) == 0)
    best = best.select("search", "place", "day_id", "kind", "year", "month", "day", "fit", "matched", "unmatched", "unsearchable", "siblings", weak.alias("weak"), (F.col("fit") * CAP).alias("confidence"))
    best = written(best)
    best = F.broadcast(best) if best.count() <= FEW else best
    return keyed.select("doc_id", "search").join(best, "search").drop("search")


def candidate_claims(found: DataFrame) -> DataFrame:
    """Claim rows of candidates(): what a candidate matches, never that the text means that day."""
    said = F.format_string("%d-%02d-%02d is a candidate: its sky matches %d of %d criteria.", "year", "month", "day", F.size("matched"), F.size("matched") + F.size("unmatched") + F.size("unsearchable"))
    return found.select(
        "doc_id", F.col("place").alias("ordering"), F.lit("dating_candidates").alias("section"), F.lit("astronomical_dating_candidate").alias("claim_type"), said.alias("statement"), "confidence",
        F.lit("series").alias("engine"), F.lit(0).alias("n_citations"), F.lit(None).cast("string").alias("quoted_text"), F.size("matched").alias("n_matched"), F.lit("astronomical_dating").alias("produced_by"),
    )


def _asked(spark: SparkSession, sf_dir: str, cap: int | None = None) -> DataFrame:
    return searches(views.dated(spark, sf_dir), cap)


def _asked_once(spark: SparkSession, sf_dir: str, cap: int | None = None) -> DataFrame:
    """Searches of the dated texts, written: they are used several times."""
    return written(_asked(spark, sf_dir, cap))


# the sentences with a Hebrew and an Islamic year have the mean of the years that these begin in
_CRITERIA_SQL = views.WITH + hebrew_years_sql(300, 40000) + f""", two AS (SELECT doc_id, 227015 + (doc_id % 900) * 354 + CAST(floor((14 + 11 * (doc_id % 900)) / 30.0) AS BIGINT) AS rd FROM dated WHERE doc_id % 12 = 4
  UNION ALL SELECT doc_id, nisan FROM dated JOIN hn ON y = CAST(concat('3', 1 + doc_id % 900, '0') AS BIGINT) WHERE doc_id % 12 = 4),
means AS (SELECT doc_id, CAST(floor(sum(year)::DOUBLE / count(*)) AS BIGINT) AS mean FROM (SELECT doc_id, {views.gregorian_year_sql("rd")} AS year FROM two) WHERE year BETWEEN -3000 AND 3000 GROUP BY doc_id)""" + """, criteria AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'lunar' WHEN 1 THEN 'solar' WHEN 6 THEN 'solar' END AS eclipse, CASE doc_id % 12 WHEN 0 THEN false WHEN 1 THEN true WHEN 6 THEN true END AS total,
  CASE doc_id % 12 WHEN 0 THEN 'Jupiter,Saturn' WHEN 6 THEN 'Mars,Venus' WHEN 8 THEN 'Mars,Mercury,Venus' END AS bodies, CASE doc_id % 12 WHEN 0 THEN 'Pisces' WHEN 8 THEN 'Gemini' END AS sign,
  CASE doc_id % 12 WHEN 8 THEN 3 END AS times, CASE doc_id % 12 WHEN 3 THEN 'full' WHEN 9 THEN 'new' END AS phase, doc_id % 12 = 2 AS comet, CASE doc_id % 12 WHEN 1 THEN 2 END AS dark_days,
  CASE doc_id % 12 WHEN 5 THEN 'spring' WHEN 6 THEN 'winter' WHEN 9 THEN 'autumn' END AS season FROM dated),
centres AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN - (doc_id % 900) WHEN 1 THEN 1 + doc_id % 900 WHEN 3 THEN 1 + doc_id % 900 WHEN 6 THEN -775 + (doc_id % 900) * 4 ELSE mean END AS centre FROM dated LEFT JOIN means USING (doc_id)),
spans AS (SELECT doc_id, CASE WHEN centre IS NULL THEN -550 ELSE greatest(centre - 200, -3000) END AS first, CASE WHEN centre IS NULL THEN -51 ELSE least(centre + 200, 3000) END AS last FROM centres)"""


@query("j1_criteria", _CRITERIA_SQL + " SELECT * FROM criteria")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria(views.dated(spark, sf_dir)).withColumn("bodies", F.array_join("bodies", ","))


@query("j2_spans", _CRITERIA_SQL + " SELECT * FROM spans")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(views.dated(spark, sf_dir))


@query("j3_coverage", _CRITERIA_SQL + """
SELECT doc_id, eclipse IS NOT NULL AS eclipses, bodies IS NOT NULL AS pairs, CASE WHEN eclipse IS NULL THEN NULL WHEN last - first + 1 <= 300 THEN first ELSE CAST(floor((first + last) / 2) AS BIGINT) - 150 END AS eclipse_first,
  CASE WHEN bodies IS NULL THEN NULL WHEN last - first + 1 <= w THEN last ELSE CAST(floor((first + last) / 2) AS BIGINT) - w // 2 + w - 1 END AS pair_last
FROM (SELECT *, CASE WHEN doc_id % 12 = 8 THEN 333 ELSE 1000 END AS w FROM criteria JOIN spans USING (doc_id))""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage(_asked(spark, sf_dir, SPAN), 300, 1000)
    return out.select("doc_id", F.col("eclipse").isNotNull().alias("eclipses"), F.col("bodies").isNotNull().alias("pairs"), F.col("eclipse_window.first").alias("eclipse_first"), F.col("pair_window.last").alias("pair_last"))


@query("j5_proximity", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN d <= 15 THEN 1.0 WHEN d <= 180 THEN 1 - 0.6 * (d - 15) / 165 ELSE 0 END, 9)::DOUBLE AS credit, round(CASE WHEN h <= 2 THEN 1 - 0.25 * h ELSE 0 END, 9)::DOUBLE AS to_the_hour
FROM (SELECT l_orderkey, l_linenumber, abs(l_partkey % 400 - 200)::DOUBLE AS d, (l_suppkey % 30)::DOUBLE / 10 AS h FROM lineitem)""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(proximity((F.col("l_partkey") % 400 - 200).cast("double")), 9).alias("credit"), F.round(proximity((F.col("l_suppkey") % 30).cast("double") / 10, to_the_hour=True), 9).alias("to_the_hour"))


_DAYS = """SELECT c_custkey AS day_id, ['solar', 'lunar', 'comet'][c_custkey % 3 + 1] AS kind, c_custkey % 2400 - 1000 AS year, 1 + c_custkey % 12 AS month, 1 + c_nationkey AS day, c_custkey % 5 = 0 AS is_total,
  CASE c_custkey % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'full' END AS phase, ['winter', 'spring', 'summer', 'autumn'][c_custkey % 4 + 1] AS season, CASE WHEN c_custkey % 6 < 4 THEN CAST(c_custkey % 6 AS INT) END AS comet_gap FROM customer"""


def _given_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("day_id"), pick(["solar", "lunar", "comet"], 3).alias("kind"), (k % 2400 - 1000).alias("year"), (1 + k % 12).alias("month"), (1 + F.col("c_nationkey")).alias("day"), (k % 5 == 0).alias("is_total"),
        F.when(k % 7 == 0, "new").when(k % 7 == 1, "full").alias("phase"), pick(["winter", "spring", "summer", "autumn"], 4).alias("season"), F.when(k % 6 < 4, (k % 6).cast("int")).alias("comet_gap"),
    )


@query("j15_candidates", _CRITERIA_SQL + f""", days AS ({_DAYS}), sib AS (SELECT *, count(*) OVER (PARTITION BY year, month, day) - 1 AS siblings FROM days),
pairs AS (SELECT doc_id, day_id, kind, year, month, day, siblings, eclipse, comet, c.season AS wanted, d.season AS got, comet_gap, is_total, coalesce(total, false) AS total
  FROM criteria c JOIN spans USING (doc_id) JOIN sib d ON year BETWEEN first AND last AND CASE WHEN eclipse IS NOT NULL THEN kind = eclipse ELSE comet AND kind = 'comet' END),
scored AS (SELECT *, CASE WHEN eclipse IS NULL THEN 0.0 WHEN total AND NOT is_total THEN 0.7 ELSE 1.0 END::DOUBLE AS e, CASE WHEN comet AND comet_gap IS NOT NULL THEN 1 - 0.15 * comet_gap ELSE 0 END::DOUBLE AS k, CASE WHEN wanted = got THEN 0.25 ELSE 0 END::DOUBLE AS s FROM pairs),
fits AS (SELECT *, (e + 0.6 * k + s) / (CASE WHEN eclipse IS NULL THEN 0 ELSE 1 END + CASE WHEN comet THEN 0.6 ELSE 0 END + CASE WHEN wanted IS NULL THEN 0 ELSE 0.25 END)::DOUBLE AS fit FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(fit, 9) DESC, year, month, day, day_id) AS place FROM fits)
SELECT doc_id, CAST(place AS INT) AS place, day_id, year, month, day, round(fit, 6) AS fit, siblings, k = 0 AND (e > 0 OR s > 0) AS weak, round(fit * 0.55, 6) AS confidence FROM ranked WHERE place <= 10""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates over a table of given days, in spans of at most SPAN years as in the SQL."""
    found = candidates(_asked_once(spark, sf_dir, SPAN), _given_days(spark, sf_dir))
    return found.select("doc_id", "place", "day_id", "year", "month", "day", F.round("fit", 6).alias("fit"), "siblings", "weak", F.round("confidence", 6).alias("confidence"))


@query("j15_candidates_of_eclipses")
def j15_eclipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate claims of the dated texts over the eclipses and comets of all the years that they are searched in."""
    asked = _asked_once(spark, sf_dir)
    low, high = asked.agg(F.min("first"), F.max("last")).first()
    return candidate_claims(candidates(asked, written(sky_days(spark, low if low is not None else 1, high if high is not None else 0))))
