"""Reference tables of the sky (showers, comets, supernovae), what they hold near a date, and the facts of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import sky
from ..plans.registry import query, table
from .joins import nearest_join, range_join
from .lunations import eclipses, phases
from .sky_tables import seasons

# fixed values: meteor showers as (code, name, peak month, peak day, first month, first day, last month, last day, hourly rate, parent body, constellation)
SHOWERS = [
    ("qua", "Quadrantids", 1, 3, 12, 28, 1, 12, 110, "(196256) 2003 EH1", "Boötes"),
    ("lyr", "Lyrids", 4, 22, 4, 14, 4, 30, 18, "C/1861 G1 Thatcher", "Lyra"),
    ("eta", "Eta Aquariids", 5, 6, 4, 19, 5, 28, 50, "1P/Halley", "Aquarius"),
    ("cap", "Alpha Capricornids", 7, 30, 7, 3, 8, 15, 5, "169P/NEAT", "Capricornus"),
    ("sda", "Southern Delta Aquariids", 7, 30, 7, 12, 8, 23, 25, "96P/Machholz", "Aquarius"),
    ("per", "Perseids", 8, 12, 7, 17, 8, 24, 100, "109P/Swift–Tuttle", "Perseus"),
    ("dra", "Draconids", 10, 8, 10, 6, 10, 10, 10, "21P/Giacobini–Zinner", "Draco"),
    ("ori", "Orionids", 10, 21, 10, 2, 11, 7, 20, "1P/Halley", "Orion"),
    ("tau", "Taurids", 11, 5, 9, 10, 11, 20, 5, "2P/Encke", "Taurus"),
    ("leo", "Leonids", 11, 17, 11, 6, 11, 30, 15, "55P/Tempel–Tuttle", "Leo"),
    ("gem", "Geminids", 12, 14, 12, 4, 12, 20, 150, "(3200) Phaethon", "Gemini"),
    ("urs", "Ursids", 12, 22, 12, 17, 12, 26, 10, "8P/Tuttle", "Ursa Minor"),
]

# fixed values: comet apparitions as (designation, name, astronomical year, evidence)
COMETS = [
    ("1P/-239 K1", "Halley's Comet", -239, "both"), ("1P/-163 U1", "Halley's Comet", -163, "both"), ("1P/-86 Q1", "Halley's Comet", -86, "both"), ("1P/-11 Q1", "Halley's Comet", -11, "both"),
    ("1P/66 B1", "Halley's Comet", 66, "both"), ("1P/141 F1", "Halley's Comet", 141, "computed_return"), ("1P/218 H1", "Halley's Comet", 218, "both"), ("1P/295 J1", "Halley's Comet", 295, "both"),
    ("1P/374 E1", "Halley's Comet", 374, "both"), ("1P/451 L1", "Halley's Comet", 451, "both"), ("1P/530 Q1", "Halley's Comet", 530, "both"), ("1P/607 H1", "Halley's Comet", 607, "both"),
    ("1P/684 R1", "Halley's Comet", 684, "both"), ("1P/760 K1", "Halley's Comet", 760, "computed_return"), ("1P/837 F1", "Halley's Comet", 837, "both"), ("1P/912 J1", "Halley's Comet", 912, "both"),
    ("1P/989 N1", "Halley's Comet", 989, "both"), ("1P/1066 G1", "Halley's Comet", 1066, "both"), ("1P/1145 G1", "Halley's Comet", 1145, "both"), ("1P/1222 R1", "Halley's Comet", 1222, "both"),
    ("1P/1301 R1", "Halley's Comet", 1301, "both"), ("1P/1378 S1", "Halley's Comet", 1378, "both"), ("1P/1456 K1", "Halley's Comet", 1456, "both"), ("1P/1531 P1", "Halley's Comet", 1531, "both"),
    ("1P/1607 S1", "Halley's Comet", 1607, "both"), ("1P/1682 Q1", "Halley's Comet", 1682, "both"), ("1P/1758 Y1", "Halley's Comet", 1759, "both"), ("1P/1835 P1", "Halley's Comet", 1835, "both"),
    ("1P/1909 R1", "Halley's Comet", 1910, "both"), ("1P/1982 U1", "Halley's Comet", 1986, "both"), ("C/-43 K1", "Caesar's Comet (Sidus Iulium)", -43, "historical_record"),
    ("C/1P-adjacent 837", "Great Comet of 837", 837, "historical_record"), ("C/1577 V1", "Great Comet of 1577", 1577, "both"), ("C/1811 F1", "Great Comet of 1811", 1811, "both"),
    ("C/1843 D1", "Great March Comet of 1843", 1843, "both"), ("C/1858 L1", "Comet Donati", 1858, "both"),
]

# fixed values: recorded supernovae as (designation, year, constellation)
SUPERNOVAE = [
    ("SN 185", 185, "Circinus/Centaurus"),
    ("SN 386", 386, "Sagittarius"),
    ("SN 1006", 1006, "Lupus"),
    ("SN 1054", 1054, "Taurus"),
    ("SN 1181", 1181, "Cassiopeia"),
    ("SN 1572", 1572, "Cassiopeia"),
    ("SN 1604", 1604, "Ophiuchus"),
]

#: Years that the series of the sky hold for, the widest separation in degrees and the longest window in days.
FIRST_YEAR, LAST_YEAR, WIDEST, LONGEST = -3000, 3000, 30, 3650
NEAR_YEARS = 3


def showers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHOWERS, "code string, shower string, peak_month int, peak_day int, m1 int, d1 int, m2 int, d2 int, hourly_rate int, parent string, constellation string")


def comets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMETS, "designation string, comet string, comet_year int, evidence string")


def supernovae(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUPERNOVAE, "supernova string, nova_year int, constellation string")


def outside_domain(first: Column, last: Column, separation: Column, window: Column) -> Column:
    """Why a search can't be run as asked, or null."""
    year = lambda y: y.between(FIRST_YEAR, LAST_YEAR)
    return (
        F.when(first > last, "the span ends before it begins")
        .when(~(year(first) & year(last)), "years outside -3000 to 3000")
        .when(~((separation > 0) & (separation <= WIDEST)), "separation outside 0 to 30 degrees")
        .when(~((window > 0) & (window <= LONGEST)), "window outside 0 to 3650 days")
    )


def near_dates(dates: DataFrame) -> DataFrame:
    """date_id, what, name, off for dates (date_id, year, month, day): comets and supernovae within three years (off in
    years) and showers active on the day (off from the peak). The reference tables are fixed and are broadcast."""
    spark = dates.sparkSession
    found = range_join(dates, F.broadcast(comets(spark)), "year", "comet_year", NEAR_YEARS).select("date_id", F.lit("comet").alias("what"), F.col("designation").alias("name"), F.abs(F.col("year") - F.col("comet_year")).cast("int").alias("off"))
    novae = range_join(dates, F.broadcast(supernovae(spark)), "year", "nova_year", NEAR_YEARS).select("date_id", F.lit("supernova").alias("what"), F.col("supernova").alias("name"), F.abs(F.col("year") - F.col("nova_year")).cast("int").alias("off"))
    # every day on which a shower is active is a key, so that this is an equality join too
    day = lambda m, d: m * 31 + d - 32
    lo, hi = day(F.col("m1"), F.col("d1")), day(F.col("m2"), F.col("d2"))
    active = showers(spark).withColumn("at", F.explode(F.sequence(lo, F.when(hi < lo, hi + 372).otherwise(hi)))).withColumn("at", F.col("at") % 372)
    off = F.abs(F.col("peak_month") - F.col("month")) * 31 + F.abs(F.col("peak_day") - F.col("day"))
    shown = dates.join(F.broadcast(active), day(F.col("month"), F.col("day")) == F.col("at")).select("date_id", F.lit("shower").alias("what"), F.col("shower").alias("name"), off.cast("int").alias("off"))
    return found.unionByName(novae).unionByName(shown)


# fixed values: seconds that the time of an event may be off, as (from this year on, seconds, more for each year, before
# this year), and for all years before
CLOCK_OFF = [(1955, 0.1, 0.0, 1955), (1600, 2.0, 0.0, 1600), (1000, 20.0, 0.5, 1600), (0, 320.0, 1.2, 1000)]
CLOCK_OFF_LEAST, CLOCK_OFF_FROM, CLOCK_OFF_SQUARE = 600.0, 1820, 0.8 * 32 * 0.25


def time_uncertainty(year: Column) -> Column:
    """Struct of ΔT, its uncertainty in seconds, that of the longitude in degrees, and which of three cases holds."""
    seconds = F.greatest(F.lit(CLOCK_OFF_LEAST), CLOCK_OFF_SQUARE * F.pow((year - CLOCK_OFF_FROM) / 100, F.lit(2)))
    for first, base, more, before in reversed(CLOCK_OFF):
        seconds = F.when(year >= first, base + (before - year) * more if more else F.lit(base)).otherwise(seconds)
    degrees = seconds / 3600 * 15
    case = F.when(seconds < 1, "exact").when(degrees < 1, "under a degree").otherwise("place unsettled")
    return F.struct(sky.delta_t(year).alias("delta_t"), seconds.alias("seconds"), degrees.alias("degrees"), case.alias("note"))


def sky_events(spark: SparkSession, first: int, last: int) -> DataFrame:
    """All phases, eclipses, equinoxes and solstices of the years as rows of one shape: event_type, label, jd_tt, jd_ut,
    rd, year, month, day, hour, magnitude. Generated in parallel from spines of lunations and years."""
    hour = F.pmod(F.col("jd_ut") + 0.5, F.lit(1.0)) * 24
    shape = ["jd_tt", "jd_ut", "rd"]
    moon = phases(spark, first, last).select(F.lit("moon_phase").alias("event_type"), F.col("phase").alias("label"), *shape, "date", F.lit(None).cast("double").alias("magnitude"))
    dark = eclipses(spark, first, last).select(F.concat("body", F.lit("_eclipse")).alias("event_type"), F.col("kind").alias("label"), *shape, "date", "magnitude")
    turns = seasons(spark.range(first, last + 1).select(F.col("id").alias("year"))).select(F.lit("season").alias("event_type"), F.col("season").alias("label"), *shape, cal.to_gregorian(F.col("rd")).alias("date"), F.lit(None).cast("double").alias("magnitude"))
    rows = moon.unionByName(dark).unionByName(turns)
    return rows.select("event_type", "label", *shape, F.col("date.year").alias("year"), F.col("date.month").alias("month"), F.col("date.day").alias("day"), hour.alias("hour"), "magnitude")


def facts_of_dates(dates: DataFrame, first: int, last: int) -> DataFrame:
    """date_id, seasons, eclipses (within 370 days), new_moon, near (catalogue), time (ΔT) for dates (date_id, rd, year,
    month, day) of the years first to last: left joins by date, each branch collected into a short array."""
    spark = dates.sparkSession
    events = sky_events(spark, first - 2, last + 2)
    turns = events.where("event_type = 'season'").groupBy(F.col("year").alias("y")).agg(F.array_sort(F.collect_list("rd")).alias("seasons"))
    dark = events.where("event_type like '%eclipse'").select(F.col("rd").alias("erd"), "event_type", "label")
    close = range_join(dates.select("date_id", "rd"), dark, "rd", "erd", 370).groupBy("date_id").agg(F.array_sort(F.collect_list(F.struct("erd", "event_type", "label"))).alias("eclipses"))
    new = events.where("label = 'new moon'").select(F.col("rd").alias("moon_rd"))
    moon = nearest_join(dates.select("date_id", "rd"), new, "date_id", "rd", "moon_rd", 16, "moon_rd").select("date_id", F.col("near.moon_rd").alias("new_moon"))
    listed = near_dates(dates).groupBy("date_id").agg(F.array_sort(F.collect_list(F.struct("what", "off", "name"))).alias("near"))
    out = dates.join(turns, F.col("year") == F.col("y"), "left").drop("y")
    for branch in (close, moon, listed):
        out = out.join(branch, "date_id", "left")
    return out.withColumn("time", time_uncertainty(F.col("year").cast("double")))


# orders put into antiquity: a date for each of years 1 to 2400, with the order's month and day
_DATES = "SELECT o_orderkey AS date_id, 1 + o_orderkey % 2400 AS year, month(o_orderdate) AS month, day(o_orderdate) AS day FROM orders"


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("date_id"), (1 + F.col("o_orderkey") % 2400).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"))


_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query("b10_catalogue_lookup", f"""WITH dates AS ({_DATES}), c(designation, comet, y, evidence) AS (VALUES {_VALUES(COMETS)}), n(name, y, place) AS (VALUES {_VALUES(SUPERNOVAE)}),
s(code, name, pm, pd, m1, d1, m2, d2, rate, parent, place) AS (VALUES {_VALUES(SHOWERS)})
SELECT date_id, 'comet' AS what, designation AS name, CAST(abs(year - y) AS INT) AS off FROM dates JOIN c ON abs(year - y) <= 3
UNION ALL SELECT date_id, 'supernova', name, CAST(abs(year - y) AS INT) FROM dates JOIN n ON abs(year - y) <= 3
UNION ALL SELECT date_id, 'shower', name, CAST(abs(pm - month) * 31 + abs(pd - day) AS INT) FROM dates JOIN s ON CASE WHEN (m1, d1) <= (m2, d2) THEN (month, day) BETWEEN (m1, d1) AND (m2, d2) ELSE (month, day) >= (m1, d1) OR (month, day) <= (m2, d2) END""")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dates(_dates(spark, sf_dir))


@query("b11_domain_guards", """
SELECT l_orderkey, l_linenumber, CASE WHEN a > b THEN 'the span ends before it begins' WHEN a < -3000 OR b > 3000 OR a > 3000 OR b < -3000 THEN 'years outside -3000 to 3000'
  WHEN NOT (s > 0 AND s <= 30) THEN 'separation outside 0 to 30 degrees' WHEN NOT (w > 0 AND w <= 3650) THEN 'window outside 0 to 3650 days' END AS refused
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 7000 - 3500 AS a, l_partkey % 7000 - 3500 + l_suppkey % 50 - 5 AS b, CAST(l_quantity AS INT) - 10 AS s, l_suppkey % 4000 AS w FROM lineitem)""")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("l_partkey") % 7000 - 3500
    asked = outside_domain(first, first + F.col("l_suppkey") % 50 - 5, F.col("l_quantity").cast("int") - 10, F.col("l_suppkey") % 4000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", asked.alias("refused"))


@query("t3_time_uncertainty", """
SELECT o_orderkey, round(s, 6) AS seconds, round(s / 3600 * 15, 6) AS degrees, CASE WHEN s < 1 THEN 'exact' WHEN s / 3600 * 15 < 1 THEN 'under a degree' ELSE 'place unsettled' END AS note FROM (
  SELECT o_orderkey, CASE WHEN y >= 1955 THEN 0.1 WHEN y >= 1600 THEN 2.0 WHEN y >= 1000 THEN 20 + (1600 - y) * 0.5 WHEN y >= 0 THEN 320 + (1000 - y) * 1.2 ELSE greatest(600, 0.8 * ((y - 1820) / 100) ** 2 * 32 * 0.25) END::DOUBLE AS s
  FROM (SELECT o_orderkey, (o_orderkey % 4000 - 1900)::DOUBLE AS y FROM orders))""")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = time_uncertainty((F.col("o_orderkey") % 4000 - 1900).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", u.alias("u")).select("o_orderkey", F.round("u.seconds", 6).alias("seconds"), F.round("u.degrees", 6).alias("degrees"), "u.note")


@query("c13_facts_of_dates")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sky held around the date of every order; SQL has no series for it, tests check golden values."""
    d = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("date_id"), cal.rd_of_date(d).alias("rd"), F.year(d).cast("long").alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"))
    low, high = rows.agg(F.min("year"), F.max("year")).first()
    return facts_of_dates(rows, low or 1, high or 0)
