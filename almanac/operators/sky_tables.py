"""Sky tables: seasons of the years of a table, time scales, signs and separations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import sky
from ..plans.registry import query, table


def seasons(years: DataFrame) -> DataFrame:
    """year, season, jd_tt, jd_ut, rd (UT day) for each year (year long): four rows each, no shuffle."""
    rows = F.array(*[F.struct(F.lit(name).alias("season"), sky.season_jd(F.col("year"), k).alias("jd_tt")) for k, name in enumerate(sky.SEASONS)])
    out = years.select("year", F.explode(rows).alias("x")).select("year", "x.season", "x.jd_tt")
    out = out.withColumn("jd_ut", F.col("jd_tt") - sky.delta_t(F.col("year").cast("double")) / 86400)
    return out.withColumn("rd", F.floor(F.col("jd_ut") + 0.5).cast("long") + cal.JDN_OFFSET)


def _delta_t_sql(y: str) -> str:
    """The same pieces as a DuckDB expression."""

    def poly(origin: float, scale: float, powers: list[float]) -> str:
        return " + ".join(f"({p!r})::DOUBLE * pow(({y} - {origin}) / {scale}.0, {k})" for k, p in enumerate(powers))

    out = "CASE"
    for start, origin, scale, powers in reversed(sky.DELTA_T):
        value = poly(origin, scale, powers)
        if start == 2005:
            value = f"CASE WHEN {y} < 2050 THEN {value} ELSE {poly(1820, 100, [-20, 0, 32])} - 0.5628 * (2150 - {y}) END"
        out += f" WHEN {y} >= {start!r} THEN {value}"
    return out + " END"


def _seasons_sql() -> str:
    """year, season, jd_tt of the years of a relation `years` (year) in DuckDB."""
    poly = lambda x, powers: " + ".join(f"({p!r})::DOUBLE * pow({x}, {k})" for k, p in enumerate(powers))
    mean = " UNION ALL ".join(
        f"SELECT year, '{name}' AS season, CASE WHEN year < 1000 THEN {poly('(year / 1000.0::DOUBLE)', sky.SEASONS_EARLY[k])} ELSE {poly('((year - 2000) / 1000.0::DOUBLE)', sky.SEASONS_LATE[k])} END AS j FROM years" for k, name in enumerate(sky.SEASONS)
    )
    terms = " + ".join(f"{a} * cos(radians({b}::DOUBLE + {c}::DOUBLE * t))" for a, b, c in sky.SEASON_TERMS)
    return f"SELECT year, season, j + 0.00001::DOUBLE * ({terms}) / (1 + 0.0334::DOUBLE * cos(w) + 0.0007::DOUBLE * cos(2 * w)) AS jd_tt FROM (SELECT *, radians(35999.373::DOUBLE * t - 2.47::DOUBLE) AS w FROM (SELECT *, (j - 2451545.0::DOUBLE) / 36525 AS t FROM ({mean})))"


@query("i9_seasons", f"""WITH years AS (SELECT DISTINCT year(o_orderdate) - k AS year FROM orders, (VALUES (0), (2000)) AS t(k)), s AS ({_seasons_sql()}), u AS (SELECT *, jd_tt - ({_delta_t_sql("year")}) / 86400 AS jd_ut FROM s)
SELECT year, season, round(jd_tt, 5) AS jd_tt, round(jd_ut, 5) AS jd_ut, CAST(floor(jd_ut + 0.5) AS BIGINT) - 1721425 AS rd FROM u""")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of the years that orders name, put into antiquity as well as today."""
    y = F.year("o_orderdate").cast("long")
    years = table(spark, sf_dir, "orders").select(F.explode(F.array(y, y - 2000)).alias("year")).distinct()
    return seasons(years).withColumns({"jd_tt": F.round("jd_tt", 5), "jd_ut": F.round("jd_ut", 5)})


_SPREAD = "(o_orderkey % 4200 - 1800 + month(o_orderdate) / 12.0)::DOUBLE"


def _spread() -> Column:
    """Years from 1800 BCE to 2400 CE, so that every piece of the time scale is met."""
    return (F.col("o_orderkey") % 4200 - 1800 + F.month("o_orderdate") / 12).cast("double")


@query("t2_delta_t", f"SELECT o_orderkey, round({_delta_t_sql('y')}, 4) AS delta_t FROM (SELECT o_orderkey, {_SPREAD} AS y FROM orders)")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(sky.delta_t(_spread()), 4).alias("delta_t"))


@query("t1_julian_days", """
SELECT o_orderkey, round(jd, 6) AS jd, rd, round(h, 6) AS hour, round((jd - 2451545.0) / 36525, 9) AS centuries, round(2000 + (jd - 2451545.0) / 365.2425, 6) AS year
FROM (SELECT *, rd + 1721425 - 0.5 + h / 24 AS jd FROM (SELECT o_orderkey, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS rd, (o_orderkey % 96)::DOUBLE / 4 AS h FROM orders))""")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Julian days of an hour of each order's day, and back."""
    jd = sky.jd_of(cal.rd_of_date(F.col("o_orderdate")), (F.col("o_orderkey") % 96).cast("double") / 4)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", jd.alias("jd"))
    # a second is lost below the precision of a double: hours are read from a day rounded to it
    back = sky.day_and_hour(F.round("jd", 6))
    return rows.select("o_orderkey", F.round("jd", 6).alias("jd"), back["rd"].alias("rd"), F.round(F.round(back["hour"] * 4) / 4, 6).alias("hour"), F.round(sky.centuries(F.col("jd")), 9).alias("centuries"), F.round(sky.decimal_year_of(F.col("jd")), 6).alias("year"))


@query("t4_time_scales", f"""
SELECT o_orderkey, round(jd - {_delta_t_sql("y")} / 86400, 7) AS ut, round(jd + {_delta_t_sql("y")} / 86400, 7) AS tt FROM (SELECT o_orderkey, jd, 2000 + (jd - 2451545.0) / 365.2425 AS y FROM (SELECT o_orderkey, (2451545.0 - 1200000 + (o_orderkey * 37) % 1300000)::DOUBLE AS jd FROM orders))""")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    jd = (2451545.0 - 1200000 + (F.col("o_orderkey") * 37) % 1300000).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(sky.tt_to_ut(jd), 7).alias("ut"), F.round(sky.ut_to_tt(jd), 7).alias("tt"))


@query("t5_separations", """
SELECT l_orderkey, l_linenumber, l_partkey, round(degrees(acos(greatest(-1, least(1, sin(radians(b1)) * sin(radians(b2)) + cos(radians(b1)) * cos(radians(b2)) * cos(radians(a1 - a2)))))), 6) AS separation
FROM (SELECT *, (l_partkey % 360)::DOUBLE AS a1, (l_suppkey % 90)::DOUBLE AS b1, (l_suppkey * 7 % 360)::DOUBLE AS a2, (l_partkey % 80)::DOUBLE AS b2 FROM lineitem)""")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = lambda c, n: (c % n).cast("double")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(sky.separation(deg(p, 360), deg(s, 90), deg(s * 7, 360), deg(p, 80)), 6).alias("separation"))


@query("i13_signs", "SELECT l_orderkey, l_linenumber, l_partkey, (" + repr(sky.SIGNS) + ")[CAST((l_partkey % 360) // 30 AS INT) + 1] AS sign FROM lineitem")
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sky.sign(F.col("l_partkey") % 360 - 360).alias("sign"))
