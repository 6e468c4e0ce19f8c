"""Lunar phases and eclipses of a span of years: a spine of lunations, columns, filters. No shuffle but for ordering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import moon, sky
from ..plans.registry import query, table
from .joins import nearest_join


def _spine(spark: SparkSession, first: int, last: int) -> DataFrame:
    lo, hi = math.floor((first - 2000) * 12.3685) - 2, math.ceil((last + 1 - 2000) * 12.3685) + 2
    return spark.range(lo, hi).withColumnRenamed("id", "lunation")


def once(df: DataFrame) -> DataFrame:
    """df with its columns worked out here: a generator keeps Catalyst from copying long series into every use of them."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_x")).select("_x.*")


def _dated(df: DataFrame, first: int, last: int) -> DataFrame:
    """With jd_ut, rd and the Gregorian date of jd_tt; rows of other UT years go."""
    mean_year = 2000 + (F.col("jd_tt") - 2451545.0) / 365.2425
    df = once(df).withColumn("jd_ut", F.col("jd_tt") - sky.delta_t(mean_year) / 86400)
    df = df.withColumn("rd", F.floor(F.col("jd_ut") + 0.5).cast("long") + cal.JDN_OFFSET)
    return once(once(df).withColumn("date", cal.to_gregorian(F.col("rd")))).where(F.col("date.year").between(first, last))


def phases(spark: SparkSession, first: int, last: int) -> DataFrame:
    """lunation, phase, jd_tt, jd_ut, rd, date of every phase in the years first to last."""
    quarters = _spine(spark, first, last).withColumn("quarter", F.explode(F.array(*map(F.lit, range(4))))).withColumn("k", F.col("lunation") + F.col("quarter") / 4)
    a = moon.arguments(F.col("k"))
    with_angles = once(quarters.withColumns(a))
    named = {x: F.col(x) for x in a}
    timed = with_angles.withColumn("jd_tt", F.col("jde") + moon.phase_correction(F.col("quarter"), F.col("k"), named))
    phase = F.element_at(F.array(*map(F.lit, moon.PHASES)), F.col("quarter") + 1)
    return _dated(timed.select("lunation", phase.alias("phase"), "jd_tt"), first, last)


def eclipses(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Every solar and lunar eclipse in the years first to last: body, kind, magnitude, gamma, time.

    Syzygies far from a node are dropped by a cheap test before the series are worked out.
    """
    at = _spine(spark, first, last).withColumn("solar", F.explode(F.array(F.lit(True), F.lit(False))))
    at = at.withColumn("k", F.col("lunation") + F.when(F.col("solar"), 0.0).otherwise(0.5))
    at = at.withColumns(moon.arguments(F.col("k"))).where(F.abs(F.sin(F.radians("f"))) <= 0.36)
    at = once(at.withColumn("f", F.col("f") - 0.02665 * F.sin(F.radians("omega"))))
    a = {x: F.col(x) for x in ("t", "e", "m", "mp", "f", "omega")}
    sin = lambda c: F.sin(F.radians(c))
    solar = F.col("solar")
    main = F.when(solar, -0.4075 * sin("mp") + 0.1721 * F.col("e") * sin("m")).otherwise(-0.4065 * sin("mp") + 0.1727 * F.col("e") * sin("m"))
    a1 = 299.77 + 0.107408 * F.col("k") - 0.009173 * F.col("t") * F.col("t")
    at = at.withColumns({"jd_tt": F.col("jde") + main + moon.series(moon.ECLIPSE, F.sin, a) + 0.0003 * sin(a1), "p": moon.series(moon.P_TERMS, F.sin, a), "q": moon.series(moon.Q_TERMS, F.cos, a), "u": moon.series(moon.U_TERMS, F.cos, a)})
    at = once(at)
    cosf = F.cos(F.radians("f"))
    at = once(at.withColumn("gamma", (F.col("p") * cosf + F.col("q") * sin("f")) * (1 - 0.0048 * F.abs(cosf))))
    g, u = F.abs("gamma"), F.col("u")
    hybrid = u < 0.00464 * F.sqrt(F.greatest(F.lit(0.0), 1 - g * g))
    central = F.when(u < 0, "total").when((u <= 0.0047) & hybrid, "hybrid").otherwise("annular")
    share = (1.5433 + u - g) / (0.5461 + 2 * u)
    umbral, penumbral = (1.0128 - u - g) / 0.5450, (1.5573 + u - g) / 0.5450
    kind = F.when(solar & (g < 0.9972), central).when(solar & (g <= 1.5433 + u) & (share > 0), "partial").when(~solar & (umbral >= 1), "total").when(~solar & (umbral > 0), "partial").when(~solar & (penumbral > 0), "penumbral")
    size = F.when(solar & (g < 0.9972), 1.0).when(solar, share).when(umbral > 0, umbral).otherwise(penumbral)
    found = at.withColumns({"kind": kind, "magnitude": size}).where("kind is not null")
    return _dated(found.select("lunation", F.when(solar, "solar").otherwise("lunar").alias("body"), "kind", "magnitude", "gamma", "jd_tt"), first, last)


def _years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    a, b = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return (a, b) if a is not None else (1, 0)


@query("i7_lunar_phases")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phases in the years that orders span."""
    return phases(spark, *_years(spark, sf_dir)).select("lunation", "phase", "jd_tt", "rd")


@query("i8_eclipses")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eclipses from antiquity to the years that orders span."""
    return eclipses(spark, -600, _years(spark, sf_dir)[1]).select("body", "kind", "magnitude", "gamma", "jd_tt", "rd")


@query("i11_nearest_new_moon")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new moon nearest to each order's date."""
    a, b = _years(spark, sf_dir)
    new = phases(spark, a - 1, b + 1).where("phase = 'new moon'").select("lunation", F.col("rd").cast("double").alias("moon_rd"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", cal.rd_of_date(F.col("o_orderdate")).cast("double").alias("rd"))
    return nearest_join(orders, new, "o_orderkey", "rd", "moon_rd", 16, "lunation").select("o_orderkey", "near.lunation", F.col("near.moon_rd").cast("long").alias("moon_rd"))
