"""A written table of events by century: searches by years read the folders of those centuries and no others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import calendars as cal
from ..plans.registry import query, table
from ..plans.written import shared_dir
from .catalogues import sky_events
from .sky_tables import _delta_t_sql, _seasons_sql

#: Rows of a file; a century with more has several.
ROWS = 1_000_000


def century(year: F.Column | str) -> F.Column:
    """0 is the years 0 to 99 in astronomical counting, -1 the hundred before."""
    return F.floor((F.col(year) if isinstance(year, str) else year) / 100).cast("int")


def write_by_century(events: DataFrame, path: str) -> None:
    """Write events (year, ...) to a folder for each century; those without a year go to one of their own.

    Rows are dealt by century and a hash of their columns to about as many tasks as a century needs files, so a century
    that holds most rows is not one task's.
    """
    own = events.withColumn("century", century("year"))
    need = own.groupBy("century").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_files"))
    dealt = own.join(need.withColumnRenamed("century", "_of"), F.col("century").eqNullSafe(F.col("_of"))).drop("_of")
    dealt = dealt.withColumn("_file", F.pmod(F.xxhash64(*events.columns), F.col("_files"))).repartition("century", "_file").sortWithinPartitions("century", "year")
    dealt.drop("_files", "_file").write.partitionBy("century").parquet(path)


def stored_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of write_by_century(), with its century."""
    return spark.read.schema(StructType([*schema.fields, StructField("century", IntegerType())])).parquet(path)


def in_years(stored: DataFrame, first: int, last: int, event_type: str | None = None) -> DataFrame:
    """Stored events of the years first to last, of one type where it is given: only their centuries' folders are read."""
    rows = stored.where(F.col("century").between(first // 100, last // 100) & F.col("year").between(first, last))
    return (rows if event_type is None else rows.where(F.col("event_type") == event_type)).drop("century")


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"


@query("b6_stored_events", """
SELECT o_orderkey AS designation, o_orderpriority AS event_type, o_orderkey % 4000 - 1900 AS year, month(o_orderdate) AS month FROM orders
WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 4000 - 1900 BETWEEN -740 AND 130""")
def b6_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recorded events of four thousand years, stored by century and searched by type and years."""
    recorded = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("designation"), F.col("o_orderpriority").alias("event_type"), (F.col("o_orderkey") % 4000 - 1900).alias("year"), F.month("o_orderdate").alias("month"))
    path = _path(spark)
    write_by_century(recorded, path)
    return in_years(stored_events(spark, path, recorded.schema), -740, 130, "2-HIGH")


@query("i12_stored_seasons", f"""WITH years AS (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders), s AS ({_seasons_sql()}), u AS (SELECT *, jd_tt - ({_delta_t_sql("year")}) / 86400 AS jd_ut FROM s)
SELECT season AS label, round(jd_tt, 5) AS jd_tt, round(jd_ut, 5) AS jd_ut, CAST(floor(jd_ut + 0.5) AS BIGINT) - 1721425 AS rd, year FROM u WHERE year % 100 >= 90""")
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases, eclipses and seasons of the years that orders span, stored by century; of them the seasons of the last ten
    years of each century."""
    y = F.year("o_orderdate").cast("long")
    low, high = table(spark, sf_dir, "orders").agg(F.min(y), F.max(y)).first()
    events = sky_events(spark, low if low is not None else 1, high if high is not None else 0)
    path = _path(spark)
    write_by_century(events, path)
    found = in_years(stored_events(spark, path, events.schema), low or 1, high or 0, "season").where(F.pmod("year", F.lit(100)) >= 90)
    return found.select("label", F.round("jd_tt", 5).alias("jd_tt"), F.round("jd_ut", 5).alias("jd_ut"), "rd", "year")


@query("k18_stored_days", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT date_diff('day', DATE '0001-01-01', d) + 1 AS rd, d FROM d)
SELECT rd, year(d)::BIGINT AS year, month(d)::BIGINT AS month, day(d)::BIGINT AS day, dayname(d) AS weekday FROM r WHERE year(d) BETWEEN 1996 AND 1999""")
def k18_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of orders with their calendars, stored by century; those of four years."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().select(cal.rd_of_date(F.col("d")).alias("rd"))
    rows = days.withColumn("g", cal.to_gregorian(F.col("rd"))).select("rd", "g.year", "g.month", "g.day", cal.weekday(F.col("rd")).alias("weekday"))
    path = _path(spark)
    write_by_century(rows, path)
    return in_years(stored_events(spark, path, rows.schema), 1996, 1999)
