"""Calendar tables: bulk conversion of the dates of a table, year spans and the day-level dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..plans.registry import query, table

_RD = "date_diff('day', DATE '0001-01-01', d) + 1"
_DAYS = f"WITH days AS (SELECT DISTINCT d, {_RD} AS rd FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))"


def hebrew_years_sql(first: int, last: int) -> str:
    """Common table expression hn for DuckDB: y, ny (day number of 1 Tishri), nisan (of 1 Nisan), size in days, leap."""
    return f""", hm AS (SELECT unnest(range({first} - 1, {last} + 3)) AS y),
he AS (SELECT y, 29 * m + (12084 + 13753 * m) // 25920 AS d FROM (SELECT y, (235 * y - 234) // 19 AS m FROM hm)),
hd AS (SELECT y, CASE WHEN 3 * (d + 1) % 7 < 3 THEN d + 1 ELSE d END AS d FROM he),
hs AS (SELECT y, -1373427 + d + CASE WHEN lead(d) OVER (ORDER BY y) - d = 356 THEN 2 WHEN d - lag(d) OVER (ORDER BY y) = 382 THEN 1 ELSE 0 END AS ny FROM hd),
hl AS (SELECT y, ny, lead(ny) OVER (ORDER BY y) - ny AS size, (7 * y + 1) % 19 < 7 AS leap FROM hs),
hn AS (SELECT y, ny, size, leap, ny + 118 + CASE WHEN size % 10 = 5 THEN 30 ELSE 29 END + CASE WHEN size % 10 = 3 THEN 29 ELSE 30 END + CASE WHEN leap THEN 30 ELSE 0 END AS nisan FROM hl WHERE y BETWEEN {first} AND {last} + 1)"""


#: Days before each month of a Hebrew year in the order from Tishri, and its number, from hn's columns.
_HEBREW_MONTHS = """SELECT y, ny, k, [7, 8, 9, 10, 11, 12, 13, 1, 2, 3, 4, 5, 6][k] AS month, ny + coalesce(list_sum(lengths[1:k - 1]), 0)::BIGINT AS start, lengths[k] AS len FROM (
  SELECT y, ny, [30, CASE WHEN size % 10 = 5 THEN 30 ELSE 29 END, CASE WHEN size % 10 = 3 THEN 29 ELSE 30 END, 29, 30, CASE WHEN leap THEN 30 ELSE 29 END, CASE WHEN leap THEN 29 ELSE 0 END, 30, 29, 30, 29, 30, 29] AS lengths FROM hn), range(1, 14) AS t(k)"""


def hebrew_years(spark: SparkSession, first: int, last: int) -> DataFrame:
    """year, new_year, next (day numbers), starts (days before each month from Tishri) of Hebrew years: a table that
    is worked out once and then joined, a row for each year."""
    y = F.col("year")
    years = spark.range(first, last + 1).select(F.col("id").alias("year"), F.array(cal.hebrew_new_year(F.col("id")), cal.hebrew_new_year(F.col("id") + 1)).alias("n"))
    years = years.select("year", F.col("n")[0].alias("new_year"), F.col("n")[1].alias("next"))
    return years.withColumn("starts", cal.hebrew_month_starts(y, F.col("next") - F.col("new_year")))


def hebrew_dates(days: DataFrame) -> DataFrame:
    """rd, year, month, day of each day of days (rd): an equality join on a guessed year with the table of years, which
    holds a few thousand rows for all of history, and no large expression for each row."""
    low, high = days.agg(F.min("rd"), F.max("rd")).first()
    guess = lambda rd: (rd - cal.HEBREW_EPOCH) * 98496 // 35975351 + 1
    years = hebrew_years(days.sparkSession, guess(low or 0) - 2, guess(high or 0) + 2)
    years = years.withColumn("_guess", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    joined = days.withColumn("_at", F.floor((F.col("rd") - cal.HEBREW_EPOCH) * 98496 / 35975351).cast("long") + 1).join(years, (F.col("_at") == F.col("_guess")) & (F.col("rd") >= F.col("new_year")) & (F.col("rd") < F.col("next")))
    place = F.size(F.filter("starts", lambda x: x <= F.col("rd") - F.col("new_year")))
    joined = joined.withColumn("_place", place)
    month = F.element_at(F.array(*map(F.lit, cal.TISHRI_ORDER)), F.col("_place"))
    return joined.select("rd", "year", month.cast("long").alias("month"), (F.col("rd") - F.col("new_year") - F.element_at("starts", F.col("_place")) + 1).alias("day"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct order dates: d, rd."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("rd", cal.rd_of_date(F.col("d")))


def convert(days: DataFrame, systems: list[str] | None = None) -> DataFrame:
    """rd, system, year, month, day: each day of days (rd) in each calendar, one row each; no shuffle."""
    rows = [F.struct(F.lit(s).alias("system"), cal.SYSTEMS[s][1](F.col("rd")).alias("date")) for s in systems or cal.SYSTEMS]
    return days.select("rd", F.explode(F.array(*rows)).alias("x")).select("rd", "x.system", "x.date.year", "x.date.month", "x.date.day")


def dimension(spark: SparkSession, first_rd: int, last_rd: int) -> DataFrame:
    """A row for every day: Gregorian and Julian dates, the other calendars as structs, cycles and eras."""
    days = spark.range(first_rd, last_rd + 1).withColumnRenamed("id", "rd")
    days = days.withColumns({s: to(F.col("rd")) for s, (_, to) in cal.SYSTEMS.items()})
    year = F.col("gregorian.year")
    return days.withColumns({"jdn": cal.jdn(F.col("rd")), "weekday": cal.weekday(F.col("rd")), "maya": cal.to_maya(F.col("rd")), "haab": cal.haab(F.col("rd")), "tzolkin": cal.tzolkin(F.col("rd")), "sexagenary": cal.sexagenary(year), "eras": cal.eras(year), "century": cal.div(year, 100)})


def _system(name: str):
    return lambda spark, sf_dir: convert(order_days(spark, sf_dir), [name]).select("rd", "year", "month", "day")


query("k1_day_numbers", _DAYS + " SELECT rd, rd + 1721425 AS jdn, CAST(julian(CAST(d AS TIMESTAMP)) AS DOUBLE) - 0.5 AS jd_midnight FROM days")(
    lambda spark, sf_dir: order_days(spark, sf_dir).select("rd", cal.jdn(F.col("rd")).alias("jdn"), (cal.jdn(F.col("rd")) - 0.5).alias("jd_midnight"))
)
query("k2_gregorian", _DAYS + " SELECT rd, year(d) AS year, month(d) AS month, day(d) AS day FROM days")(_system("gregorian"))
query("k3_julian", _DAYS + " SELECT rd, year(d - 13) AS year, month(d - 13) AS month, day(d - 13) AS day FROM days")(_system("julian"))
query("k4_hebrew", _DAYS + hebrew_years_sql(5700, 5800) + f", hx AS ({_HEBREW_MONTHS}) SELECT rd, y AS year, month::BIGINT AS month, rd - start + 1 AS day FROM days JOIN hx ON rd >= start AND rd < start + len")(
    lambda spark, sf_dir: hebrew_dates(order_days(spark, sf_dir))
)
query("k5_islamic", _DAYS + """, y AS (SELECT rd, (30 * (rd - 227015) + 10646) // 10631 AS y FROM days),
  s AS (SELECT rd, y, 227014 + (y - 1) * 354 + (3 + 11 * y) // 30 AS start FROM y),
  m AS (SELECT *, (SELECT max(k) FROM range(1, 13) AS r(k) WHERE start + 29 * (k - 1) + k // 2 + 1 <= rd) AS m FROM s)
SELECT rd, y AS year, m AS month, rd - (start + 29 * (m - 1) + m // 2) AS day FROM m""")(_system("islamic"))
query("k6_egyptian", _DAYS + " SELECT rd, (rd + 272787) // 365 + 1 AS year, ((rd + 272787) % 365) // 30 + 1 AS month, ((rd + 272787) % 365) % 30 + 1 AS day FROM days")(_system("egyptian"))
for _name, _epoch in (("coptic", cal.COPTIC_EPOCH), ("ethiopic", cal.ETHIOPIC_EPOCH)):
    query(f"k8_{_name}", _DAYS + f""", y AS (SELECT rd, (4 * (rd - {_epoch}) + 1463) // 1461 AS y FROM days),
      n AS (SELECT rd, y, rd - ({_epoch} + 365 * (y - 1) + y // 4) AS n FROM y)
    SELECT rd, y AS year, n // 30 + 1 AS month, n % 30 + 1 AS day FROM n""")(_system(_name))
_PERSIAN_YEARS = """, py AS (SELECT y, 226895 + 1029983 * ((y - 474) // 2820) + 365 * (c - 1) + (31 * c - 5) // 128 + 1 AS ny FROM (SELECT y, (y - 474) % 2820 + 474 AS c FROM (SELECT unnest(range(1000, 1500)) AS y)))"""
_PERSIAN = """SELECT rd, y AS year, CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 6) // 30 + 1 END AS month, CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 6) % 30 + 1 END AS day
FROM (SELECT rd, y, rd - ny AS n FROM days JOIN (SELECT y, ny, lead(ny) OVER (ORDER BY y) AS next FROM py) p ON rd >= ny AND rd < next)"""
query("k9_persian", _DAYS + _PERSIAN_YEARS + _PERSIAN)(_system("persian"))


@query("k7_maya", _DAYS + """, n AS (SELECT rd, rd + 1137142 AS n FROM days)
SELECT rd, concat_ws('.', n // 144000, n % 144000 // 7200, n % 7200 // 360, n % 360 // 20, n % 20) AS long_count,
       concat(((n + 348) % 365) % 20, ' ', (""" + repr(cal.HAAB) + """)[((n + 348) % 365) // 20 + 1]) AS haab,
       concat((n + 159) % 13 + 1, ' ', (""" + repr(cal.TZOLKIN) + """)[(n + 159) % 20 + 1]) AS tzolkin FROM n""")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rd = F.col("rd")
    return order_days(spark, sf_dir).select("rd", cal.to_maya(rd).alias("long_count"), cal.haab(rd).alias("haab"), cal.tzolkin(rd).alias("tzolkin"))


@query("k10_sexagenary", "SELECT DISTINCT year(o_orderdate) AS year, (year(o_orderdate) - 4) % 60 + 1 AS position, (" + repr(cal.STEMS) + ")[(year(o_orderdate) - 4) % 10 + 1] AS stem, (" + repr(cal.ANIMALS) + ")[(year(o_orderdate) - 4) % 12 + 1] AS animal FROM orders")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct()
    return years.withColumn("s", cal.sexagenary(F.col("year"))).select("year", "s.position", "s.stem", "s.animal")


@query("k11_eras", """SELECT DISTINCT year(o_orderdate) AS year, year(o_orderdate) + 753 AS urbis_conditae, year(o_orderdate) - 311 AS seleucid, year(o_orderdate) - 283 AS martyrs,
  concat('Ol. ', (year(o_orderdate) + 776) // 4 + 1, '.', (year(o_orderdate) + 776) % 4 + 1) AS olympiad, year(o_orderdate) + 5508 AS byzantine FROM orders""")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct()
    return years.withColumn("e", cal.eras(F.col("year"))).select("year", "e.*")


@query("k12_weekday", _DAYS + " SELECT rd, dayname(d) AS weekday FROM days")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_days(spark, sf_dir).select("rd", cal.weekday(F.col("rd")).alias("weekday"))


def convert_all(days: DataFrame) -> DataFrame:
    """convert() for every registered system, with the day's JDN, weekday, Maya count and cycles, sexagenary year and
    whether the system is arithmetic (exact) or stands for an observed calendar."""
    rd = F.col("rd")
    wide = {"jdn": cal.jdn(rd), "weekday": cal.weekday(rd), "long_count": cal.to_maya(rd), "haab": cal.haab(rd), "tzolkin": cal.tzolkin(rd)}
    others = days.select("rd", *[c.alias(k) for k, c in wide.items()], cal.sexagenary(cal.to_gregorian(rd)["year"])["position"].alias("sexagenary"))
    rows = convert(days, [s for s in cal.SYSTEMS if s != "hebrew"]).unionByName(hebrew_dates(days.select("rd")).withColumn("system", F.lit("hebrew")))
    return rows.join(others, "rd").withColumn("is_exact", ~F.col("system").isin(cal.OBSERVED))


_ISLAMIC = """SELECT rd, y AS year, m AS month, rd - (start + 29 * (m - 1) + m // 2) AS day FROM (
  SELECT *, (SELECT max(k) FROM range(1, 13) AS r(k) WHERE start + 29 * (k - 1) + k // 2 + 1 <= rd) AS m FROM (
    SELECT rd, y, 227014 + (y - 1) * 354 + (3 + 11 * y) // 30 AS start FROM (SELECT rd, (30 * (rd - 227015) + 10646) // 10631 AS y FROM days)))"""
_ALEXANDRIAN = lambda epoch: f"SELECT rd, y AS year, n // 30 + 1 AS month, n % 30 + 1 AS day FROM (SELECT rd, y, rd - ({epoch} + 365 * (y - 1) + y // 4) AS n FROM (SELECT rd, (4 * (rd - {epoch}) + 1463) // 1461 AS y FROM days))"


@query("k13_convert_all", _DAYS + hebrew_years_sql(5700, 5800) + _PERSIAN_YEARS + f""", hx AS ({_HEBREW_MONTHS}), every AS (
SELECT 'gregorian' AS system, rd, year(d) AS year, month(d) AS month, day(d) AS day FROM days
UNION ALL SELECT 'julian', rd, year(d - 13), month(d - 13), day(d - 13) FROM days
UNION ALL SELECT 'egyptian', rd, (rd + 272787) // 365 + 1, ((rd + 272787) % 365) // 30 + 1, ((rd + 272787) % 365) % 30 + 1 FROM days
UNION ALL SELECT 'hebrew', rd, y, month, rd - start + 1 FROM days JOIN hx ON rd >= start AND rd < start + len
UNION ALL SELECT 'islamic', * FROM ({_ISLAMIC}) UNION ALL SELECT 'persian', * FROM ({_PERSIAN})
UNION ALL SELECT 'coptic', * FROM ({_ALEXANDRIAN(cal.COPTIC_EPOCH)}) UNION ALL SELECT 'ethiopic', * FROM ({_ALEXANDRIAN(cal.ETHIOPIC_EPOCH)}))
SELECT e.*, rd + 1721425 AS jdn, dayname(d) AS weekday, concat_ws('.', n // 144000, n % 144000 // 7200, n % 7200 // 360, n % 360 // 20, n % 20) AS long_count,
  concat(((n + 348) % 365) % 20, ' ', ({cal.HAAB!r})[((n + 348) % 365) // 20 + 1]) AS haab, concat((n + 159) % 13 + 1, ' ', ({cal.TZOLKIN!r})[(n + 159) % 20 + 1]) AS tzolkin,
  (year(d) - 4) % 60 + 1 AS sexagenary, system NOT IN ('islamic', 'persian') AS is_exact FROM every e JOIN (SELECT rd, d, rd + 1137142 AS n FROM days) x USING (rd)""")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_all(order_days(spark, sf_dir))


def _persian_first_sql(y: str) -> str:
    """Day number of the first day of a Persian year from 1 on, less one."""
    cycle = f"CAST(floor(({y} - 474) / 2820.0) AS BIGINT)"
    within = f"(474 + ({y} - 474) - 2820 * {cycle})"
    return f"(226895 + 1029983 * {cycle} + 365 * ({within} - 1) + (682 * {within} - 110) // 2816)"


_K14_SYSTEMS = ["gregorian", "julian", "islamic", "egyptian", "coptic", "ethiopic", "unknown", "gregorian", "hebrew", "persian"]


@query("k14_any_system_to_rd", "WITH days AS (SELECT 0 AS rd)" + hebrew_years_sql(1990, 2010) + f""", hx AS ({_HEBREW_MONTHS}),
o AS (SELECT o_orderkey, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS rd, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN o.rd WHEN 1 THEN o.rd + 13 WHEN 2 THEN 227014 + (o.y - 1) * 354 + (3 + 11 * o.y) // 30 + 29 * (m - 1) + m // 2 + d WHEN 3 THEN -272788 + 365 * (o.y - 1) + 30 * (m - 1) + d
  WHEN 4 THEN 103604 + 365 * (o.y - 1) + o.y // 4 + 30 * (m - 1) + d WHEN 5 THEN 2795 + 365 * (o.y - 1) + o.y // 4 + 30 * (m - 1) + d WHEN 8 THEN hx.start + d - 1
  WHEN 9 THEN {_persian_first_sql("o.y")} + CASE WHEN m <= 7 THEN 31 * (m - 1) ELSE 30 * (m - 1) + 6 END + d END AS rd
FROM o LEFT JOIN hx ON hx.y = o.y AND hx.month = m AND len > 0""")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of each system, of one that is not known, and with a day that there isn't."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % len(_K14_SYSTEMS)
    system = F.element_at(F.array(*map(F.lit, _K14_SYSTEMS)), (k + 1).cast("int"))
    day = F.when(k == 7, 0).otherwise(F.dayofmonth(d))
    return table(spark, sf_dir, "orders").select("o_orderkey", cal.to_rd(system, F.year(d), F.month(d), day).alias("rd"))


@query("k15_year_spans", "WITH days AS (SELECT 0 AS rd)" + hebrew_years_sql(1, 1502) + f""", ys AS (SELECT DISTINCT 1 + o_orderkey % 1500 AS y FROM orders)
SELECT 'islamic' AS system, y, 227015 + (y - 1) * 354 + (3 + 11 * y) // 30 AS first, 227014 + y * 354 + (14 + 11 * y) // 30 AS last, 354 + (14 + 11 * y) // 30 - (3 + 11 * y) // 30 AS days FROM ys
UNION ALL SELECT 'egyptian', y, -272787 + 365 * (y - 1), -272788 + 365 * y, 365 FROM ys
UNION ALL SELECT 'coptic', y, 103605 + 365 * (y - 1) + y // 4, 103604 + 365 * y + (y + 1) // 4, 365 + (y + 1) // 4 - y // 4 FROM ys
UNION ALL SELECT 'ethiopic', y, 2796 + 365 * (y - 1) + y // 4, 2795 + 365 * y + (y + 1) // 4, 365 + (y + 1) // 4 - y // 4 FROM ys
UNION ALL SELECT 'julian', y, -1 + 365 * (y - 1) + (y - 1) // 4, -2 + 365 * y + y // 4, 365 + y // 4 - (y - 1) // 4 FROM ys
UNION ALL SELECT 'gregorian', y, first, last, last - first + 1 FROM (SELECT y, 1 + 365 * (y - 1) + (y - 1) // 4 - (y - 1) // 100 + (y - 1) // 400 AS first, 365 * y + y // 4 - y // 100 + y // 400 AS last FROM ys)
UNION ALL SELECT 'persian', y, first, last, last - first + 1 FROM (SELECT y, {_persian_first_sql("y")} + 1 AS first, {_persian_first_sql("(y + 1)")} AS last FROM ys)
UNION ALL SELECT 'hebrew', y, a.nisan, b.nisan - 1, b.nisan - a.nisan FROM ys JOIN hn a USING (y) JOIN hn b ON b.y = ys.y + 1""")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select((1 + F.col("o_orderkey") % 1500).alias("y")).distinct()
    spans = F.array(*[F.struct(F.lit(s).alias("system"), cal.year_span(s, F.col("y")).alias("s")) for s in cal.SYSTEMS])
    return years.select("y", F.explode(spans).alias("x")).select("x.system", "y", "x.s.first", "x.s.last", "x.s.days")


@query("k17_calendar_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', (SELECT count(*) FROM orders WHERE o_orderkey % {len(cal.SYSTEMS)} = {k}))" for k, s in enumerate(cal.SYSTEMS)) + ") AS t(system, uses)")
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered systems, with how often a table of dates uses each."""
    names = list(cal.SYSTEMS)
    used = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % len(names)).alias("k")).agg(F.count("*").alias("uses"))
    known = spark.createDataFrame(list(enumerate(names)), "k long, system string")
    return F.broadcast(known).join(used, "k", "left").select("system", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("k18_day_dimension", """
WITH span AS (SELECT date_diff('day', DATE '0001-01-01', min(CAST(o_orderdate AS DATE))) + 1 AS a, date_diff('day', DATE '0001-01-01', max(CAST(o_orderdate AS DATE))) + 1 AS b FROM orders),
days AS (SELECT unnest(range(a, b + 1)) AS rd FROM span), d AS (SELECT rd, DATE '0001-01-01' + CAST(rd - 1 AS INT) AS d FROM days)
SELECT rd, year(d) AS year, month(d) AS month, day(d) AS day, rd + 1721425 AS jdn, dayname(d) AS weekday, year(d) // 100 AS century FROM d""")
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_days(spark, sf_dir).agg(F.min("rd"), F.max("rd")).first()
    if a is None:
        a, b = 1, 0
    return dimension(spark, a, b).select("rd", "gregorian.year", "gregorian.month", "gregorian.day", "jdn", "weekday", "century")
