"""Range, nearest, as-of and interval joins by binning, so that none of them is a nested loop over both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query, table


#: Widths that a bin of a join by keys is long.
REACH = 8


def range_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs with |left_at - right_at| <= width and equal keys. right's keys are dropped; other names must differ.

    Without keys both sides are dealt to bins of the width; right goes to its bin and both neighbours, so a pair meets
    once. An equality join on the bin follows, which Spark can split on skew. With keys the bins are REACH widths long and
    right goes to a neighbour only where it is within reach of it: about one row in three is sent twice, where all were sent three times; a key's bin holds more.
    """
    size = width * REACH if keys else width
    keys = keys or []
    bin_ = lambda c: F.floor(c / size).cast("long")
    l = left.withColumn("_bin", bin_(F.col(left_at)))
    # half a width more than needed, so that no rounding of a difference loses a pair
    far = 1.5 * width
    reached = F.sequence(bin_(F.col(right_at) - far), bin_(F.col(right_at) + far)) if keys else F.sequence(bin_(F.col(right_at)) - 1, bin_(F.col(right_at)) + 1)
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumn("_rbin", F.explode(reached))
    on = F.col("_bin") == F.col("_rbin")
    for k in keys:
        on &= F.col(k) == F.col(f"_r_{k}")
    return l.join(r, on & (F.abs(F.col(left_at) - F.col(right_at)) <= width)).drop("_bin", "_rbin", *(f"_r_{k}" for k in keys))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, left_at: str, right_at: str, width: float, tie: str, keys: list[str] | None = None) -> DataFrame:
    """Of each left row the nearest right row within the width and its gap, as the struct `near`; ties go to the
    smallest `tie`.

    Left rows without one are left out.
    """
    pairs = range_join(left, right, left_at, right_at, width, keys)
    fields = [c for c in right.columns if c not in (keys or [])]
    gap = F.abs(F.col(left_at) - F.col(right_at))
    return pairs.groupBy(left_id).agg(F.min_by(F.struct(*fields, gap.alias("gap")), F.struct(gap, F.col(tie))).alias("near"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], stretch: float | None = None) -> DataFrame:
    """left with, of the last right row of its keys at or before it, the values (null if none).

    One union and one ordered window instead of a join of unequal times: each row moves once. With stretch, the rows
    of a key are dealt to stretches of time of that length, so that a hot key isn't one task: each stretch begins with
    the last values of those before it, which a window over one row for each key and stretch carries on.
    """
    fields = F.struct(*values)
    piece = lambda at: F.floor(F.col(at) / stretch).cast("long") if stretch else F.lit(0).cast("long")
    marks = right.select(*keys, piece(right_at).alias("_piece"), F.col(right_at).alias("_at"), F.lit(0).alias("_kind"), fields.alias("_v"))
    probes = left.select(*keys, piece(left_at).alias("_piece"), F.col(left_at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"))
    both = marks.unionByName(probes, allowMissingColumns=True)
    if stretch:
        ends = both.groupBy(*keys, "_piece").agg(F.max_by("_v", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
        before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_v", F.last("_last", ignorenulls=True).over(before)).where("_v is not null")
        both = both.unionByName(carried.select(*keys, "_piece", (F.col("_piece") * stretch).alias("_at"), F.lit(-1).alias("_kind"), "_v"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_piece").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


#: Up to how many intervals are joined as a broadcast table, point by point.
FEW = 1000


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, period: float | None = None, width: float | None = None) -> DataFrame:
    """points ⋈ intervals with low <= at < high. With a period, an interval whose low exceeds its high wraps around.

    Up to FEW intervals are broadcast, and each point is compared with all of them. More are dealt to bins of the given
    width (their mean length, where none is given), and an equality join on the bin follows.
    """
    a, b = F.col(low).cast("double"), F.col(high).cast("double")
    part = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    parts = F.array(part(a, b))
    if period is not None:
        parts = F.when(a > b, F.array(part(a, F.lit(float(period))), part(F.lit(0.0), b))).otherwise(parts)
    pieces = intervals.withColumn("_p", F.explode(parts))
    inside = (F.col(at) >= F.col("_p.a")) & (F.col(at) < F.col("_p.b"))
    n, mean = pieces.agg(F.count("*"), F.avg(F.col("_p.b") - F.col("_p.a"))).first()
    if n <= FEW:
        return points.join(F.broadcast(pieces), inside).drop("_p")
    width = width or max(mean, 1e-9)
    bin_ = lambda c: F.floor(c / width).cast("long")
    pieces = pieces.where("_p.a < _p.b").withColumn("_b", F.explode(F.sequence(bin_(F.col("_p.a")), bin_(F.col("_p.b")))))
    return points.withColumn("_at", bin_(F.col(at))).join(pieces, (F.col("_at") == F.col("_b")) & inside).drop("_p", "_at", "_b")


# fixed values: ecliptic longitude in degrees at which the Sun enters each constellation, in order
CONSTELLATIONS: list[tuple[str, float, float]] = [
    ("Aries", 28.7, 53.5), ("Taurus", 53.5, 90.4), ("Gemini", 90.4, 118.0), ("Cancer", 118.0, 138.0), ("Leo", 138.0, 174.0),
    ("Virgo", 174.0, 218.0), ("Libra", 218.0, 241.0), ("Scorpius", 241.0, 248.0), ("Ophiuchus", 248.0, 266.0),
    ("Sagittarius", 266.0, 300.0), ("Capricornus", 300.0, 327.7), ("Aquarius", 327.7, 351.6), ("Pisces", 351.6, 28.7),
]


def _days(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("long")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _days("o_orderdate").alias("day"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 15).alias("cust"), _days("l_shipdate").alias("ship"))


_L = "l AS (SELECT l_orderkey, l_linenumber, l_suppkey * 15 AS cust, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS ship FROM lineitem)"
_O = "o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)"


@query("c6_range_join", f"WITH {_L}, {_O} SELECT o_orderkey, l_orderkey, l_linenumber FROM o JOIN l ON o_custkey = cust AND abs(day - ship) <= 30")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _lines(spark, sf_dir).withColumnRenamed("cust", "o_custkey")
    return range_join(_orders(spark, sf_dir), right, "day", "ship", 30, ["o_custkey"]).select("o_orderkey", "l_orderkey", "l_linenumber")


@query("c7_nearest_join", f"""WITH {_L}, {_O} SELECT o_orderkey, l_orderkey, l_linenumber, gap FROM (
  SELECT o_orderkey, l_orderkey, l_linenumber, abs(day - ship) AS gap, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(day - ship), l_orderkey, l_linenumber) AS n
  FROM o JOIN l ON o_custkey = cust AND abs(day - ship) <= 200) WHERE n = 1""")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _lines(spark, sf_dir).select(F.col("cust").alias("o_custkey"), "ship", F.struct("l_orderkey", "l_linenumber").alias("line"))
    near = nearest_join(_orders(spark, sf_dir), right, "o_orderkey", "day", "ship", 200, "line", ["o_custkey"])
    return near.select("o_orderkey", "near.line.l_orderkey", "near.line.l_linenumber", F.col("near.gap").alias("gap"))


@query("c8_asof_join", """
SELECT event_id, (SELECT max(e2.event_id) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'click' AND e2.ts = (
  SELECT max(e3.ts) FROM events e3 WHERE e3.user_id = e.user_id AND e3.event_type = 'click' AND e3.ts <= e.ts)) AS click_id
FROM events e WHERE event_type = 'purchase'""")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seconds = lambda df, c: df.withColumn("_s", F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    return asof_join(seconds(bought, "ts"), seconds(clicks, "ts").withColumnRenamed("_s", "at"), ["user_id"], "_s", "at", ["click_id"], 86_400.0).select("event_id", "click_id")


_CASE = "CASE " + " ".join(f"WHEN lon >= {a} AND lon < {b} THEN '{n}'" for n, a, b in CONSTELLATIONS if a < b) + " ELSE 'Pisces' END"


@query("c9_interval_join", f"SELECT o_orderkey, {_CASE} AS constellation FROM (SELECT o_orderkey, CAST(o_orderkey % 3600 AS DOUBLE) / 10 AS lon FROM orders)")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 3600).cast("double") / 10).alias("lon"))
    zones = spark.createDataFrame(CONSTELLATIONS, "constellation string, low double, high double")
    return interval_join(points, zones, "lon", "low", "high", 360).select("o_orderkey", "constellation")


@query("c12_unordered_pairs", """
SELECT a.l_orderkey AS doc_id, a.l_partkey AS first, b.l_partkey AS second FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey")
    a, b = line.withColumnsRenamed({"l_linenumber": "i", "l_partkey": "first"}), line.withColumnsRenamed({"l_linenumber": "j", "l_partkey": "second"})
    return a.join(b, "doc_id").where("i < j").select("doc_id", "first", "second")
