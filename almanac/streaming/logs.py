"""Log computations as Structured Streaming jobs, each with a batch twin over the same table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.statements import claims_of_annotations
from ..plans import views
from ..plans.registry import query, table
from ..plans.written import shared_dir

# fixed values: requests an hour by role
LIMITS = {"anonymous": 10, "user": 120, "admin": 1000}
LATE = "1 hour"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state and rows, where driver and executors reach it."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def replay(spark: SparkSession, sf_dir: str, name: str, job: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The result of a streaming job over all that a table's folder holds now: all rows that it appends, or in complete
    mode the last state, which each batch writes whole."""
    if mode not in ("append", "complete"):
        raise ValueError("mode must be append or complete: update mode would need a sink that replaces rows by key")
    source = table(spark, sf_dir, name)
    out = shared_folder(spark)
    # a glob, so that a table that is one file and a folder of part files can both be watched
    stream = job(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name}.parque*"))
    write = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
    if mode == "append":
        write.outputMode("append").format("parquet").start(f"{out}/rows").awaitTermination()
    else:
        write.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def annotate_new(spark: SparkSession, sf_dir: str, name: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What job makes of the rows of a table, worked out once for each row as its files arrive.

    Each micro-batch is written to a folder of its own number, so a batch that is run again after a failure replaces
    what it wrote before: every row is annotated exactly once.
    """
    source = table(spark, sf_dir, name)
    out = shared_folder(spark)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name}.parque*")

    def one(df: DataFrame, number: int) -> None:
        job(df).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(one).start().awaitTermination()
    return spark.read.schema(job(source.limit(0)).schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")


def request_windows(requests: DataFrame) -> DataFrame:
    """Requests of each identity and bucket in each hour."""
    return requests.groupBy("identity", "bucket", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("identity", "bucket", F.col("w.start").alias("start"), "n")


def verdicts(requests: DataFrame, limit: int) -> DataFrame:
    """Each request with its place in its hour, whether it is allowed, and how many are left."""
    w = Window.partitionBy("identity", "bucket", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    n = F.row_number().over(w)
    return requests.withColumn("place", n).withColumns({"allowed": F.col("place") <= limit, "remaining": F.greatest(F.lit(0), limit - F.col("place"))})


@query("s1_rate_limits", views.WITH + """
SELECT event_id, CAST(place AS INT) AS place, place <= 2 AS allowed, CAST(greatest(0, 2 - place) AS INT) AS remaining FROM (
  SELECT event_id, row_number() OVER (PARTITION BY identity, bucket, date_trunc('hour', ts) ORDER BY ts, event_id) AS place FROM requests)""")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(views.requests(spark, sf_dir), 2).select("event_id", "place", "allowed", "remaining")


@query("s1_hourly_counts", views.WITH + " SELECT identity, bucket, date_trunc('hour', ts) AS start, count(*) AS n FROM requests GROUP BY ALL")
def s1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_windows(views.requests(spark, sf_dir))


@query("s2_stale_jobs", views.WITH + """
SELECT analysis_id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '2001-01-01' - INTERVAL 30 MINUTE THEN CASE WHEN duration_ms % 4 < 3 THEN 'retrying' ELSE 'failed' END ELSE status END AS status FROM analyses""")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that stand still for half an hour are tried again while they have attempts left, else they have failed."""
    stale = F.expr("status = 'running' and created_at < timestamp_ntz'2001-01-01' - interval 30 minutes")
    after = F.when(F.col("duration_ms") % 4 < 3, "retrying").otherwise("failed")
    return views.analyses(spark, sf_dir).select("analysis_id", F.when(stale, after).otherwise(F.col("status")).alias("status"))


@query("s3_redelivered_events", "SELECT event_id, user_id FROM events")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, from a table delivered twice."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return events.unionByName(events).dropDuplicates(["event_id"])


def account_state(events: DataFrame) -> DataFrame:
    """user_id, state (of the last subscription event), purchases, and tier: who has ever bought stays a customer."""
    own = events.where(F.col("event_type").isin("signup", "purchase", "error"))
    bought = F.count_if(F.col("event_type") == "purchase")
    return own.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), bought.alias("purchases"), F.when(bought > 0, "customer").otherwise("guest").alias("tier"))


@query("s4_account_state", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'customer' ELSE 'guest' END AS tier
FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_state(table(spark, sf_dir, "events"))


@query("s5_audit_counts", "SELECT CAST(ts AS DATE) AS day, event_type AS action, count(*) AS n FROM events GROUP BY ALL")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("s7_usage_counts", "SELECT user_id, count(*) AS used FROM events GROUP BY user_id")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("used"))


def stream_hourly(events: DataFrame) -> DataFrame:
    """S1 as a stream: hourly counts, complete once the watermark has passed."""
    named = events.select("event_id", F.col("user_id").alias("identity"), F.col("event_type").alias("bucket"), F.col("ts").cast("timestamp").alias("ts"))
    return request_windows(named.withWatermark("ts", LATE))


def stream_once(events: DataFrame) -> DataFrame:
    """S3 as a stream: each event id once within the watermark."""
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def stream_audit(events: DataFrame) -> DataFrame:
    """S5 as a stream: daily counts by action."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action")).withWatermark("ts", LATE)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "action", "n")


def stream_accounts(events: DataFrame) -> DataFrame:
    """S4 as a stream in complete mode: the account state after all subscription events."""
    return account_state(events)


@query("s6_annotated_documents")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the documents as their files arrive; tests compare with the batch operator."""
    job = lambda df: claims_of_annotations(df).select("doc_id", "ordering", "section", "claim_type", "confidence", "quoted_text", "start")
    return annotate_new(spark, sf_dir, "documents", job)


def stream_usage(events: DataFrame) -> DataFrame:
    """S7 as a stream in complete mode: events used by each user."""
    return events.groupBy("user_id").agg(F.count("*").alias("used"))
