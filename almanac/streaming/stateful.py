"""Streams with state of their own: abandoned runs by timers, account states by key, and rows that come too late."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.window import Window

from ..plans.registry import query, table
from ..plans.written import shared_dir
from ..sources.store import Kept, Store

# fixed values: how long a run may stand still, and how late rows may come
STALE_MINUTES, LATE = 30, "1 hour"
STALE = STALE_MINUTES * 60_000
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _state(fields: str) -> StructType:
    """A schema of a state; tasks have no session to read DDL with."""
    kinds, out = {"long": LongType(), "int": IntegerType(), "string": StringType()}, StructType()
    for field in fields.split(", "):
        name, kind = field.split()
        out.add(name, kinds[kind])
    return out


class Sweep(StatefulProcessor):
    """What becomes of runs that stand still. Rows of a run wait until the watermark has passed them and are then taken
    in order of time, so the order of their arrival doesn't matter; a timer ends a run that is heard of no more.

    A state is reached through a socket: a run's rows of a batch are one list and have one timer, that of the first of
    them that waits, so the calls grow with the runs of a batch, not with its rows."""

    def __init__(self, stale: int = STALE) -> None:
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _state("at long, event_id long, status string, attempts int, most int"))
        self.run = handle.getValueState("run", _state("status string, since long, attempts int, most int"))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["event_id"], r["status"], r["attempts"], r["most"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        # a row that is delivered twice is one row; the later delivery counts
        waiting = {tuple(r)[:2]: tuple(r)[2:] for r in self.waiting.get()} if self.waiting.exists() else {}
        due = sorted((k, v) for k, v in waiting.items() if k[0] < mark)
        left = [(*k, *v) for k, v in waiting.items() if k[0] >= mark]
        known = self.run.exists()
        run = tuple(self.run.get()) if known else None
        out = []

        def ended(before: int) -> bool:
            return run is not None and run[0] == "running" and run[1] + self.stale < before

        def verdict() -> tuple:
            status = "retrying" if run[2] < run[3] else "failed"
            out.append(Row(job_id=key[0], at=run[1] + self.stale, verdict=status))
            return (status, *run[1:])

        for (at, event_id), (status, attempts, most) in due:
            if ended(at):
                verdict()
            run = (status, at, attempts, most)
        if due and left:
            self.waiting.put(left)
        elif due:
            self.waiting.clear()
        if left:
            self.handle.registerTimer(min(r[0] for r in left) + 1)
        if ended(mark):
            run = verdict()
        if run is None or run[0] != "running":
            if known:
                self.run.clear()
        else:
            self.run.update(run)
            self.handle.registerTimer(run[1] + self.stale + 1)
        return iter(out)

    def close(self) -> None:
        pass


def stream_sweep(log: DataFrame) -> DataFrame:
    """job_id, at, verdict (retrying or failed) of runs that stood still for half an hour, as their time passes.

    log: job_id, event_id, ts, status, attempts, most. Of rows of one time the larger event_id is the later; a row that
    is delivered twice counts once.
    """
    timed = log.select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "status", F.col("attempts").cast("int").alias("attempts"), F.col("most").cast("int").alias("most")).where("job_id is not null and ts is not null")
    found = timed.withWatermark("ts", LATE).groupBy("job_id").transformWithState(Sweep(), f"job_id {log.schema['job_id'].dataType.simpleString()}, at long, verdict string", "append", "eventTime")
    return found.select("job_id", F.timestamp_millis("at").alias("at"), "verdict")


def swept(log: DataFrame) -> DataFrame:
    """stream_sweep() over a whole log, up to an hour before its last row, which is as far as the stream has come."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    timed = log.where("job_id is not null and ts is not null").select("job_id", "event_id", at.alias("at"), "status", "attempts", "most").dropDuplicates(["job_id", "at", "event_id"])
    last = timed.agg(F.max("at")).first()[0]
    mark = (last or 0) - 3_600_000
    following = F.lead("at").over(Window.partitionBy("job_id").orderBy("at", "event_id"))
    # a row that the watermark hasn't passed is not yet known of
    rows = timed.where(F.col("at") < mark).withColumn("then", F.coalesce(following, F.lit(mark)))
    stale = (F.col("status") == "running") & (F.col("at") + STALE < F.col("then"))
    return rows.where(stale).select("job_id", F.timestamp_millis(F.col("at") + STALE).alias("at"), F.when(F.col("attempts") < F.col("most"), "retrying").otherwise("failed").alias("verdict"))


class Accounts(StatefulProcessor):
    """The last subscription event of an account and how often it has bought; each batch gives the accounts it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", _state("at long, event_id long, state string, purchases long"))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, event_id, state, purchases = tuple(self.state.get()) if self.state.exists() else (None, None, None, 0)
        for r in rows:
            purchases += r["event_type"] == "purchase"
            if at is None or (r["at"], r["event_id"]) > (at, event_id):
                at, event_id, state = r["at"], r["event_id"], r["event_type"]
        self.state.update((at, event_id, state, purchases))
        return iter([Row(user_id=key[0], state=state, purchases=purchases, tier="customer" if purchases else "guest")])

    def close(self) -> None:
        pass


_ACCOUNTS = "user_id long, state string, purchases long, tier string"


def stream_accounts(events: DataFrame) -> DataFrame:
    """The account states that each batch of events changes; who has ever bought stays a customer."""
    own = events.where(F.col("event_type").isin("signup", "purchase", "error") & F.col("user_id").isNotNull()).select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return own.groupBy("user_id").transformWithState(Accounts(), _ACCOUNTS, "update", "none")


def watched(spark: SparkSession, path: str, schema: StructType, most: int = 8) -> DataFrame:
    """The files of a path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def _run(stream: DataFrame, state: str, mode: str, sink) -> None:
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        sink(stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode(mode)).awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)


def append_all(stream: DataFrame, out: str) -> DataFrame:
    """What a stream appends over all that is there now; called again with the same folder it goes on where it ended."""
    _run(stream, f"{out}/state", "append", lambda w: w.format("parquet").start(f"{out}/rows"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def keep_accounts(stream: DataFrame, out: str, buckets: int = 16) -> Store:
    """Account states in a store: each batch replaces the rows of the accounts that it changed, in their buckets only. A
    batch that is run again after a failure puts the same rows."""
    store = Store(stream.sparkSession, f"{out}/accounts", {"accounts": Kept(StructType.fromDDL(_ACCOUNTS), ("user_id",))}, buckets)
    _run(stream, f"{out}/state", "update", lambda w: w.foreachBatch(lambda df, n: store.put({"accounts": df})).start())
    return store


def split_late(stream: DataFrame, ts: str, out: str, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows too late) of a stream, every row in one of them.

    A row is too late when its time lies more than `late` before the latest of the batches before its own, which is what
    a watermark drops without a trace; rows without a time are too late. Each batch writes folders of its own number and
    looks at those before it only, so one that is run again after a failure writes the same.
    """
    spark, schema = stream.sparkSession, stream.schema
    time = F.col(ts).cast("timestamp")

    def one(df: DataFrame, n: int) -> None:
        df = df.persist()
        seen = spark.read.schema("batch long, newest timestamp").option("basePath", f"{out}/marks").parquet(f"{out}/marks").where(F.col("batch") < n).agg(F.max("newest")).first()[0] if n else None
        limit = F.lit(seen).cast("timestamp") - F.expr(f"interval {late}")
        on_time = F.coalesce(time >= limit, F.lit(seen is None) & time.isNotNull())
        for name, rows in (("on_time", df.where(on_time)), ("late", df.where(~on_time))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        df.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{out}/marks/batch={n}")
        df.unpersist()

    _run(stream, f"{out}/state", "append", lambda w: w.foreachBatch(one).start())
    return tuple(spark.read.schema(schema).option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch=*") for name in ("on_time", "late"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _log(events: DataFrame) -> DataFrame:
    """Events as the log of runs: who looks, runs; who buys, has finished."""
    status = F.when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), (F.col("event_id") % 5).alias("attempts"), F.lit(3).alias("most"))


@query("s2_swept_runs", f"""WITH l AS (SELECT user_id AS job_id, event_id, epoch_us(ts) // 1000 AS at_ms, event_type IN ('view', 'click') AS running, event_id % 5 AS attempts FROM events), m AS (SELECT max(at_ms) - 3600000 AS mark FROM l),
x AS (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY job_id ORDER BY at_ms, event_id), mark) AS next_ms FROM l, m WHERE at_ms < mark)
SELECT job_id, make_timestamp_ms(at_ms + {STALE}) AS at, CASE WHEN attempts < 3 THEN 'retrying' ELSE 'failed' END AS verdict FROM x WHERE running AND at_ms + {STALE} < next_ms""")
def s2_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep as a stream with timers over all that the table holds now."""
    events = watched(spark, f"{sf_dir}/events.parque*", table(spark, sf_dir, "events").schema)
    return append_all(stream_sweep(_log(events)), _folder(spark)).select("job_id", F.col("at").cast("timestamp_ntz").alias("at"), "verdict")


@query("s4_live_accounts", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'customer' ELSE 'guest' END AS tier
FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id""")
def s4_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account states as a stream with a state for each user, kept in a store by key."""
    events = watched(spark, f"{sf_dir}/events.parque*", table(spark, sf_dir, "events").schema)
    return keep_accounts(stream_accounts(events), _folder(spark)).read("accounts")


@query("s1_late_rows", "SELECT event_id, event_type FROM events")
def s1_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, those in time and those too late, from the two tables of a stream over eight files of all times."""
    events, out = table(spark, sf_dir, "events"), _folder(spark)
    events.repartition(8, F.xxhash64("event_id")).write.parquet(f"{out}/in")
    on_time, late = split_late(watched(spark, f"{out}/in", events.schema, 1), "ts", out)
    return on_time.unionByName(late).select("event_id", "event_type")
