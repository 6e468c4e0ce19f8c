"""Tables of a collection under one manifest: hashed to buckets by key, changed all together or not at all.

A change writes new files beside the old ones, for those buckets only that hold a changed key, and then a manifest that
says which folder holds each bucket of each table. The manifest is one file, and its renaming at the commit is the
switch: before it every reader has the old tables, after it the new ones. Nothing that a reader may use is overwritten.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

#: Buckets of a table; the manifest has a line for each, and the driver reads these.
BUCKETS = 64
#: Up to how many tasks write the rows of a bucket.
PARTS = 32
#: Each version of a bucket is a file of its own that stays, so files are packed as tightly as parquet can.
CODEC = "zstd"
_MANIFEST = "version long, name string, bucket int, folder string"


@dataclasses.dataclass(frozen=True)
class Kept:
    """A table of a store: its schema, and the columns that name a row."""

    schema: StructType
    keys: tuple[str, ...]


@dataclasses.dataclass(frozen=True)
class Outcome:
    """What came of a change: the version that holds it (None: nothing was changed), rows and buckets of each table."""

    version: int | None
    rows: dict[str, int]
    buckets: dict[str, int]


@dataclasses.dataclass(frozen=True)
class Staged:
    """New rows of tables, written but seen by no reader: what a store held when they were, a mark that is in the names of
    their folders, the rows, and how many there are in each bucket."""

    held: dict[tuple[str, int], str]
    mark: str
    tables: dict[str, DataFrame]
    counts: dict[str, dict[int, int]]


class Store:
    """A folder with tables. root: a path that the driver and all executors reach; one process changes it at a time."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Kept], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets

    def _manifest(self) -> dict[tuple[str, int], str]:
        """(table, bucket) -> folder of the newest version, with version under ("", 0)."""
        try:
            lines = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifests/*")
            newest = lines.agg(F.max("version")).first()[0]
        except Exception as e:  # noqa: BLE001  a store without a version has no folder yet
            if "PATH_NOT_FOUND" in str(e):
                return {("", 0): 0}
            raise
        if newest is None:
            return {("", 0): 0}
        return {("", 0): newest} | {(r["name"], r["bucket"]): r["folder"] for r in lines.where(F.col("version") == newest).collect() if r["folder"]}

    def version(self) -> int:
        return self._manifest()["", 0]

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of now. What is read later of the result still is of now."""
        return self._read(name, self._manifest(), buckets)

    def _read(self, name: str, held: dict, buckets: Iterable[int] | None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        folders = [f for (t, b), f in sorted(held.items()) if t == name and (wanted is None or b in wanted)]
        kept = self.tables[name].schema
        return self.spark.read.schema(kept).parquet(*folders) if folders else self.spark.createDataFrame([], kept)

    def _bucket(self, name: str) -> F.Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.tables[name].keys)), F.lit(self.buckets)).cast("int")

    def put(self, changes: dict[str, DataFrame]) -> Outcome:
        """Rows of changes take the place of those of equal keys, of all tables at once.

        Of several new rows of one key the first in the order of all columns stays. Columns that a table doesn't have
        are left out, those that a change lacks are null. A change without rows makes no version.
        """
        return self.commit(self.stage(changes))

    def _dealt(self, name: str, df: DataFrame) -> DataFrame:
        """Rows by the tasks that write them: a bucket is dealt to several, and Spark puts small ones together. What deals
        them is worked out again behind the shuffle, which it would only make larger."""
        bucket, part = self._bucket(name), F.pmod(F.xxhash64(*self.tables[name].keys, F.lit(7)), F.lit(PARTS))
        return df.repartition(bucket, part).withColumns({"_bucket": bucket, "_part": part})

    def _of_key(self, name: str) -> WindowSpec:
        return Window.partitionBy("_bucket", "_part", *self.tables[name].keys)

    def stage(self, changes: dict[str, DataFrame], copies: bool = False) -> Staged:
        """The rows of put() are moved once and written beside the tables, where no reader looks before commit(). With
        copies they hold how many rows were given of each key (_copies)."""
        held = self._manifest()
        version, mark, tables, counts = held["", 0] + 1, uuid.uuid4().hex[:12], {}, {}
        for name, new in changes.items():
            kept = self.tables[name]
            given = {c.lower() for c in new.columns}
            new = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema))
            order = self._of_key(name)
            first = order.orderBy(F.xxhash64(*kept.schema.names), *(F.to_json(F.struct(c)) if f.dataType.typeName() == "map" else F.col(c) for c, f in zip(kept.schema.names, kept.schema, strict=True)))
            more = {"_copies": F.count("*").over(order)} if copies else {}
            folder = f"{self.root}/{name}/v{version}-{mark}"
            one = self._dealt(name, new).withColumns({"_n": F.row_number().over(first)} | more).where("_n = 1").drop("_n", "_part")
            one.write.option("compression", CODEC).partitionBy("_bucket").parquet(folder)
            extra = [StructField(c, LongType()) for c in more] + [StructField("_bucket", IntegerType())]
            tables[name] = self.spark.read.schema(StructType([*kept.schema, *extra])).parquet(folder)
            counts[name] = {r["_bucket"]: r["n"] for r in tables[name].groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
        return Staged(held, mark, tables, counts)

    def commit(self, staged: Staged) -> Outcome:
        """The staged rows and those of before that they don't replace become the newest version."""
        held, version, folders = staged.held, staged.held["", 0] + 1, {}
        for name, counts in staged.counts.items():
            folder = f"{self.root}/{name}/v{version}-{staged.mark}"
            if any((name, b) in held for b in counts):
                # of the new rows only the keys are needed to tell which old ones stay
                new = staged.tables[name].select(*self.tables[name].keys, F.lit(True).alias("_new"))
                both = self._read(name, held, counts).withColumn("_new", F.lit(False)).unionByName(new, allowMissingColumns=True)
                stays = self._dealt(name, both).withColumn("_gone", F.bool_or("_new").over(self._of_key(name))).where("NOT _gone").drop("_new", "_gone", "_part")
                stays.write.mode("append").option("compression", CODEC).partitionBy("_bucket").parquet(folder)
            folders |= {(name, b): f"{folder}/_bucket={b}" for b in counts}
        rows, touched = {t: sum(n.values()) for t, n in staged.counts.items()}, {t: len(n) for t, n in staged.counts.items()}
        if not folders:
            return Outcome(None, rows, touched)
        lines = [(version, t, b, f) for (t, b), f in ({k: v for k, v in held.items() if k[0]} | folders).items()]
        # an existing folder of this version is an error: of two that change the store at once, one does nothing
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.root}/manifests/{version:08d}")
        return Outcome(version, rows, touched)

    def describe(self) -> str:
        """The manifest in words, for people."""
        held = self._manifest()
        return json.dumps({"version": held["", 0], "buckets": {t: sum(k[0] == t for k in held) for t in self.tables}})
