"""What the operators of this package share: written cut points, component search and local forests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_row(df: DataFrame) -> F.Column:
    """All columns of df as one struct: beside it, columns of any name can be added without a clash."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def trained_on(remainder: int) -> F.Column:
    """Rows to learn from: crc32(doc_id as text) mod 5 differs from remainder. Rows without doc_id are not learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != remainder, F.lit(False))


def held_out(remainder: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vertices over the edges a-b: roots hook to smaller roots, then all jump.

    Only roots move, so a vertex never leaves its tree, and an edge is done with once both its ends have one root.
    """
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        low = np.minimum(ra, rb)
        np.minimum.at(label, ra, low)
        np.minimum.at(label, rb, low)
        while (jumped := label[label] != label).any():
            label[jumped] = label[label[jumped]]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch as stars around the smallest vertex of each of its components."""
    for batch in batches:
        u, v = (np.asarray(c) for c in batch.columns[:2])
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(len(ids), at[: len(u)], at[len(u) :])
        moved = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of edges (u long, v long); component is the smallest vertex reachable.

    Alternating large and small stars: each round is two pre-aggregated minima and two joins that Spark can split on
    skew, and the number of rounds grows with the logarithm of the size. Each round is written to the shared folder.
    """
    e = edges.where("u <> v").mapInArrow(_contract, "u long, v long").distinct()
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def tiled(df: DataFrame, keys: list[str], size: int, by: F.Column) -> DataFrame:
    """Deal the rows of each key to tiles (_i, _j) so that any two rows of a key meet in exactly one tile.

    A key with c rows has n = ceil(c / size) blocks and n (n + 1) / 2 tiles, each of about 2 * size rows at most
    whatever c is. by: a column that spreads the rows of a key evenly. _b is the row's own block.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    own = df.join(counts, keys).withColumn("_b", F.pmod(F.xxhash64(by, F.lit(7)), F.col("_n")).cast("int"))
    return own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o", "_n")
