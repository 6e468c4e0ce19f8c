"""Embedding near-dedup: int8 tile products with a rigorous error bound for each vector, exact check of what may pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, local_roots, read, tiled

#: Vectors of a block, and rows of the strip of a tile product that is held at once.
BLOCK, STRIP = 2048, 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, and the exact Euclidean norm of the quantisation error of each unit vector."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 holds the sums of up to 1024 products of 127 * 127 exactly."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i of a, j of b) of the pairs with cosine >= threshold in double precision; b None: pairs i < j of a.

    With x = s q + e for the unit vectors, |x.y - s s' q.q'| <= |sq| |e'| + |e| |s'q'| + |e| |e'|; a pair is
    recomputed in double precision exactly when its int8 product plus this bound can reach the threshold.
    """
    same, b = b is None, a if b is None else b
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    (qa, sa, ea), (qb, sb, eb) = quantise(a / na[:, None]), quantise(b / nb[:, None])
    la, lb = 1 + ea, 1 + eb
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for k in range(0, len(a), STRIP):
        cut_ = slice(k, k + STRIP)
        rough = int8_product(qa[cut_], qb) * sa[cut_, None] * sb
        rough += la[cut_, None] * eb + ea[cut_, None] * lb + ea[cut_, None] * eb
        i, j = np.nonzero(rough >= threshold - 1e-5)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 1 << 16):
            x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            found.append((x[ok], y[ok]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        own, at, n = (table.column(c).to_numpy() for c in ("_b", "key", "copies"))
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        if i == j:
            a, b = links(x, None, threshold)
        else:
            left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
            a, b = links(x[left], x[right], threshold)
            a, b = left[a], right[b]
        count = np.bincount(a, n[b], len(at)) + np.bincount(b, n[a], len(at))
        hit = count > 0
        return pa.table({"u": at[hit], "v": at[local_roots(len(at), a, b)][hit], "n": count[hit].astype(np.int64)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) with n_links, component_id and kept; other columns are dropped.

    Only vectors of equal, non-null labels and equal lengths are compared. A vector that is null, empty, zero or holds
    a null or non-finite component, or whose label is null, has no links and is its own component. Copies of a vector
    within a label are compared once and counted with their number; a repeated vec_id counts as another row. An empty
    table gives an empty result.

    The pairs of a label meet in tiles of bounded size, and a tile returns for each of its vectors the number of links
    and one edge to its local component, never the pairs.
    """
    good = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "embedding", F.col("label").alias("label"), F.coalesce(good, F.lit(False)).alias("good"))
    # a vector is named by 128 bits of hash; the different ones get numbers when they are written
    name = [F.when(F.col("good"), F.xxhash64(F.lit(seed), "label", "embedding")).alias(f"name{seed}") for seed in (1, 2)]
    keyed = rows.select("vec_id", *name, "label", "embedding")
    # one row for each different vector of a label, counted before the shuffle
    distinct = keyed.where("name1 is not null").groupBy("name1", "name2", "label", F.size("embedding").alias("dim")).agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    distinct = cut(distinct.withColumn("key", F.monotonically_increasing_id()))
    tiles = tiled(distinct.select("key", "label", "dim", "embedding", "copies"), ["label", "dim"], block, F.col("key"))
    met = cut(tiles.groupBy("label", "dim", "_i", "_j").applyInArrow(_tile(threshold), "u long, v long, n long"))
    parts = components(met.select("u", "v"))
    found = met.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    classes = distinct.select("key", "name1", "name2", "copies", "low").join(found, "key", "left").join(parts.withColumnRenamed("vertex", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = cut(classes.join(lows, "component").select("name1", "name2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = keyed.select("vec_id", "name1", "name2").join(classes, ["name1", "name2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
