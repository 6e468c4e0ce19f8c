"""SimHash near-dedup: fingerprints meet in the grid of their segment popcounts and are verified exactly."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, cut, local_roots, read

#: Bits of a segment; segments of 2 bits make 32 popcounts of 0 to 2. GROUPS of neighbouring segments are the axes of
#: the grid.
SEGMENT, GROUPS = 2, 6
#: Fingerprints of a cell that are compared at once; a larger cell is dealt to tiles.
CELL = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; zero for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return 0
    joined = b" ".join(data)
    ends = np.cumsum([len(w) + 1 for w in data]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = max(0, len(data) - words)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    own = [digest(view[a:b], 42) for a, b in zip(starts[: k + 1].tolist(), ends[len(data) - 1 - k :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(own), 1 << 14):
        bits = np.unpackbits(np.array(own[lo : lo + (1 << 14)], dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.uint32) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > len(own), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed 64-bit integers."""
    for t in texts:
        yield pd.Series(np.array([fingerprint(x) for x in t], np.uint64).view(np.int64))


def popcounts(prints: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The number of set bits in each segment of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(prints), 64 // segment, segment).sum(axis=2, dtype=np.uint8)


def cells(prints: np.ndarray, distance: int, groups: int = GROUPS) -> np.ndarray:
    """The grid cells that each fingerprint reports to, one row of cell names for each fingerprint.

    The Manhattan distance of two popcount vectors is at most the Hamming distance of the fingerprints. Of groups
    axes, a pair within the distance differs on at most `distance` of them, so it shares the cell of at least one
    choice of groups - distance axes: the range join becomes an equality join on these cells, and loses no pair.
    """
    counts = popcounts(prints)
    edges = np.linspace(0, counts.shape[1], groups + 1).round().astype(int)
    axis = np.zeros((groups, len(prints)), np.uint64)
    for g in range(groups):
        for c in range(edges[g], edges[g + 1]):
            axis[g] = axis[g] * np.uint64(SEGMENT + 1) + counts[:, c]
    out = []
    for k, chosen in enumerate(itertools.combinations(range(groups), groups - distance)):
        name = np.full(len(prints), k, np.uint64)
        for g in chosen:
            name = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + axis[g] + np.uint64(1)
        out.append(name ^ (name >> np.uint64(29)))
    return np.stack(out, axis=1)


def _report(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column(0))
            if len(prints):
                names = cells(prints, distance)
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel().view(np.int64)), pa.array(np.repeat(prints, names.shape[1]))], names=["cell", "print"])

    return run


def near(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b; b None: i < j of a) within the Hamming distance: popcounts first, then exactly."""
    same, b = b is None, a if b is None else b
    left, right = popcounts(a).astype(np.float32), popcounts(b).astype(np.float32)
    # sums of segments give a first lower bound of the Manhattan distance, compared for all pairs at once
    coarse = lambda x: x.reshape(len(x), 4, -1).sum(axis=2).astype(np.int8)
    ca, cb = coarse(left), coarse(right)
    found = [(np.zeros(0, int), np.zeros(0, int))]
    step = max(1, (1 << 20) // max(1, len(b)))
    for lo in range(0, len(a), step):
        bound = sum(np.abs(ca[lo : lo + step, None, k] - cb[None, :, k]) for k in range(4))
        i, j = np.nonzero(bound <= distance)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 1 << 18):
            x, y = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
            ok = np.bitwise_count((a[x] ^ b[y]).view(np.uint64)) <= distance
            found.append((x[ok], y[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _meet(distance: int):
    """Rows (cell, i, j, b, print) sorted by tile: the local forest of each tile, as edges (u, v)."""

    def tile(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j, own, prints = rows
        if i[0] == j[0]:
            a, b = near(prints, None, distance)
        else:
            left, right = np.nonzero(own == i[0])[0], np.nonzero(own == j[0])[0]
            a, b = near(prints[left], prints[right], distance)
            a, b = left[a], right[b]
        root = local_roots(prints.shape[0], a, b)
        moved = root != np.arange(len(root))
        return prints[moved], prints[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            ends = np.nonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))[0] + 1
            held = rows[:, ends[-1] if len(ends) else 0 :]
            yield from emit(rows, np.append(0, ends))
        if held is not None and held.shape[1] > 1:
            yield from emit(held, np.array([0, held.shape[1]]))

    def emit(rows: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        out = []
        # cells of two, which are most of them, all at once
        two = edges[:-1][sizes == 2]
        if len(two):
            x, y = rows[4, two], rows[4, two + 1]
            ok = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
            ok &= (rows[1, two] == rows[2, two]) | (rows[3, two] != rows[3, two + 1])
            out.append((x[ok], y[ok]))
        for lo, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            out.append(tile(rows[1:, lo : lo + n]))
        if out:
            u, v = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(prints: DataFrame, distance: int = 3, cell: int = CELL) -> DataFrame:
    """Edges (u, v) between fingerprints (print long, all different) that join all pairs within the distance."""
    named = cut(prints.mapInArrow(_report(distance), "cell long, print long"))
    shared = named.groupBy("cell").count().where("count > 1")
    met = named.join(shared, "cell").withColumn("n", F.ceil(F.col("count") / cell).cast("int")).drop("count")
    met = met.withColumn("b", F.pmod(F.xxhash64("print"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = met.select("cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "print")
    tiles = tiles.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return cut(tiles.mapInArrow(_meet(distance), "u long, v long").distinct())


def near_groups(docs: DataFrame, distance: int = 3, *more: F.Column) -> DataFrame:
    """doc_id, print, component_id, component and the further columns for each row of docs; component is the smallest
    fingerprint of the row's component, which names it whatever the ids are."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints("text").alias("print"), *more))
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("low"))
    parts = components(links(prints.select("print"), distance)).withColumnRenamed("vertex", "print")
    classes = prints.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print"))
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = cut(classes.join(lows, "component").select("print", "component_id", "component"))
    return rows.join(classes, "print")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs (doc_id long, text string, ...).

    Null, empty and blank texts have the fingerprint zero and are linked like any other. Fingerprints at `distance` or
    fewer differing bits are linked, and component_id is the smallest doc_id reachable over links; rows that repeat a
    text share its component; rows without doc_id take part, and a component of such rows alone has a null id. An
    empty table gives an empty result; further columns are ignored.
    """
    return near_groups(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
