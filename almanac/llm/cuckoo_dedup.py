"""Exact dedup with cuckoo filters over the live digests of each bucket; hits are verified against the stored keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, read

SLOTS, KICKS = 4, 200
#: Buckets of the index; each holds the digests of one part of the key space, so 4096 of them stay small up to some
#: billions of different texts. Raise it beyond.
BUCKETS = 4096


class CuckooIndex:
    """Live digests of a bucket: a cuckoo filter of 16-bit fingerprints before a store of whole keys.

    A filter miss proves that a digest is new. A hit is verified against the stored key, so the answers are exact.
    Digests can be deleted. When an insertion finds no place after KICKS moves, the filter doubles and is filled
    again from the stored keys.
    """

    def __init__(self, rows: int = 16) -> None:
        self.rows, self.table, self.store = rows, [0] * (rows * SLOTS), {}

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.rows - 1)
        return print_, first, self._other(first, print_)

    def _other(self, row: int, print_: int) -> int:
        return row ^ (print_ * 0x5BD1E995 >> 7 & (self.rows - 1))

    def may_hold(self, digest: bytes) -> bool:
        print_, a, b = self._place(digest)
        t = self.table
        return print_ in t[a * SLOTS : a * SLOTS + SLOTS] or print_ in t[b * SLOTS : b * SLOTS + SLOTS]

    def get(self, digest: bytes) -> object | None:
        return self.store.get(digest) if self.may_hold(digest) else None

    def put(self, digest: bytes, value: object) -> None:
        new = not (self.may_hold(digest) and digest in self.store)
        self.store[digest] = value
        if new and not self._add(digest):
            self._resize()

    def _add(self, digest: bytes) -> bool:
        print_, a, b = self._place(digest)
        t, row = self.table, a
        for turn in range(KICKS):
            for r in (a, b) if not turn else (row,):
                for s in range(r * SLOTS, r * SLOTS + SLOTS):
                    if not t[s]:
                        t[s] = print_
                        return True
            s = row * SLOTS + (print_ + turn) % SLOTS
            t[s], print_ = print_, t[s]
            row = self._other(row, print_)
        return False

    def _resize(self) -> None:
        while True:
            self.rows *= 2
            self.table = [0] * (self.rows * SLOTS)
            if all(self._add(d) for d in self.store):
                return

    def delete(self, digest: bytes) -> bool:
        if self.get(digest) is None:
            return False
        del self.store[digest]
        print_, a, b = self._place(digest)
        for r in (a, b):
            for s in range(r * SLOTS, r * SLOTS + SLOTS):
                if self.table[s] == print_:
                    self.table[s] = 0
                    return True
        return False


Best = tuple[int, int | None, int]


def better(a: Best, b: Best) -> Best:
    """Most code points, then smallest doc_id (null last); the sizes add up."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    best = min(a, b, key=rank)
    return best[0], best[1], a[2] + b[2]


def _fold(index: CuckooIndex, rows: Iterable[tuple[bytes, int, int | None, int]]) -> None:
    for digest, *value in rows:
        known = index.get(digest)
        index.put(digest, tuple(value) if known is None else better(known, tuple(value)))


_SCHEMA = "bucket int, digest binary, len long, doc_id long, n long"
_ARROW = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("len", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def _batch(bucket: Iterable[int], store: dict) -> pa.RecordBatch:
    values = list(store.values())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(list(store), pa.binary()), *(pa.array([v[k] for v in values], pa.int64()) for k in range(3))], schema=_ARROW)


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("digest", "len", "doc_id", "n")), strict=True))


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse the copies within a batch before the shuffle, so that a hot text sends a row from each batch."""
    for batch in batches:
        _fold(index := CuckooIndex(), _rows(batch))
        of = dict(zip(batch.column("digest").to_pylist(), batch.column("bucket").to_pylist(), strict=True))
        yield _batch([of[d] for d in index.store], index.store)


def _after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one index at a time."""
    last, index = None, CuckooIndex()
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        edges = [0, *(np.nonzero(np.diff(buckets))[0] + 1).tolist(), len(buckets)]
        rows = _rows(batch)
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if buckets[lo] != last:
                if index.store:
                    yield _batch([last] * len(index.store), index.store)
                last, index = int(buckets[lo]), CuckooIndex()
            _fold(index, rows[lo:hi])
    if index.store:
        yield _batch([last] * len(index.store), index.store)


def text_sha(text: F.Column) -> F.Column:
    """SHA-256 of a text without its white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


def digests(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, len, text_sha256, digest, bucket of each row; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("len"), text_sha(text).alias("text_sha256")).withColumns({"digest": F.unhex("text_sha256"), "bucket": F.pmod(F.conv(F.substring("text_sha256", 57, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")})


def build_index(rows: DataFrame) -> DataFrame:
    """The live keys of each bucket: bucket, digest, len and doc_id of the row that stays, n rows. rows: from digests()."""
    some = rows.select("bucket", "digest", "len", F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n")).mapInArrow(_before, _SCHEMA)
    return some.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_after, _SCHEMA)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The index after deleting the digests of deletes (digest, bucket) and then inserting rows of digests()."""

    def change(old: pd.DataFrame, gone: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        own = CuckooIndex()
        _fold(own, old[["digest", "len", "doc_id", "n"]].itertuples(index=False, name=None))
        for digest in gone["digest"]:
            own.delete(digest)
        _fold(own, new[["digest", "len", "doc_id", "n"]].itertuples(index=False, name=None))
        bucket = next(int(x["bucket"].iloc[0]) for x in (old, new, gone) if len(x))
        return pd.DataFrame([(bucket, d, *v) for d, v in own.store.items()], columns=["bucket", "digest", "len", "doc_id", "n"])

    gone = deletes.select("bucket", "digest", F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n")).withColumn("kind", F.lit(1))
    all_ = index.withColumn("kind", F.lit(0)).unionByName(gone).unionByName(build_index(inserts).withColumn("kind", F.lit(2)))
    return all_.groupBy("bucket").applyInPandas(lambda x: change(*(x[x.kind == k] for k in range(3))), _SCHEMA)


def exact_duplicates(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id long, text string, ...).

    Texts are equal when identical without white space; null counts as empty, so null, empty and blank texts are one
    group. The row with the most code points stays, then the smallest doc_id (null last). Rows that repeat both text
    and doc_id share keep_id, and all of them are marked kept. An empty table gives an empty result; further columns
    are ignored.
    """
    rows = cut(digests(docs, buckets))
    keys = build_index(rows).select("digest", F.col("len").alias("keep_len"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    out = rows.join(keys, "digest")
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
