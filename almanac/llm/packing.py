"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transducer
from .common import cut, read
from .token_counts import vocabulary

#: Open bins of a task. The partly filled bins that are left when a task ends are packed again, whole, in a second
#: pass, GATHER of them to a task.
OPEN_BINS, GATHER = 512, 4096


class BestFit:
    """Bounded-space online best fit. Open bins are kept by free space, with a bitset of the spaces that occur.

    An item goes into the open bin with the least free space that still holds it. Where none does, a new bin opens;
    at the limit the fullest open bin is closed first.
    """

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit, self.open, self.next, self.bits = size, limit, 0, 0, 0
        self.bins: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> tuple[int, list]:
        self.open -= 1
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        return found

    def add(self, item: object, length: int) -> tuple[int, list] | None:
        """Place an item shorter than a bin; a bin that is closed by this is returned as (number, [(item, offset)])."""
        closed = None
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            number, held = self._take(free)
        else:
            if self.open >= self.limit:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            number, held, free = self.next, [], self.size
            self.next += 1
        held.append((item, self.size - free))
        free -= length
        if not free:
            return number, held
        self.bins[free].append((number, held))
        self.bits |= 1 << free
        self.open += 1
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.open:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def pieces(machine: transducer.Transducer, doc_ids: list, texts: list[str], size: int, end: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc) of each piece; a text's parts come one after the other."""

    def cut_up(k: int, ids: bytes) -> Iterator[tuple]:
        ids += end.to_bytes(4, "little")
        n = len(ids) // 4
        lead = n - (-(-n // size) - 1) * size
        view = memoryview(ids)
        lo, number = 0, 0
        while lo < n:
            hi = lo + (size if number else lead)
            yield doc_ids[k], number, lo, hi - lo, zlib.crc32(view[4 * lo : 4 * hi])
            lo, number = hi, number + 1

    at, held = -1, b""
    for of, ids, first in machine.encode(texts):
        for k, a, b in zip(of.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = ids[a:b].astype("<u4", copy=False).tobytes()
            if k == at:
                held += own
                continue
            if at >= 0:
                yield from cut_up(at, held)
            at, held = k, own
    if at >= 0:
        yield from cut_up(at, held)


def _pack(path: str, size: int, end: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, base, bins = transducer.load(path), TaskContext.get().partitionId() << 33, BestFit(size, limit)
        out: list[tuple] = []

        def close(closed: tuple[int, list], is_open: bool) -> None:
            number, held = closed
            out.extend((*item, base + number, offset, is_open) for item, offset in held)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE_SCHEMA, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_PIECE_SCHEMA)

        for batch in batches:
            for item in pieces(machine, batch.column(0).to_pylist(), batch.column(1).to_pylist(), size, end):
                if item[3] == size:
                    close((bins.next, [(item, 0)]), False)
                    bins.next += 1
                elif closed := bins.add(item, item[3]):
                    close(closed, False)
            if out:
                yield flush()
        for left in bins.rest():
            close(left, True)
        if out:
            yield flush()

    return run


def _repack(size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = (1 << 62) + (TaskContext.get().partitionId() << 33), BestFit(size, limit)
        out: list[tuple] = []

        def close(closed: tuple[int, list]) -> None:
            out.extend((item, base + closed[0], offset) for item, offset in closed[1])

        for batch in batches:
            for item, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n == size:
                    close((bins.next, [(item, 0)]))
                    bins.next += 1
                elif closed := bins.add(item, n):
                    close(closed)
        for left in bins.rest():
            close(left)
        columns: Iterable = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sequence_id", "packed_id", "shift"])

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2, limit: int = OPEN_BINS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end; null and empty texts are the end alone. Only documents longer than size
    are cut, into pieces of size with the remainder first. Every task packs what it reads, without a shuffle; the bins
    that are still open when it ends are then packed again as units. Rows that repeat a doc_id, or have none, are
    packed as documents of their own. An empty table gives an empty result; further columns are ignored.
    """
    first = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack(path, size, end, limit), _PIECES))
    closed, left = first.where("not open").drop("open"), first.where("open").drop("open")
    units = left.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    parts = max(1, -(-units.count() // GATHER))
    moved = units.repartition(parts, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("n"), "sequence_id").mapInArrow(_repack(size, limit), "sequence_id long, packed_id long, shift long")
    again = left.join(cut(moved), "sequence_id")
    again = again.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("packed_id").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return closed.unionByName(again)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary())
