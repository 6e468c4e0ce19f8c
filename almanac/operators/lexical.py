"""Lexical vectors: what the words, word pairs and character runs of a text add up to in a fixed number of buckets.

A whole batch of texts is one set of arrays: features are numbers, counted by (text, feature) and summed by bucket.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import text as tx

# fixed values: buckets, and the runs of characters that count, of words of this length or more, and how much they do
BUCKETS, RUN, LONG_WORD, RUN_SHARE = 384, 4, 5, 0.5
#: Characters of the texts that are handled at once; a longer text is handled alone.
TOGETHER = 1_000_000

_WORD = re.compile(r"[\wͰ-῿Ⲁ-ⷿ]+")
_SILENT = frozenset(tx.STOP_WORDS)
_PAIR, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Vectorizer(Protocol):
    """What turns texts into vectors: any object that can be sent to tasks and has these."""

    size: int

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row of `size` numbers for each text."""


def words(text: str) -> list[str]:
    """The words of functions.text.tokens(), for code inside tasks."""
    return [w for w in _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if w not in _SILENT]


def scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """The words of some texts: word[k] stands in text owner[k]; names are the different words and number theirs."""

    def __init__(self, texts: list[str | None]) -> None:
        known: dict[str, int] = {}
        rows = [[known.setdefault(w, len(known)) for w in words(t or "")] for t in texts]
        self.texts, self.names = len(texts), list(known)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.word = np.array([w for r in rows for w in r], np.int64)
        self.number = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.names], np.uint64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, number) of each two words that follow each other."""
        inside = self.owner[1:] == self.owner[:-1]
        a, b = self.number[self.word[:-1][inside]], self.number[self.word[1:][inside]]
        return self.owner[1:][inside], scrambled(a * _PAIR + b)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, number) of the runs of RUN characters of each long word between ^ and $."""
        long = [k for k, w in enumerate(self.names) if len(w) >= LONG_WORD]
        shown = [f"^{self.names[k]}$" for k in long]
        codes = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.repeat(np.array(long, np.int64), [len(w) for w in shown])
        n = max(0, len(codes) - RUN + 1)
        value = np.zeros(n, np.uint64)
        for k in range(RUN):
            value = value * _STEP + codes[k : k + n] + np.uint64(1)
        inside = of[:n] == of[RUN - 1 :] if n else np.zeros(0, bool)
        return of[:n][inside], scrambled(value[inside])

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, numbers) of the different words of each text, in order."""
        pair = np.unique(self.owner * max(1, len(self.names)) + self.word)
        owner, value = pair // max(1, len(self.names)), self.number[pair % max(1, len(self.names))].view(np.int64)
        order = np.lexsort((value, owner))
        return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=self.texts))]), value[order]


class LexicalVectors:
    """Words, word pairs and the character runs of long words, each hashed with a sign to a bucket.

    A feature weighs 1 + ln(count), a run counts half; vectors have unit length, or are zero.
    """

    def __init__(self, size: int = BUCKETS) -> None:
        self.size = size

    def vectors(self, texts: list[str | None], batch: Batch | None = None) -> np.ndarray:
        own = batch or Batch(texts)
        text, count = np.unique(own.owner * max(1, len(own.names)) + own.word, return_counts=True)
        text, word = text // max(1, len(own.names)), text % max(1, len(own.names))
        pair_text, pair = own.pairs()
        run_word, run = own.runs()
        # each (text, word) meets the runs of its word
        many = np.bincount(run_word, minlength=len(own.names)).astype(np.int64)
        first = np.cumsum(many) - many
        each = many[word] if len(own.names) else np.zeros(0, np.int64)
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        run_at = np.argsort(run_word, kind="stable")[np.repeat(first[word], each) + within] if len(within) else within
        owner = np.concatenate([text, pair_text, np.repeat(text, each)])
        feature = np.concatenate([own.number[word], pair, run[run_at]]) if len(owner) else np.zeros(0, np.uint64)
        amount = np.concatenate([count, np.ones(len(pair)), RUN_SHARE * np.repeat(count, each)])
        _, one, back = np.unique(scrambled(feature ^ scrambled(owner.astype(np.uint64))), return_index=True, return_inverse=True)
        weight = 1 + np.log(np.bincount(back, amount, len(one)))
        sign = np.where(feature[one] >> np.uint64(63), 1.0, -1.0)
        place = owner[one] * self.size + (feature[one] % np.uint64(self.size)).astype(np.int64)
        out = np.bincount(place, sign * weight, own.texts * self.size).reshape(own.texts, self.size)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


#: A vector without its zeros.
SPARSE = [T.StructField("size", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]
#: Numbers of vectors that are filled at once.
FILLED = 1 << 20


def dense(rows: DataFrame) -> DataFrame:
    """rows with vector in place of size, places and weights."""
    names = [n for n in rows.columns if n not in {f.name for f in SPARSE}]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            largest = max(batch.column("size").to_pylist(), default=0)
            step = max(1, FILLED // max(1, largest))
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                start = np.concatenate([[0], np.cumsum(np.asarray(part.column("size"), np.int64))])
                places = part.column("places")
                at = np.repeat(start[:-1], np.asarray(places.value_lengths())) + np.asarray(places.flatten())
                out = np.zeros(start[-1])
                out[at] = np.asarray(part.column("weights").flatten())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(out))], names=schema.names)

    return rows.select(*names, *(f.name for f in SPARSE)).mapInArrow(run, schema)


def embed(texts: DataFrame, key: str, vectorizer: Vectorizer | None = None, keep: list[str] | None = None, sparse: bool = False) -> DataFrame:
    """key, the kept columns, vector and tokens (numbers of the different words, sorted) for texts (key, text).

    Null and blank texts have the zero vector and no tokens. Any Vectorizer takes the place of the lexical one. sparse:
    instead of vector its size, and places and weights of what isn't zero in it; dense() makes vectors of these.
    """
    own, names = vectorizer or LexicalVectors(), [key, *(keep or [])]
    made = SPARSE if sparse else [T.StructField("vector", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*(texts.schema[n] for n in names), *made, T.StructField("tokens", T.ArrayType(T.LongType()))])

    def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
        start = total = 0
        for k, n in enumerate(sizes):
            if k > start and total + n > TOGETHER:
                yield start, k
                start, total = k, 0
            total += n
        if start < len(sizes):
            yield start, len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column("_text").to_pylist()
            for a, b in groups([len(t or "") for t in all_]):
                read = Batch(all_[a:b])
                rows = own.vectors(all_[a:b], read) if isinstance(own, LexicalVectors) else np.asarray(own.vectors([t or "" for t in all_[a:b]]), np.float64)
                offsets, tokens = read.sets()
                if sparse:
                    at, places = np.nonzero(rows)
                    ends = pa.array(np.searchsorted(at, np.arange(b - a + 1)).astype(np.int32))
                    vector = [pa.array(np.full(b - a, own.size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(rows[at, places].astype(np.float64)))]
                else:
                    vector = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * own.size), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), *vector, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))], names=schema.names)

    return texts.select(*names, texts["text"].alias("_text")).mapInArrow(run, schema)
