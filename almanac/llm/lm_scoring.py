"""Log-likelihood of whole documents under a gated recurrent language model, beside a smoothed unigram model."""

from __future__ import annotations

import dataclasses
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recurrent
from .common import cut, held_out, read, trained_on

#: Bound of the most frequent words whose counts every task holds; counts of the others are joined.
HEAD = 150_000
#: Words with an output of their own, words of a class, classes of rarer words by spelling, size of the state.
WORDS, PER_CLASS, TAILS, HIDDEN = 2000, 50, 32, 16
#: Words of a block of training documents; slices of the training documents, each of which is learnt from once: after
#: each the weights of its blocks are averaged, and the next slice goes on from there; words that make a block anyway.
TASK_WORDS, SLICES, SMALLEST = 400_000, 8, 25_000
#: Bytes of text whose words are held at once; a longer text is held alone.
HELD = 8 << 20


def tail_of(word: bytes) -> int:
    """The class of a rarer word: by its last three bytes."""
    return zlib.crc32(word[-3:]) % TAILS


def _held(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where stretches of texts of about HELD bytes begin and end."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64) // HELD
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return ((lo, hi) for lo, hi in itertools.pairwise(edges) if lo < hi)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (null: none), in lower case and one after another, and where those of each text begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten().cast(pa.binary()), np.asarray(lists.offsets, np.int64)
    # white space at the ends of a text leaves empty words
    filled = np.asarray(pc.binary_length(words)) > 0
    if not filled.all():
        words, offsets = words.filter(pa.array(filled)), np.append(0, np.cumsum(filled))[offsets]
    return words, offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        for lo, hi in _held(texts):
            counts = pc.value_counts(_words(texts.slice(lo, hi - lo))[0])
            ends = pa.array([b""], pa.binary()), pa.array([hi - lo], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([counts.field(k), end]) for k, end in enumerate(ends)], names=["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs; the end of a text counts as the empty word."""
    return docs.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclasses.dataclass
class Lexicon:
    """Counts of the training words: totals, the most frequent words, and the mass of each class of rarer ones."""

    total: int
    distinct: int
    words: pa.Array
    counts: np.ndarray
    ids: np.ndarray
    base: np.ndarray
    inner: np.ndarray
    mass: np.ndarray
    shape: recurrent.Shape
    log_tail: np.ndarray
    log_all: float

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the frequent ones (-1: not there) and its id for the network."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1))
        ids = self.ids[place]
        rare = np.flatnonzero(place < 0)
        ends = pc.binary_slice(words.take(pa.array(rare)), -3).dictionary_encode()
        tails = np.array([tail_of(x) for x in ends.dictionary.to_pylist()], np.int64)
        ids[rare] = self.shape.words + tails[np.asarray(ends.indices)]
        return place, ids


def lexicon(counts: DataFrame) -> Lexicon:
    # the frequent words: whole steps of a fine scale of counts, as many as hold HEAD words at most, so that no more
    # than these words come to the driver, however many tasks hold the counts
    step = F.floor(F.log2("c") * 64).cast("int")
    low, room = 1 << 20, HEAD
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r["c"] for r in steps), sum(r["n"] for r in steps)
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        low = r["step"]
    top = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(step >= low).collect()), key=lambda x: (-x[1], x[0]))
    end = next((r["c"] for r in counts.where(F.octet_length("word") == 0).collect()), 0)
    top = [(w, c) for w, c in top if w]
    shape = recurrent.Shape(max(1, min(WORDS, len(top))), PER_CLASS, TAILS, HIDDEN)
    tail, mass = np.full(TAILS, 0.5), np.zeros(shape.start)
    by = counts.where(F.octet_length("word") > 0).groupBy((F.crc32(F.substring("word", -3, 3)) % TAILS).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    for r in by.collect():
        tail[r["k"]] += r["c"] + 0.5 * r["n"]
        mass[shape.words + r["k"]] += r["c"]
    for k, (w, c) in enumerate(top[: shape.words]):
        tail[tail_of(w)] -= c + 0.5
        mass[shape.words + tail_of(w)] -= c
        mass[k] = c
    mass[shape.end] = end
    c = np.array([c for _, c in top] + [0.0])
    ids = np.array([k if k < shape.words else shape.words + tail_of(w) for k, (w, _) in enumerate(top)] + [0])
    log_all = math.log10(total + 0.5 * (distinct + 1))
    log_tail = np.log10(tail)
    inner = np.where(ids < shape.words, 0.0, np.log10(c + 0.5) - log_tail[np.maximum(ids - shape.words, 0)])
    return Lexicon(total, distinct, pa.array([w for w, _ in top], pa.binary()), c, ids, np.log10(c + 0.5) - log_all, inner, mass, shape, log_tail, log_all)


_ENCODED = "row long, doc_id long, held_out boolean, learn boolean, n_tokens long, n_known long, base double, inner double, ids binary, words array<binary>, times array<int>"


def _encode(sent):
    """Of each text the ids of its words, two bytes each, what its frequent words add to both scores, and its rarer
    words with their numbers, whose counts are joined later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        first, done = TaskContext.get().partitionId() << 33, 0
        end = own.mass[own.shape.end]
        for batch in batches:
            for lo, hi in _held(batch.column("text")):
                part, n = batch.slice(lo, hi - lo), hi - lo
                words, offsets = _words(part.column("text"))
                # different words are looked up once
                words = words.dictionary_encode()
                code, words = np.asarray(words.indices), words.dictionary
                place, own_ids = own.ids_of(words)
                frequent = place >= 0
                text = np.repeat(np.arange(n), np.diff(offsets))
                tails = np.where(frequent, 0, own_ids - own.shape.words)
                base = np.bincount(text, np.where(frequent, own.base[place], -own.log_all)[code], n) + math.log10(end + 0.5) - own.log_all
                inner = np.bincount(text, np.where(frequent, own.inner[place], -own.log_tail[tails])[code], n)
                known = np.bincount(text, frequent[code], n).astype(np.int64) + (end > 0)
                left = np.flatnonzero(~frequent[code])
                rare, times = np.unique(text[left] * len(words) + code[left], return_counts=True)
                starts = pa.array(np.searchsorted(rare, np.arange(n + 1) * len(words)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, x) for x in (words.take(pa.array(rare % max(1, len(words)))), pa.array(times, pa.int32()))]
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(own_ids.astype("<u2")[code])])
                columns = [pa.array(np.arange(first + done, first + done + n)), *(part.column(c) for c in ("doc_id", "held_out", "learn"))]
                columns += [pa.array(np.diff(offsets) + 1), pa.array(known), pa.array(base), pa.array(inner), ids, *lists]
                done += n
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ENCODED.split(", ")])

    return run


def encoded(docs: DataFrame, sent, learn: F.Column, held: F.Column) -> DataFrame:
    """Each row of docs (doc_id, text) encoded, once for training and scoring."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), learn.alias("learn"))
    return cut(source.mapInArrow(_encode(sent), _ENCODED))


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts as one row; as several where a repeated text makes the task larger than twice the wanted size.
    All rows of a task are of one slice."""
    ids, sizes, words = [], [], 0
    slice_ = TaskContext.get().partitionId() % SLICES

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(ids)], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([slice_], pa.int32())], names=["ids", "sizes", "slice"])

    for batch in batches:
        for own in batch.column(0).to_pylist():
            ids.append(own)
            sizes.append(len(own) // 2)
            words += sizes[-1] + 1
            if words > 2 * TASK_WORDS:
                yield flush()
                ids, sizes, words = [], [], 0
    if sizes:
        yield flush()


def _learn(shape: recurrent.Shape, flat):
    """One pass over each block from the same weights: their mean by words learnt from, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = flat.value
        total, n = np.zeros(len(start)), 0
        for batch in batches:
            for ids, sizes in zip(batch.column("ids"), batch.column("sizes"), strict=True):
                texts = np.split(np.frombuffer(ids.as_py(), "<u2"), np.cumsum(sizes.as_py())[:-1])
                weights, learnt = recurrent.train(shape, start, texts)
                total += weights.astype(np.float64) * learnt
                n += learnt
        if n:
            weights = (total / n).astype(np.float32)
            parts = [weights[k : k + 4096] for k in range(0, len(weights), 4096)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.float32()))], names=["slot", "part", "n", "w"])

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    w = np.average(np.stack(rows["w"]).astype(np.float64), axis=0, weights=rows["n"])
    return pd.DataFrame({"slot": [rows["slot"].iloc[0]], "part": [0], "n": [rows["n"].sum()], "w": [w.astype(np.float32)]})


def blocks(rows: DataFrame, own: Lexicon) -> DataFrame:
    """All of rows (doc_id, ids) in rows of about TASK_WORDS words (fewer where that gives a row for each slice): the
    ids of the words, the sizes of the texts, and the slice."""
    parts = max(1, math.ceil(own.total / TASK_WORDS), min(SLICES, own.total // SMALLEST))
    dealt = rows.select("ids", F.xxhash64(F.lit(12), "doc_id", "ids").alias("h")).repartition(parts, "h").sortWithinPartitions("h", "ids")
    return cut(dealt.select("ids").mapInArrow(_block, "ids binary, sizes array<int>, slice int"))


def fit(rows: DataFrame, own: Lexicon) -> np.ndarray:
    """Network weights, learnt from every row of rows (doc_id, ids) once. The blocks of a slice are trained on from the
    weights that the slice before left, and the results are averaged by words learnt from, within a task, 64 tasks at
    a time and then all; only the averaged weights, whose size is fixed, come to the driver."""
    flat = recurrent.initial(own.shape, own.mass)
    read_all = blocks(rows, own)
    schema = "slot int, part int, n long, w array<float>"
    for number in sorted(r["slice"] for r in read_all.select("slice").distinct().collect()):
        some = read_all.where(F.col("slice") == number)
        trained = some.mapInArrow(_learn(own.shape, rows.sparkSession.sparkContext.broadcast(flat)), schema)
        some_means = trained.groupBy("slot", F.floor(F.col("part") / 64).alias("_p")).applyInPandas(_average, schema)
        means = some_means.groupBy("slot").applyInPandas(_average, schema).collect()
        flat = np.concatenate([np.array(r["w"], np.float32) for r in sorted(means, key=lambda r: r["slot"])])
    return flat


def _score(shape: recurrent.Shape, flat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = flat.value
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column("ids").to_pylist()]
            model = recurrent.score(shape, weights, ids) / math.log(10) + np.asarray(batch.column("inner"))
            kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model)], names=[*kept, "model"])

    return run


def likelihoods(docs: DataFrame, learn_from: F.Column, held: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id long, text).

    Null and empty texts have one token, the end. base_score is the log10 probability under the smoothed unigram
    model of all documents that learn_from marks, score that under the network trained on them: words of its
    vocabulary have an output each; a rarer one has its spelling class's probability times its smoothed share of that
    class, where an unseen word gets half a count. Rows that repeat a doc_id are scored each for themselves. Where
    there is nothing to learn from, every count is zero. An empty table gives an empty result; further columns are
    ignored.
    """
    context = docs.sparkSession.sparkContext
    counts = cut(word_counts(docs.where(learn_from)))
    own = lexicon(counts)
    rows = encoded(docs, context.broadcast(own), learn_from, held)
    flat = context.broadcast(fit(rows.where("learn").select("doc_id", "ids"), own))
    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "ids").mapInArrow(_score(own.shape, flat), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = scored.join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(own.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihoods(read(spark, sf_dir, "documents"), trained_on(1), held_out(1))
