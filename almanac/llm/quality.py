"""Quality of texts: random-indexing word vectors, pooled per document, and a small network with calibrated output.

Every word has a fixed index vector with a few entries of 1 and -1. A word's own vector is the sum of the index vectors of
its neighbours wherever it stands in the corpus, less what all words share, so words in like company have like vectors. A
text is the mean of its words' vectors beside the mean product of the vectors of words that follow each other, which
shows repetition and lists, both drawn towards the usual where a text has few words. Two layers in numpy turn these into a log odds; a temperature found on texts kept back from
the training and the share of the labels turn it into a probability.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read, trained_on
from .language_id import training_sample

#: Words are hashed to so many vectors of so many numbers; entries of an index vector; neighbours on each side.
WORDS, SIZE, ENTRIES, REACH = 1 << 14, 32, 4, 2
#: Bound of the training sample (texts of each label); units of the first layer; steps of its training; one text in FOLD
#: is kept back for the temperature.
SAMPLE, UNITS, STEPS, FOLD = 2500, 24, 500, 5
DECAY, RATE = 1e-2, 0.02
#: A text counts as if it had so many more words of the usual kind, so that few words tell little.
PRIOR_WORDS = 8
#: From this score on, a text is predicted to be good.
CUT = 0.3
#: Words handled at once, remembered words, and characters of a long text.
TOGETHER, MEMORY, LONG = 100_000, 400_000, 1_000_000
_WORD = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of each hashed word's index vector."""
    rng = np.random.default_rng(12)
    return rng.random((WORDS, SIZE)).argsort(axis=1)[:, :ENTRIES], rng.choice([-1.0, 1.0], (WORDS, ENTRIES))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return out


class Reader:
    """Texts -> hashed words: runs of letters and digits as they are written, and runs of signs."""

    def __init__(self) -> None:
        self.known = _Numbers()

    def numbers(self, text: str | None) -> Iterator[np.ndarray]:
        """The words of a text in order, a long one in parts."""
        text = text or ""
        found = (m.group() for m in _WORD.finditer(text)) if len(text) > LONG else iter([_WORD.findall(text)])
        while words := list(itertools.islice(found, TOGETHER)) if len(text) > LONG else next(found, []):
            if len(self.known) > MEMORY:
                self.known.clear()
            yield np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))


def _grouped(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """Hashed words of texts, in lists of about TOGETHER words."""
    reader, held, size = Reader(), [], 0
    for text in texts:
        for part in reader.numbers(text):
            held.append(part)
            size += len(part)
            if size > TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def company(parts: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of each word's neighbours over parts of texts, WORDS x SIZE."""
    gap = np.full(REACH, -1, np.int32)
    flat = np.concatenate([x for p in parts for x in (gap, p)] + [gap])
    at = np.nonzero(flat >= 0)[0]
    near = flat[at[:, None] + np.array([k for k in range(-REACH, REACH + 1) if k])]
    word, other = np.repeat(flat[at], 2 * REACH), near.ravel()
    word, other = word[other >= 0].astype(np.int64), other[other >= 0]
    return np.bincount((word[:, None] * SIZE + places[other]).ravel(), signs[other].ravel(), WORDS * SIZE).reshape(WORDS, SIZE)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all hashed words, learnt from every whole text of docs. Each task adds up what it reads and sends
    one row of sums for a word, so what is shuffled depends on the tasks and not on the words read; the result has
    WORDS x SIZE numbers."""
    names = [f"v{k}" for k in range(SIZE)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, signs), sums, seen = index_vectors(), np.zeros((WORDS, SIZE)), np.zeros(WORDS)

        def passed() -> pa.RecordBatch:
            some = np.nonzero(seen)[0]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c[some].astype(np.int64)) for c in (seen, *sums.T))], names=["word", "n", *names])

        for parts in _grouped(t for b in batches for t in b.column(0).to_pylist()):
            sums += company(parts, places, signs)
            seen += np.bincount(np.concatenate(parts), minlength=WORDS)
        yield passed()

    counted = docs.select("text").mapInArrow(count, "word int, n long, " + ", ".join(f"{n} long" for n in names))
    rows = counted.groupBy("word").agg(*(F.sum(n).cast("double").alias(n) for n in ("n", *names))).toPandas()
    out = np.zeros((WORDS + 1, SIZE))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    own = unit(rows[names].to_numpy())
    n = rows["n"].to_numpy()[:, None]
    # frequent words stand beside all others, so all vectors share a part that tells nothing
    out[rows["word"].to_numpy()] = unit(own - (n * own).sum(axis=0) / max(1.0, n.sum()))
    return out.astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sums over its words (their vectors; the products with those of the words before; the sum of
    these), and how many words it has."""
    out, n = np.zeros((len(texts), 2 * SIZE + 1)), np.zeros(len(texts))
    reader, held, of, size = Reader(), [], [], 0

    def add() -> None:
        flat = np.concatenate(held)
        owner = np.repeat(of, [len(p) for p in held])
        rows = vectors[flat]
        first = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
        product = np.zeros_like(rows)
        np.multiply(rows[1:], rows[:-1], out=product[1:])
        product[first] = 0
        out[owner[first], :SIZE] += np.add.reduceat(rows, first, axis=0)
        out[owner[first], SIZE:-1] += np.add.reduceat(product, first, axis=0)
        n[owner[first]] += np.diff(np.append(first, len(flat)))

    for k, text in enumerate(texts):
        for part in reader.numbers(text):
            held.append(part)
            of.append(k)
            size += len(part)
            if size > TOGETHER:
                add()
                held, of, size = [], [], 0
    if held:
        add()
    out[:, -1] = out[:, SIZE:-1].sum(axis=1)
    return out, n


def features(texts: list[str | None], vectors: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The means of pooled(), each text with PRIOR_WORDS words of the usual means besides its own."""
    sums, n = pooled(texts, vectors)
    return (sums + PRIOR_WORDS * usual) / (n + PRIOR_WORDS)[:, None]


@dataclasses.dataclass
class Model:
    """vectors of the words; usual features; their middle and spread; the two layers; temperature; log odds of the labels."""

    vectors: np.ndarray
    usual: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = _forward(self.layers, (features(texts, self.vectors, self.usual) - self.middle) / self.spread)[1]
        return np.round(_sigmoid(z / self.temperature + self.prior), 6)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = layers
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c


def gradients(layers: tuple, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Of the weighted log loss with decay, for each of the layers."""
    w, _, v, _ = layers
    hidden, z = _forward(layers, x)
    back = weight * (_sigmoid(z) - y)
    inner = back[:, None] * v * (1 - hidden**2)
    return x.T @ inner + DECAY * w, inner.sum(axis=0), hidden.T @ back + DECAY * v, back.sum()


def train_layers(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Adam over all rows at once from a fixed start."""
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], UNITS)), np.zeros(UNITS), rng.normal(0, 1 / np.sqrt(UNITS), UNITS), 0.0]
    first, second = [0.0] * 4, [0.0] * 4
    for t in range(1, STEPS + 1):
        for k, g in enumerate(gradients(tuple(layers), x, y, weight)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> float:
    """The one of a grid under which the texts kept back are likeliest."""
    grid = np.geomspace(0.25, 16, 49)
    loss = [float((weight * (np.logaddexp(0, s) - y * s)).sum()) for s in (z / t + prior for t in grid)]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], y: list[int], share: float, vectors: np.ndarray) -> Model:
    """A model from texts with labels of both kinds; share: of label 1 among all that is labelled."""
    y = np.array(y, float)
    sums, n = pooled(texts, vectors)
    usual = sums[y > 0].sum(axis=0) / max(1.0, n[y > 0].sum())
    x, back = (sums + PRIOR_WORDS * usual) / (n + PRIOR_WORDS)[:, None], np.arange(len(y)) % FOLD == FOLD - 1
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    middle, spread = x[~back].mean(axis=0), np.maximum(x[~back].std(axis=0), 1e-3)
    x = (x - middle) / spread
    even = lambda some: np.where(y[some] > 0, 0.5 / max(1, y[some].sum()), 0.5 / max(1, (1 - y[some]).sum()))
    layers = train_layers(x[~back], y[~back], even(~back))
    prior = float(np.log(share) - np.log1p(-share))
    kept = back if back.any() else ~back
    t = temperature(_forward(layers, x[kept])[1], y[kept], even(kept) * np.where(y[kept] > 0, 2 * share, 2 * (1 - share)), prior)
    return Model(vectors, usual, middle, spread, layers, t, prior)


def train(docs: DataFrame, labels: DataFrame, keep: F.Column | None = None, per_label: int = SAMPLE) -> Model | float:
    """A model: word vectors of all docs (doc_id, text), and a network fitted on a bounded sample of those with labels
    (doc_id, quality 0 or 1); where labels are all alike or missing, the score that all texts get.

    Where labels of one doc_id differ, the lower counts. Labels without a doc_id mark no document.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    allowed = F.lit(True) if keep is None else keep
    many = {r["quality"]: r["n"] for r in marked.where(allowed).where("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = sorted(training_sample(docs, "quality", per_label, allowed, labels=marked.where("quality in (0, 1)")), key=lambda r: (r["h"], r["text"]))
    kinds = {r["y"] for r in rows}
    if len(kinds) < 2:
        return float(kinds.pop()) if kinds else 0.5
    return fit([r["text"] for r in rows], [r["y"] for r in rows], many[1] / (many[0] + many[1]), word_vectors(docs))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs with quality_score (0 to 1) and quality_pred (1 if at least CUT); columns of these names are replaced.

    Texts are read whole, and equal texts get equal scores. Null and empty texts score as texts without words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in batches:
            yield pd.Series(own.score(list(texts)) if isinstance(own, Model) else np.full(len(texts), own))

    return docs.withColumn("quality_score", rate("text")).withColumn("quality_pred", (F.col("quality_score") >= CUT).cast("int"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), trained_on(0))
    rated = score(docs.select("doc_id", "text", held_out(0).alias("held_out")), model)
    return rated.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))
