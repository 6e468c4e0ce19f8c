"""Language identification with blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import cut, held_out, read, trained_on
from .tables import Numbers

#: Bounds of the training sample: distinct texts of each language, and how many of them are landmarks; texts of all
#: languages together; bytes of a text that counts as long, and bytes of a language's texts together. Of a language the
#: texts of smallest hash are taken, whole, those that aren't long first; a language has one at least.
SAMPLE, LANDMARKS, TOGETHER, LONG, BYTES = 400, 40, 20_000, 1 << 16, 1 << 22
#: n-gram lengths of the kernel; ridge; documents scored by one matrix product; characters worked on at once.
LENGTHS, RIDGE, ROWS = 3, 1e-3, 256
SPAN = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def spectrum(texts: list[str], lengths: int = LENGTHS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of every n-gram of the lower-cased texts, index of its text) of all n for each block of about SPAN characters.

    n-grams stay within a text. Long texts are cut into parts that overlap by lengths - 1 characters, so that every
    n-gram is met.
    """
    part, who, size = [], [], 0
    for k, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(1, len(low) - lengths + 1), SPAN):
            part.append(low[at : at + SPAN + lengths - 1])
            who.append(k)
            size += len(part[-1])
            if size >= SPAN:
                yield _grams(part, who, lengths)
                part, who, size = [], [], 0
    if part:
        yield _grams(part, who, lengths)


def _grams(parts: list[str], who: list[int], lengths: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = [len(p) for p in parts]
    place, owner = np.repeat(np.arange(len(parts)), sizes), np.repeat(np.array(who, np.int64), sizes)
    value = np.zeros(len(points), np.uint64)
    values, owners = [value[:0]], [owner[:0]]
    for n in range(1, min(lengths, len(points)) + 1):
        value = (value[: len(points) - n + 1] * np.uint64(0x1000193) + points[n - 1 :] + np.uint64(n)) * _FACTOR
        value ^= value >> np.uint64(32)
        inside = place[: len(value)] == place[n - 1 :]
        values.append(value[inside])
        owners.append(owner[: len(value)][inside])
    return np.concatenate(values), np.concatenate(owners)


def presence(grams: Numbers, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the n-grams each of up to ROWS texts holds, as a 0/1 matrix, and how many different n-grams it holds,
    those outside the set included."""
    out = np.zeros((len(texts), grams.used), np.float32)
    flat, count = out.ravel(), np.zeros(len(texts), np.int64)
    low, seen, owner = np.uint64(ROWS - 1), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def close(keys: np.ndarray) -> None:
        nonlocal count
        count += np.bincount((keys & low).astype(np.int64), minlength=len(texts))

    for value, owner in spectrum(texts):
        number = grams.find(value)
        hit = number >= 0
        flat[owner[hit] * grams.used + number[hit]] = 1
        # 56 bits of the n-gram over the text's number; the last text may go on in the next block
        keys = np.sort(np.concatenate([(value & ~low) | owner.astype(np.uint64), seen]))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        last = (keys & low) == np.uint64(owner.max(initial=0))
        close(keys[~last])
        seen = keys[last]
    close(seen)
    return out, count


@dataclasses.dataclass
class Model:
    """Kernel between texts x and y: the n-grams of 1 to LENGTHS characters that both hold, over the root of the
    product of how many each holds. Only n-grams of the landmarks can be held by both, so only these are numbered;
    sizes counts all that each landmark holds."""

    languages: list[str]
    grams: Numbers
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        held, own = presence(self.grams, texts)
        return held @ self.landmarks.T / np.sqrt(np.maximum(own, 1)[:, None] * np.maximum(self.sizes, 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        scores = self.kernel(texts) @ self.weights + self.bias
        share = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
        return [self.languages[k] for k in scores.argmax(axis=1)], share.max(axis=1) / share.sum(axis=1)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """One ridge regression against the rest for each language, on the Nyström features of the landmarks."""
    languages = sorted(set(langs))
    marks = [k for l in languages for k in [k for k, x in enumerate(langs) if x == l][:landmarks]]
    held = [texts[k] for k in marks]
    values = np.unique(np.concatenate([v for v, _ in spectrum(held)] or [np.zeros(0, np.uint64)]))
    model = Model(languages, Numbers(values), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    parts = [presence(model.grams, held[k : k + ROWS]) for k in range(0, len(held), ROWS)]
    model.landmarks, model.sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    kernel = lambda some: np.concatenate([model.kernel(some[k : k + ROWS]) for k in range(0, len(some), ROWS)])
    among = kernel(held).astype(np.float64)
    scale, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(scale, 1e-6 * max(scale.max(), 1e-6)))
    features = kernel(texts) @ root
    goal = np.array([[1.0 if x == l else -1.0 for l in languages] for x in langs])
    # rows weigh so that every language counts alike
    weight = np.array([1 / langs.count(x) for x in langs])[:, None]
    mean, middle = (weight * features).sum(axis=0) / weight.sum(), (weight * goal).sum(axis=0) / weight.sum()
    centred = features - mean
    solved = np.linalg.solve(centred.T @ (weight * centred) + RIDGE * np.eye(features.shape[1]), centred.T @ (weight * (goal - middle)))
    model.weights, model.bias = (root @ solved).astype(np.float32), (middle - mean @ solved).astype(np.float32)
    return model


def training_sample(docs: DataFrame, label: str, per_label: int, keep: F.Column, together: int = TOGETHER, long: int = LONG, bytes_of_label: int = BYTES, labels: DataFrame | None = None) -> list:
    """Rows (text, y) to learn from: of each label up to per_label different texts, those of smallest hash.

    label is a column of docs or, by doc_id, of labels. All labels that have a text are learnt; together bounds the
    texts of all labels, of which each label has one at least. Texts of more than long bytes are taken only where a
    label has no others, and then one; the texts of a label hold bytes_of_label bytes together, or are a single one.
    Null texts are left out. Copies count once, whatever their ids, so neither repeated nor missing ids can empty or
    swell the sample. Only hashes are shuffled, and only the sample and one count for each label come to the driver.
    """
    full = F.xxhash64(F.lit(3), "text")
    own = ["doc_id"] if labels is not None else [F.col(label).alias("y")]
    keys = docs.where(keep & F.col("text").isNotNull()).select(*own, full.alias("full"), (F.octet_length("text") > long).alias("long"))
    if labels is not None:
        keys = keys.join(labels.select(F.col("doc_id").alias("of"), F.col(label).alias("y")), F.col("doc_id") == F.col("of"))
    keys = cut(keys.where("y is not null").select("y", "full", "long", F.pmod("full", F.lit(1 << 30)).alias("h")))
    counts = keys.groupBy("y").agg(F.approx_count_distinct(F.when(~F.col("long"), F.col("h")), 0.05).alias("n"), F.min(F.when(F.col("long"), F.col("h"))).alias("one")).collect()
    if not counts:
        return []
    per_label = max(1, min(per_label, together // len(counts)))
    # about twice as many as wanted pass by hash, then the first by hash stay
    bounds = [(r["y"], int((1 << 30) * min(1.0, (2 * per_label + 50) / r["n"])) if r["n"] else -1, None if r["n"] else r["one"]) for r in counts]
    bounds = docs.sparkSession.createDataFrame(bounds, StructType([StructField("_y", keys.schema["y"].dataType), StructField("_below", LongType()), StructField("_one", LongType())]))
    chosen = keys.join(F.broadcast(bounds), F.col("y") == F.col("_y")).where((~F.col("long") & (F.col("h") < F.col("_below"))) | (F.col("long") & (F.col("h") == F.col("_one"))))
    chosen = F.broadcast(chosen.select("y", "full", "h").distinct())  # at most about twice `together` rows
    texts = docs.where("text is not null").select("text", full.alias("full"))
    found = sorted(texts.join(chosen, "full").select("y", "h", "text").distinct().collect(), key=lambda r: (r["h"], r["text"]))
    left, room, out = {r["y"]: per_label for r in counts}, {r["y"]: bytes_of_label for r in counts}, []
    for r in found:
        size = len(r["text"].encode("utf-8", "surrogatepass"))
        if left[r["y"]] and (size <= room[r["y"]] or left[r["y"]] == per_label):
            left[r["y"]] -= 1
            room[r["y"]] -= size
            out.append(r)
    return out


def train(docs: DataFrame, keep: F.Column | None = None, per_language: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """A model from a bounded sample of docs (text, lang, and what keep reads) with a language; None if there is none."""
    rows = training_sample(docs, "lang", per_language, F.lit(True) if keep is None else keep)
    return fit([r["text"] for r in rows], [r["y"] for r in rows], landmarks) if rows else None


def _has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@F.pandas_udf(BooleanType())
def has_letters(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text has any letter; false for null."""
    for t in texts:
        yield pd.Series([_has_letters(x) for x in t], dtype=bool)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1); columns of these names are replaced, all others stay.

    A null text, one without any letter, and every text where there was nothing to learn from get `und` and score 0.
    Texts are read whole. Only the text is an input of the prediction, so equal texts get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            out = pd.DataFrame({"lang": "und", "score": 0.0}, index=range(len(texts)))
            known = [k for k, t in enumerate(texts) if own and _has_letters(t)]
            for lo in range(0, len(known), ROWS):
                part = known[lo : lo + ROWS]
                langs, scores = own.predict([texts.iloc[k] for k in part])
                out.loc[part, "lang"], out.loc[part, "score"] = langs, scores
            yield out

    found = docs.withColumn("_lang", predict("text"))
    return found.withColumns({"lang_pred": F.col("_lang.lang"), "lang_score": F.col("_lang.score")}).drop("_lang")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, trained_on(0))
    return identify(docs.select("doc_id", "text", held_out(0).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
