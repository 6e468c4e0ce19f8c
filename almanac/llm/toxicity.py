"""Toxicity with a gap-weighted subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words sums, over all subsequences of three characters, the product of their weights in each: every
occurrence weighs DECAY to the power of the stretch it covers, so inserted or dropped characters lower a match but
don't lose it. Labels belong to whole texts, so training treats a text's sentences as bags of words: the words that tell
toxic texts from clean ones beyond chance must score above the margin, and those of clean texts may not.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read, trained_on
from .language_id import training_sample

#: Bound of the training sample (texts of each label), landmarks, and negatives kept for a round of training.
SAMPLE, LANDMARKS, NEGATIVES, ROUNDS = 1500, 256, 20_000, 4
#: One text in FOLD of the sample is kept back to set the scores by; words of a text that count.
FOLD, VOTES = 5, 3
#: Where the cut lies between clean and toxic texts of the fold, if they are apart.
NEAR = 0.25
#: How much more than others the negatives count that came near the margin; how many times more often than in clean
#: texts a word must occur in toxic ones to tell them.
HARD, TIMES = 10.0, 8
#: Weight of each character that an occurrence covers, and the most it may cover.
DECAY, REACH = 0.6, 6
#: Longer words are scored by overlapping windows of this many characters. Words remembered by a task.
WINDOW, MEMORY = 24, 400_000
_ALPHABET = 64
_NOISE = re.compile(r"[\W_]+")
_PATTERNS = [(j, k) for k in range(2, REACH) for j in range(1, k)]


def words(text: str | None) -> set[str]:
    """The words of a text, lower-cased; runs of single characters between blanks are joined into one word as well."""
    tokens = (text or "").lower().split()
    out = set(tokens)
    single = [k for k, w in enumerate(tokens) if len(w) == 1]
    run: list[int] = []
    for k in [*single, -9]:
        if run and k != run[-1] + 1:
            if len(run) > 2:
                out.add("".join(tokens[i] for i in run))
            run = []
        run.append(k)
    return out


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37)


def occurrences(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all occurrences in the words."""
    codes, sizes = _codes("".join(items)), [len(w) for w in items]
    owner = np.repeat(np.arange(len(items)), sizes)
    who, what, weight = [], [], []
    for j, k in _PATTERNS:
        n = len(codes) - k
        if n <= 0:
            continue
        inside = owner[:n] == owner[k:]
        who.append(owner[:n][inside])
        what.append((codes[:n] * _ALPHABET**2 + codes[j : j + n] * _ALPHABET + codes[k:])[inside])
        weight.append(np.full(len(who[-1]), DECAY ** (k + 1)))
    if not who:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in (who, what, weight))


def features(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), each subsequence once for a word, scaled to unit norm for each word."""
    who, what, weight = occurrences(items)
    pair, back = np.unique(who * _ALPHABET**3 + what, return_inverse=True)
    total = np.bincount(back, weight, len(pair))
    who, what = pair // _ALPHABET**3, pair % _ALPHABET**3
    norm = np.sqrt(np.bincount(who, total**2, len(items)))
    return who, what, total / norm[who]


@dataclasses.dataclass
class Model:
    """The machine folded into one weight for each subsequence: f(w) = weights . features(w) + bias. votes turn the
    largest f of a text and the sum of its VOTES largest, those above zero, into log odds; their last is the constant."""

    weights: np.ndarray
    bias: float
    votes: np.ndarray = dataclasses.field(default_factory=lambda: np.array([6.0, 0.0, 0.0]))

    @property
    def floor(self) -> float:
        """Words that can't reach this count as reaching it, so that their exact norm need not be worked out."""
        return -1.0

    def decide(self, items: list[str]) -> np.ndarray:
        """f of each word, the floor at least."""
        parts, of = [], []
        for k, w in enumerate(items):
            w = _NOISE.sub("", w)
            for lo in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2):
                parts.append(w[lo : lo + WINDOW])
                of.append(k)
        out = np.full(len(items), self.floor)
        for lo in range(0, len(parts), 20_000):
            some = parts[lo : lo + 20_000]
            who, what, weight = occurrences(some)
            top = np.bincount(who, weight * self.weights[what], len(some))
            least = np.sqrt(np.bincount(who, weight**2, len(some)))
            # occurrences of one subsequence add up, so this norm is a lower bound and the quotient an upper bound
            reach = np.nonzero((top > 0) & (top / np.maximum(least, 1e-12) + self.bias > self.floor))[0]
            if len(reach):
                a, b, c = features([some[k] for k in reach])
                f = np.bincount(a, c * self.weights[b], len(reach)) + self.bias
                np.maximum.at(out, np.array(of[lo : lo + 20_000])[reach], f)
        return out

    def evidence(self, f: Iterable[float]) -> list[float]:
        """The VOTES largest of the f of a text's different words, the floor where there are fewer."""
        return (sorted(f, reverse=True)[:VOTES] + [self.floor] * VOTES)[:VOTES]

    def score(self, f: np.ndarray) -> np.ndarray:
        """Scores of texts by their evidence, or by the largest f alone."""
        f = np.asarray(f, float)
        if f.ndim == 1:
            f = np.hstack([f[:, None], np.full((len(f), VOTES - 1), self.floor)])
        return 1 / (1 + np.exp(-np.clip(_tally(f) @ self.votes[:-1] + self.votes[-1], -500, 500)))


def _tally(f: np.ndarray) -> np.ndarray:
    """Of the evidence of texts the largest f and the sum, as far as they are above zero."""
    f = np.maximum(f, 0)
    return np.stack([f[:, 0], f.sum(axis=1)], axis=1)


def _dense(items: list[str], marks: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Kernel of the words with the landmarks; marks: their subsequences x landmarks, row: a subsequence's row."""
    out = np.zeros((len(items), marks.shape[1]), np.float32)
    for lo in range(0, len(items), 250):
        who, what, weight = features(items[lo : lo + 250])
        first = np.nonzero(np.append(True, who[1:] != who[:-1]))[0] if len(who) else who
        if len(who):
            out[lo + who[first]] = np.add.reduceat(weight[:, None] * marks[row[what]], first)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.0002) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine: Newton steps over the rows within the margin, halved until they help."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-3)
    loss = lambda w: (cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + (penalty * w**2).sum()
    now = loss(w)
    for _ in range(60):
        inside = y * (z @ w) < 1
        a = z[inside]
        step = np.linalg.solve(a.T @ (cost[inside, None] * a) + np.diag(penalty), a.T @ (cost[inside] * y[inside])) - w
        size = 1.0
        while size > 1e-4 and (then := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * now:
            break
        w, now = w + size * step, then
    return w[:-1], float(w[-1])


def _variants(word: str) -> list[str]:
    """A word with a character inserted near its middle, and with one doubled."""
    h = len(word) // 2
    return [f"{word[:h]}x{word[h:]}", f"{word[: h - 1]}o{word[h - 1 :]}", f"{word[: h + 1]}{word[h:]}"]


def _log_tail(n: int, total: int, share: float) -> float:
    """Log probability of n or more of total draws being toxic if each is with probability share."""
    terms = [math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(share) + (total - k) * math.log1p(-share) for k in range(n, total + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def proven(p: Counter, q: Counter, toxic: int, clean: int) -> set[str]:
    """Words that chance would not put into so many of the toxic texts and so few of the clean ones, however many words
    are tried. p and q: how many texts of either sort hold a word. Clean texts with a word count against it, but some of
    them (a wrong label, a quotation) don't clear it; a word of a single text proves nothing."""
    share, tried = toxic / (toxic + clean), sum(n > 1 for n in p.values())
    often = [w for w, n in p.items() if n > 1 and n * clean >= TIMES * q[w] * toxic]
    return {w for w in often if _log_tail(p[w], p[w] + q[w], share) < -np.log(20 * tried)}


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, rarity: float = 1.0) -> Model | None:
    """A model from texts of both labels; None if one label has none. rarity: how many clean texts there are for a toxic
    one where the model is used.

    Only proven words are positives, so a toxic text that has none stays unexplained and teaches nothing: its words are
    as likely to be the harmless ones. Scores are set on a fold of the texts that nothing else has seen.
    """
    whole = len(toxic) >= FOLD and len(clean) >= FOLD
    back = lambda texts: ([t for k, t in enumerate(texts) if not whole or k % FOLD < FOLD - 1], [t for k, t in enumerate(texts) if not whole or k % FOLD == FOLD - 1])
    (toxic, high), (clean, low) = back(toxic), back(clean)
    clear = lambda t: {c for w in words(t) if len(c := _NOISE.sub("", w)) > 2 and len(c) <= WINDOW}
    bags, rest = [clear(t) for t in toxic], [clear(t) for t in clean]
    p, q = Counter(w for b in bags for w in b), Counter(w for b in rest for w in b)
    if not p or not q:
        return None
    odds = {w: np.log((n + 0.5) / (len(bags) + 1)) - np.log((q[w] + 0.5) / (len(rest) + 1)) for w, n in p.items()}
    # of few texts nothing may be proven: then the word that tells most
    positive = proven(p, q, len(bags), len(rest)) or {max(p, key=lambda w: (odds[w] * np.log1p(p[w]), w))}
    common = sorted(q, key=lambda w: (-q[w], w))
    best = sorted(positive, key=lambda w: (-p[w], w))[: landmarks * 3 // 4]
    marked = best + common[: max(8, landmarks - len(best))]
    who, what, weight = features(marked)
    used = np.unique(what)
    row = np.full(_ALPHABET**3, len(used), np.int32)
    row[used] = np.arange(len(used))
    marks = np.zeros((len(used) + 1, len(marked)), np.float32)  # the last row is for all other subsequences
    marks[row[what], who] = weight
    scale, vectors = np.linalg.eigh(_dense(marked, marks, row))
    root = vectors / np.sqrt(np.maximum(scale, 1e-4 * scale.max()))
    spread = sorted(q, key=lambda w: hash_of(w))
    negative = set(spread[:NEGATIVES]) | set(common[:2000])
    everything, hard_ones = list(q), set(common[:2000])
    # a word weighs by the toxic texts that hold it, a variant of it a third as much
    mass = {v: p[w] / 3 for w in sorted(positive) for v in _variants(w)} | {w: float(p[w]) for w in positive}
    pos = sorted(mass)
    gain = np.array([mass[v] for v in pos])
    model = None
    for _ in range(ROUNDS):
        neg = sorted(negative - set(pos))
        x = _dense(pos + neg, marks, row) @ root
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        # negatives that came close to the margin weigh more
        loss = np.array([HARD if v in hard_ones else 1.0 for v in neg])
        w, bias = _machine(x, y, np.concatenate([500 * gain / gain.sum(), 500 * loss / loss.sum()]))
        model = Model((marks @ (root @ w)).astype(np.float32)[row], bias)
        hard = np.array(everything)[np.argsort(-model.decide(everything), kind="stable")[:NEGATIVES]].tolist()
        hard_ones |= set(hard[: NEGATIVES // 20])
        negative |= set(hard[: NEGATIVES // 4])
    seen = lambda texts: np.array([model.evidence(model.decide(sorted(words(t)))) for t in texts]).reshape(-1, VOTES)
    model.votes = _calibrate(_tally(seen(high)), _tally(seen(low)), rarity)
    return model


def hash_of(word: str) -> int:
    """A repeatable order of words."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _calibrate(high: np.ndarray, low: np.ndarray, rarity: float) -> np.ndarray:
    """Logistic regression on the evidence of texts, where `rarity` clean ones come on a toxic one: a word that now and
    then stands in clean texts needs others beside it. More evidence never lowers a score."""
    x = np.vstack([high, low])
    y = np.append(np.ones(len(high)), np.zeros(len(low)))
    weight = np.where(y > 0, 1 / len(high), rarity / len(low)) / (1 + rarity) * len(y)
    used = list(range(x.shape[1]))
    while True:
        z = np.hstack([x[:, used], np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        ridge = np.append(np.full(len(used), 0.1), 1e-4)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all() or len(used) == 1:
            break
        used = [u for u, v in zip(used, w[:-1], strict=True) if v >= 0] or [0]
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = np.maximum(w[:-1], 0), w[-1]
    below, above = (x[y == 0] @ out[:-1]).max(), (x[y > 0] @ out[:-1]).min()
    if below < above:
        # nothing in the fold contradicts any cut between them; it goes nearer to the clean texts, as insults that are
        # seen for the first time have less evidence than those of the fold
        out[-1] = -(below + NEAR * (above - below))
    return out


def train(docs: DataFrame, labels: DataFrame, keep: F.Column | None = None, per_label: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of docs (doc_id, text) with labels (doc_id, toxic 0 or 1).

    Where labels of one doc_id differ, 1 counts. Labels without a doc_id mark no document.
    """
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null and doc_id is not null")
    allowed = F.lit(True) if keep is None else keep
    many = {r["toxic"]: r["n"] for r in marked.where(allowed).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = training_sample(docs, "toxic", per_label, allowed, labels=marked)
    return fit([r["text"] for r in rows if r["y"]], [r["text"] for r in rows if not r["y"]], rarity=many.get(0, 0) / max(1, many.get(1, 0)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_pred (1 if at least 0.5); columns of these names are replaced.

    A text scores by its most toxic words. Null and empty texts score as a text of harmless words; without a model all
    texts score 0. Texts are read whole, and equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = sent.value, {}
        for texts in batches:
            out = np.full((len(texts), VOTES), own.floor if own else 0.0)
            for lo in range(0, len(texts) if own else 0, 500):
                bags = [words(t) for t in texts.iloc[lo : lo + 500]]
                if len(known) > MEMORY:
                    known.clear()
                new = list(set().union(*bags) - known.keys())
                known.update(zip(new, own.decide(new).tolist(), strict=True))
                out[lo : lo + len(bags)] = [own.evidence(map(known.__getitem__, b)) for b in bags]
            yield pd.Series(own.score(out) if own else np.zeros(len(texts)))

    return docs.withColumn("toxicity", rate("text")).withColumn("toxic_pred", (F.col("toxicity") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), trained_on(0))
    rated = score(docs.select("doc_id", "text", held_out(0).alias("held_out")), model)
    return rated.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.col("toxic_pred").alias("predicted"))
