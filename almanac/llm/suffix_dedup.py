"""Removal of repeated long passages with suffix arrays in a logarithmic family of levels.

A string of SPAN bytes holds exactly one anchor: its k-gram of smallest hash, the first on ties. Equal strings have
equal anchors, so only strings whose anchor occurs again can repeat, and all strings of an anchor meet in one place.
The strings of a text that share one anchor occurrence start at neighbouring bytes and form a segment. Identical
segments are counted as one form first. The forms of anchors that occur in several forms are indexed: a batch of
suffixes is sorted into a suffix array of places in the bytes held, merge-scanned against every level for common
prefixes of SPAN bytes, and becomes a level; levels of like size merge, so that a suffix takes part in a logarithmic
number of merges. An anchor of very many forms is dealt to parts, each with a family of its own, and the different
strings of the parts are then indexed across the parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Bytes of an anchor. A string has SPAN - GRAM + 1 of them to choose from.
SPAN, GRAM = 200, 64
#: Bytes of text that are worked on at once; suffixes of a batch, of a stretch of a level that is scanned at once, and
#: of a family to which no further anchor is added.
BLOCK, BATCH, STRETCH, FAMILY = 1 << 20, 1 << 14, 1 << 13, 1 << 18
#: Forms of one anchor that are indexed in one family: at most 137 suffixes each, 9 bytes a suffix beside the bytes of
#: the form. An anchor with more is dealt to parts of about so many.
FORMS = 2000
#: A key that holds more than one row in this many is joined by broadcast: there can't be more such keys.
HOT = 1000
_BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


_POWERS: list[np.ndarray] = []
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        grow = lambda b: np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64)))
        _POWERS[:] = [grow(_BASE), grow(pow(_BASE, -1, 1 << 64))]
    return _POWERS


def segments(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end in data; ends: where each text ends, in order.

    Returns (start, number of string starts, anchor hash, segment hash), starts counted in data. The segment hash
    covers the bytes of all its strings and the anchor's place among them; with the anchor's hash it names a form.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    power, inverse = _powers(n)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:n]))
    grams = _mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    window = span - gram + 1
    # the first of the smallest k-grams of every window: minima of 40 bits of hash over 24 of place
    key = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(key) // window)
    padded = np.full(rows * window, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    padded = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - span + 1
    anchor = (np.minimum(back[:count], ahead[window - 1 : window - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
    # strings that run over the end of their text do not count
    owner = np.searchsorted(ends, np.arange(0, n, 1), side="right") if len(ends) < 2 else np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    valid = owner[:count] == owner[span - 1 :]
    change = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:count] != owner[: count - 1]) | ~valid[:-1])
    heads = np.nonzero(change & valid)[0]
    tails = np.nonzero(valid & np.append(change[1:] | ~valid[1:], True))[0]
    m = tails - heads + 1
    at, view, digest = anchor[heads], memoryview(data), xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(view[a:b], c) for a, b, c in zip(heads.tolist(), (heads + m - 1 + span).tolist(), (at - heads).tolist(), strict=True)), np.uint64, len(heads))
    return heads, m, grams[at], whole


def _blocks(keys: list, texts: list[str | None], span: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, offsets, data, ends) of parts of texts, about BLOCK bytes at once; parts of one text overlap by span - 1."""
    part: list[bytes] = []
    who: list = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(part), np.uint8)
        return [k for k, _ in who], np.array([o for _, o in who]), data, np.cumsum([len(p) for p in part])

    for key, text in zip(keys, texts, strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for lo in range(0, max(1, len(raw) - span + 1), BLOCK):
            piece = raw[lo : lo + BLOCK + span - 1]
            if len(piece) < span:
                continue
            part.append(piece)
            who.append((key, lo))
            size += len(piece)
            if size >= BLOCK:
                yield flush()
                part, who, size = [], [], 0
    if part:
        yield flush()


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("m", pa.int32()), ("anchor", pa.int64()), ("seg", pa.int64())])


def _scan(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("h")
            for who, offsets, data, ends in _blocks(list(range(len(batch))), batch.column("text").to_pylist(), span):
                start, m, anchor, seg = segments(data, ends, span, gram)
                part = np.searchsorted(ends, start, side="right")
                row = np.array(who)[part] if len(part) else part
                begin = start - np.append(0, ends[:-1])[part] + offsets[part]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(rows), hashes.take(rows), pa.array(begin), pa.array(m.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))], schema=_ANCHORS)

    return run


class SuffixLevels:
    """Suffixes of the texts added, each as its place in their bytes, sorted by their first `span` bytes, in levels of
    geometrically growing size. Of equal suffixes one is kept; `repeated` marks the places of all."""

    def __init__(self, span: int) -> None:
        self.span, self.levels, self.size = span, [], 0
        self.data, self.repeated = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool)

    def hold(self, raw: bytes) -> int:
        """Keep the bytes of a text; returns where they begin."""
        begin, self.size = self.size, self.size + len(raw)
        while self.size > len(self.data):
            self.data, self.repeated = (np.concatenate([x, np.zeros_like(x)]) for x in (self.data, self.repeated))
        self.data[begin : self.size] = np.frombuffer(raw, np.uint8)
        return begin

    def _keys(self, places: np.ndarray) -> np.ndarray:
        """The suffixes at the places, up to `span` bytes. All are equally long, so comparing them as strings is exact."""
        return np.lib.stride_tricks.sliding_window_view(self.data, self.span)[places].view(f"S{self.span}").ravel()

    def _merge_scan(self, level: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: where each goes in a level, and the place there of an equal suffix, -1 if there is none."""
        into, equal = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        fences = np.searchsorted(keys, self._keys(level[::STRETCH]), "left")
        fences[0] = 0
        for k, lo in enumerate(fences.tolist()):
            hi = int(fences[k + 1]) if k + 1 < len(fences) else len(keys)
            if lo == hi:
                continue
            stretch = level[k * STRETCH : (k + 1) * STRETCH]
            held = self._keys(stretch)
            at = np.searchsorted(held, keys[lo:hi])
            into[lo:hi] = k * STRETCH + at
            inside = np.nonzero(at < len(held))[0]
            same = inside[held[at[inside]] == keys[lo:hi][inside]]
            equal[lo + same] = stretch[at[same]]
        return into, equal

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        into = np.concatenate([self._merge_scan(a, self._keys(b[k : k + BATCH]))[0] for k in range(0, len(b), BATCH)])
        return np.insert(a, into, b)

    def add(self, places: np.ndarray) -> None:
        """Index a batch of suffixes."""
        keys = self._keys(places)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        same = keys[1:] == keys[:-1]
        self.repeated[places[np.append(False, same) | np.append(same, False)]] = True
        first = np.append(True, ~same)
        keys, places = keys[first], places[first]
        known = np.zeros(len(keys), bool)
        for level in self.levels:
            _, equal = self._merge_scan(level, keys)
            hit = equal >= 0
            self.repeated[equal[hit]] = True
            known |= hit
        self.repeated[places[known]] = True
        if len(places := places[~known]):
            self.levels.append(places)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b))

    def distinct(self) -> np.ndarray:
        """One place of each different suffix, in order of the places."""
        return np.sort(np.concatenate([*self.levels, np.zeros(0, np.int64)]))


_HITS = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("string", pa.binary())])
_HITS_SQL = "anchor long, seg long, lo int, hi int, string binary"


def _index(span: int, strings: bool = False):
    """Rows (anchor, part, seg, at, bytes, copies) sorted by anchor and part: for each form the starts that repeat, as
    ranges counted from `at`. With strings, also every different string of a part, once, with its bytes.

    Matches need equal anchors, so a new family begins once an anchor's part ends and enough has been indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, waiting, pending, forms = SuffixLevels(span), [], 0, []

        def feed() -> None:
            nonlocal pending
            if waiting:
                levels.add(np.concatenate(waiting))
                waiting.clear()
                pending = 0

        def result() -> Iterator[pa.RecordBatch]:
            feed()
            if not forms:
                return
            begin, anchor, seg, at, m, copies = (np.array(x) for x in zip(*forms, strict=True))
            for b, n in zip(begin[copies > 1].tolist(), m[copies > 1].tolist(), strict=True):
                levels.repeated[b : b + n] = True
            each = levels.distinct() if strings else np.zeros(0, np.int64)
            # no start lies in the last span - 1 bytes of a form, so runs of starts end with their form
            change = np.diff(levels.repeated[: levels.size].astype(np.int8), prepend=0, append=0)
            lo, hi = np.nonzero(change == 1)[0], np.nonzero(change == -1)[0] - 1
            for lo, hi, held in ((lo, hi, False), (each, each, True)):
                for k in range(0, len(lo), BATCH):
                    some, last = lo[k : k + BATCH], hi[k : k + BATCH]
                    of = np.searchsorted(begin, some, side="right") - 1
                    shift = at[of] - begin[of]
                    text = pa.array([levels.data[x : x + span].tobytes() for x in some.tolist()] if held else [None] * len(some), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[of]), pa.array(seg[of]), pa.array((some + shift).astype(np.int32)), pa.array((last + shift).astype(np.int32)), text], schema=_HITS)

        now = None
        for batch in batches:
            for anchor, part, seg, at, raw, copies in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "seg", "at", "bytes", "copies")), strict=True):
                if (anchor, part) != now and (levels.size > FAMILY or strings):
                    yield from result()
                    levels, forms = SuffixLevels(span), []
                now = anchor, part
                begin, m = levels.hold(raw), len(raw) - span + 1
                forms.append((begin, anchor, seg, at, m, copies))
                waiting.append(np.arange(begin, begin + m))
                pending += m
                if pending >= BATCH:
                    feed()
        yield from result()

    return run


def _cut_out(text: str, spans: list | None) -> tuple[int, int, int, str]:
    raw = text.encode("utf-8", "surrogatepass")
    if not len(spans):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    kept, at, removed, runs = [], 0, 0, 0
    last = -1
    for lo, hi in spans:
        if lo > last:
            runs += 1
            kept.append(raw[at:lo])
        last = max(last, hi)
        at = last
    kept.append(raw[at:])
    left = b"".join(kept)
    removed = len(raw) - len(left)
    return len(raw), removed, runs, hashlib.sha256(left).hexdigest()


def _families(rows: DataFrame, span: int, strings: bool) -> DataFrame:
    dealt = rows.select("anchor", "part", "seg", "at", "bytes", "copies").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(_index(span, strings), _HITS_SQL)


def repeats_of_forms(forms: DataFrame, span: int, forms_of_a_task: int) -> DataFrame:
    """anchor, seg, lo, hi: the starts of each form (anchor, seg, bytes, copies, n forms of the anchor) that repeat."""
    parts = F.ceil(F.col("n") / max(1, forms_of_a_task)).cast("int")
    rows = forms.withColumns({"at": F.lit(0), "many": F.when(F.col("n") > forms_of_a_task, parts)})
    cold = rows.where("many is null").withColumn("part", F.lit(0))
    hot = rows.where("many is not null").withColumn("part", F.pmod(F.xxhash64("seg"), F.col("many")).cast("int"))
    within = cut(_families(hot, span, strings=True))
    # a string may be in another part as well: the different strings of all parts meet by their hash. One that occurs
    # more than once in its part is known to repeat; here it makes those repeat that occur once in theirs
    sizes = hot.groupBy(F.col("anchor").alias("of")).agg(F.first("many").alias("many"))
    each = within.where("string is not null").join(sizes, F.col("anchor") == F.col("of"))
    each = each.select("anchor", F.pmod(F.xxhash64("string"), F.col("many")).cast("int").alias("part"), "seg", F.col("lo").alias("at"), F.col("string").alias("bytes"), F.lit(1).cast("long").alias("copies"))
    found = [_families(cold, span, strings=False), within.where("string is null"), _families(each, span, strings=False)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("anchor", "seg", "lo", "hi")


def _joined(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """big joined with small by keys; the rows of the hot keys (at most HOT of them) without a shuffle of big."""
    mark = F.broadcast(hot.select(*keys))
    few = F.broadcast(small.join(mark, keys, "left_semi"))
    return big.join(few, keys).unionByName(big.join(mark, keys, "left_anti").join(small.join(mark, keys, "left_anti"), keys))


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, forms_of_a_task: int = FORMS) -> DataFrame:
    """doc_id, h (hash of the text), spans: sorted array of (lo, hi) bytes to remove, for texts that have any.

    docs: doc_id, text. A row is named by doc_id and the hash of its text, so rows that repeat both share their spans.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where(F.octet_length("text") >= span)
    found = cut(named.mapInArrow(_scan(span, gram), "doc_id long, h long, start long, m int, anchor long, seg long"))
    rows = found.count()
    groups = cut(found.groupBy("anchor").agg(F.count("*").alias("rows"), (F.min("seg") != F.max("seg")).alias("mixed")).where("rows > 1"))
    again = cut(_joined(found, groups.select("anchor", "mixed"), ["anchor"], groups.where(F.col("rows") * HOT > rows)))
    # the segments of anchors that occur in several forms, each form once, with its bytes from one text that holds it
    holder = F.min(F.struct(F.xxhash64("doc_id", "h", "seg").alias("turn"), "doc_id", "h", "start", "m"))
    forms = cut(again.where("mixed").groupBy("anchor", "seg").agg(holder.alias("x"), F.count("*").alias("copies")))
    wanted = forms.select(F.col("x.doc_id").alias("_d"), F.col("x.h").alias("_h"), F.struct("anchor", "seg", F.col("x.start").alias("start"), F.col("x.m").alias("m"), "copies").alias("w"))
    wanted = wanted.groupBy("_d", "_h").agg(F.collect_list("w").alias("w"))
    held = named.dropDuplicates(["doc_id", "h"]).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
    raw = held.select(F.explode("w").alias("w"), F.col("text").cast("binary").alias("raw"))
    raw = raw.select("w.anchor", "w.seg", F.substring("raw", (F.col("w.start") + 1).cast("int"), F.col("w.m") - 1 + span).alias("bytes"), "w.copies")
    raw = cut(raw.join(forms.groupBy("anchor").agg(F.count("*").alias("n")), "anchor"))
    hits = cut(repeats_of_forms(raw, span, forms_of_a_task))
    several = _joined(again.where("mixed").drop("mixed"), hits, ["anchor", "seg"], forms.where(F.col("copies") * HOT > rows))
    several = several.select("doc_id", "h", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + span).alias("hi"))
    plain = again.where("not mixed").select("doc_id", "h", F.col("start").alias("lo"), (F.col("start") + F.col("m") - 1 + span).alias("hi"))
    return several.unionByName(plain).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, forms_of_a_task: int = FORMS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id long, text string, ...).

    Bytes under any string of span bytes that starts anywhere else too, in the same text or another, are removed; all
    copies go. Strings are judged on the input and never cross texts. Null and empty texts have no bytes and keep
    none. Rows that repeat doc_id and text count as two texts. An empty table gives an empty result; further columns
    are ignored.
    """
    spans = repeated_spans(docs, span, gram, forms_of_a_task).withColumnsRenamed({"doc_id": "_d", "h": "_h"})

    @F.pandas_udf(_RESULT)
    def apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_cut_out(t or "", [] if s is None else [(x["lo"], x["hi"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    named = docs.select(F.col("doc_id"), "text", F.xxhash64("text").alias("h"))
    out = named.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", apply("text", "spans").alias("x")).select("doc_id", "x.*")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
