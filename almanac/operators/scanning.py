"""Spans of many patterns in texts, found in one pass over Arrow batches.

A pattern is tried on a text only where its literal beginning occurs, and plain phrases are looked up word by word, so
the cost of a text hardly grows with the number of patterns. Spans come in order of their start, longest first, then
in the order of the rules; rules decide which of overlapping ones stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

_WORD = re.compile(r"\w+")
_PLAIN = re.compile(r"[\w' ]+")
#: Characters that match ASCII letters when case is ignored although lower() doesn't make them so.
_FOLDED = re.compile("[İıſK]")

Span = tuple[int, int, int, re.Match | None]


def _literal(pattern: str) -> str:
    """The letters and blanks that every match of a pattern begins with."""
    body = pattern.removeprefix(r"\b")
    depth = 0
    for k, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth and body[k - 1] != "\\":
            return ""
    found = re.match(r"[A-Za-z' ]*", body)[0]
    return found[:-1] if body[len(found) : len(found) + 1] in ("?", "*", "{") and body[len(found) :] else found


class Scanner:
    """All matches of patterns. Phrases of letters, digits, blanks and apostrophes match whole words only."""

    def __init__(self, patterns: Iterable[str], ignore_case: bool = True, whole_words: bool = True) -> None:
        flags = re.IGNORECASE if ignore_case else 0
        self.ignore_case, self.rules, self.phrases, self.other = ignore_case, [], {}, []
        for k, pattern in enumerate(patterns):
            plain = whole_words and _PLAIN.fullmatch(pattern)
            self.rules.append(re.compile(rf"\b{re.escape(pattern)}\b" if plain else pattern, flags))
            if plain and (first := _WORD.match(pattern)) and _WORD.fullmatch(pattern[-1]):
                text = pattern.lower() if ignore_case else pattern
                self.phrases.setdefault(first[0].lower() if ignore_case else first[0], []).append((text, k))
            else:
                literal = _literal(pattern)
                self.other.append((literal.lower() if ignore_case else literal, k))

    def find(self, text: str) -> list[Span]:
        """(start, stop, number of the pattern, match) of every match of every pattern, in order."""
        low = text.lower() if self.ignore_case else text
        if self.ignore_case and _FOLDED.search(text) or len(low) != len(text):
            found = [(m.start(), m.end(), k, m) for k, rule in enumerate(self.rules) for m in rule.finditer(text)]
        else:
            found, n = [], len(low)
            if self.phrases:
                for word in _WORD.finditer(low):
                    for phrase, k in self.phrases.get(word[0], ()):
                        at = word.start()
                        end = at + len(phrase)
                        if low.startswith(phrase, at) and (end == n or not _WORD.match(low, end)):
                            found.append((at, end, k, None))
            for literal, k in self.other:
                if literal in low:
                    found += [(m.start(), m.end(), k, m) for m in self.rules[k].finditer(text)]
        found.sort(key=lambda x: (x[0], x[0] - x[1], x[2]))
        return found


def apart(spans: Iterable[Span], group: Callable[[int], object] = lambda k: None) -> Iterator[Span]:
    """Spans that no accepted one before overlaps; only those of one group of patterns can clash."""
    stops: dict = {}
    for span in spans:
        own = group(span[2])
        if span[0] >= stops.get(own, 0):
            stops[own] = span[1]
            yield span


#: Characters of texts that a task remembers the annotations of.
REMEMBERED = 4_000_000


def annotated(docs: DataFrame, readers: dict[str, tuple[Callable[[str], Iterable[tuple]], str, str | None]], keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, the kept columns, and for each reader (read, fields, needed) an array of structs: all that they make of a
    text of docs (doc_id, text), in one pass over it. Null texts have empty arrays.

    needed: a pattern that every text holds of which the reader makes anything. Equal texts that a task meets are read
    once, as long as what it has read since it last forgot is no longer than REMEMBERED characters.
    """
    kept = ["doc_id", *keep]
    arrays = [StructField(name, ArrayType(StructType.fromDDL(fields))) for name, (_, fields, _) in readers.items()]
    schema = StructType([*(docs.schema[c] for c in kept), *arrays])
    needs = {name: needed and re.compile(needed) for name, (_, _, needed) in readers.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(StructType(arrays))

        def made(texts: list[str | None]) -> list[pa.ListArray]:
            out = []
            for field, (name, (read, _, _)) in zip(arrow, readers.items(), strict=True):
                need, sizes, rows = needs[name], [0], []
                for text in texts:
                    if text and (not need or need.search(text)):
                        rows.extend(read(text))
                    sizes.append(len(rows))
                kind = field.type.value_type
                parts = list(zip(*rows, strict=True)) if rows else [()] * kind.num_fields
                cells = pa.StructArray.from_arrays([pa.array(list(c), kind.field(k).type) for k, c in enumerate(parts)], fields=[kind.field(k) for k in range(kind.num_fields)])
                out.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), cells))
            return out

        known: dict[str | None, int] = {}
        held, length = made([]), 0
        for batch in batches:
            at, fresh = [], []
            for text in batch.column("_text").to_pylist():
                k = known.setdefault(text, len(known))
                if k == len(held[0]) + len(fresh):
                    fresh.append(text)
                at.append(k)
            if fresh:
                held = [pa.concat_arrays(pair) for pair in zip(held, made(fresh), strict=True)]
            index = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(h.take(index) for h in held)], names=[*kept, *readers])
            length += sum(len(t or "") for t in fresh)
            if length > REMEMBERED:
                known, held, length = {}, made([]), 0

    return docs.select(*kept, docs["text"].alias("_text")).mapInArrow(run, schema)


def scanned(docs: DataFrame, read: Callable[[str], Iterable[tuple]], fields: str, prefilter: str | None = None) -> DataFrame:
    """doc_id and fields, a row for each tuple that read makes of a text of docs (doc_id, text).

    Null texts have no rows. prefilter: a Java pattern that every text with any row holds; the others don't leave the
    JVM. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    docs = docs.where(F.col("text").rlike(prefilter)) if prefilter else docs
    schema = StructType.fromDDL(fields)
    schema = StructType([docs.schema["doc_id"], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            owner, rows = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                before = len(rows)
                rows.extend(read(text))
                owner.extend([k] * (len(rows) - before))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.mapInArrow(run, schema)
