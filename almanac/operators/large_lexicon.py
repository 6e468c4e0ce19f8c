"""Mentions of a lexicon of any size: texts and phrases are joined by leading words, so no task holds all entries.

annotations.entities() sends its entries to every task, which suits some thousands. Here a phrase is filed under its
first two words, or its only one; a text offers each of its words and word pairs, with what follows them, to the join. A
bitmap of fixed size, added up from all phrases, tells a task which of them no phrase begins with, and these stay there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..plans.registry import query, table

#: Bits of the bitmap of leading words (a megabyte), and the longest phrase in characters.
BITS, LONGEST = 1 << 23, 400
#: Offers of a task that go on together.
BATCH = 50_000
_WORD = re.compile(r"\w+")


def _lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def phrases_of(lexicon: DataFrame) -> DataFrame:
    """name, kind, phrase, lead of a lexicon (name, kind, phrases array): different phrases, lower-cased, blanks single.
    Phrases that don't begin and end with a letter, digit or underscore match nothing and are left out."""
    spelt = F.trim(F.regexp_replace(F.lower("phrase"), r"\s+", " "))
    rows = lexicon.select("name", "kind", F.explode("phrases").alias("phrase")).select("name", "kind", spelt.alias("phrase"))
    rows = rows.where(F.col("phrase").rlike(r"(?U)^\w(?:.*\w)?$")).distinct()
    two = F.regexp_extract("phrase", r"(?U)^\w+ \w+", 0)
    return rows.withColumn("lead", F.when(two != "", two).otherwise(F.regexp_extract("phrase", r"(?U)^\w+", 0)))


def _bitmap(phrases: DataFrame) -> np.ndarray:
    at = F.crc32(F.col("lead").cast("binary")) % BITS
    words = phrases.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _offers(docs: DataFrame, held: np.ndarray, longest: int) -> DataFrame:
    """doc_id, text_key, start, lead, low, shown: the words and word pairs of texts that a phrase may begin with, and
    what follows them."""
    sent = docs.sparkSession.sparkContext.broadcast(held)
    fields = [StructField(n, t) for n, t in (("start", IntegerType()), ("lead", StringType()), ("low", StringType()), ("shown", StringType()))]
    schema = StructType([docs.schema["doc_id"], StructField("text_key", StringType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        may = lambda lead: int(bits[(h := zlib.crc32(lead.encode("utf-8", "surrogatepass")) % BITS) >> 6]) >> (h & 63) & 1
        for batch in batches:
            owner, rows = [], []

            def passed(batch=batch) -> pa.RecordBatch:
                own = pa.array(owner, pa.int32())
                columns = [pa.array(list(c), pa.int32() if k == 0 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("text_key").take(own), *columns], names=["doc_id", "text_key", *(f.name for f in fields)])

            known: dict[str, int] = {}
            for k, text in enumerate(batch.column("text").to_pylist()):
                low, before = _lowered(text), None
                for m in _WORD.finditer(low):
                    a, b = m.span()
                    leads = [(a, m[0])] if before is None or low[before[1] : a] != " " else [(before[0], low[before[0] : b]), (a, m[0])]
                    before = (a, b)
                    for at, lead in leads:
                        hit = known.get(lead)
                        if hit is None:
                            hit = known[lead] = may(lead)
                        if hit:
                            owner.append(k)
                            rows.append((at, lead, low[at : at + longest + 1], text[at : at + longest + 1]))
                if len(known) > 500_000:
                    known.clear()
                if len(rows) > BATCH:
                    yield passed()
                    owner, rows = [], []
            if rows:
                yield passed()

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, schema)


def _apart(spans: Column) -> Column:
    """Of spans in order of start, longest first, those that no kept one before overlaps."""
    none = F.struct(F.lit(0).alias("stop"), F.slice(spans, 1, 0).alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["stop"], F.struct(x["stop"].alias("stop"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    return F.aggregate(spans, none, step)["kept"]


def mentions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, start, stop, surface, name, kind: where texts of docs (doc_id, text) hold phrases of a lexicon (name, kind,
    phrases) as whole words, whatever their case; of one kind without overlaps, the first and longest staying.

    Both sides are dealt by leading words, and hot ones are split by the join. Null texts have no rows. Rows that agree
    in doc_id and text are one text. Phrases of over LONGEST characters are an error.
    """
    phrases = phrases_of(lexicon)
    longest = phrases.agg(F.max(F.length("phrase"))).first()[0] or 0
    if longest > LONGEST:
        raise ValueError(f"a phrase has {longest} characters; at most {LONGEST} are looked for")
    offers = _offers(docs.select("doc_id", "text", F.sha2("text", 256).alias("text_key")).where("text is not null"), _bitmap(phrases), longest)
    size = F.length("phrase")
    whole = F.startswith("low", F.col("phrase")) & ~F.coalesce(F.substr("low", size + 1, F.lit(1)).rlike(r"(?U)\w"), F.lit(False))
    found = offers.join(phrases, "lead").where(whole).select("doc_id", "text_key", "kind", "start", (F.col("start") + size).alias("stop"), F.substr("shown", F.lit(1), size).alias("surface"), "name").distinct()
    span = F.struct("start", (-F.col("stop")).alias("_long"), "name", "stop", "surface")
    kept = found.groupBy("doc_id", "text_key", "kind").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return kept.select("doc_id", "kind", F.explode(_apart(F.col("spans"))).alias("x")).select("doc_id", "x.start", "x.stop", "x.surface", "x.name", "kind")


@query("u4_large_lexicon")
def u4_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of three words of the corpus texts as a lexicon, looked for in all documents; tests compare with the plain
    patterns, which SQL can't run without overlaps."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+ \w+ \w+"), F.lit(0))
    entries = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("name")).distinct().select("name", F.lit("run").alias("kind"), F.array("name").alias("phrases"))
    return mentions(table(spark, sf_dir, "documents"), entries)
