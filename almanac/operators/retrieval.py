"""Retrieval: lexical hash vectors, cosine and overlap, exact and approximate top-k in blocks, source identification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.registry import query, table
from ..plans.written import written
from ..sources.intake import upsert
from .lexical import Vectorizer, embed

# fixed values: floors of cosine and overlap, and what makes a match strong or moderate
FLOOR, OVERLAP_FLOOR = 0.18, 0.02
STRONG, STRONG_OVERLAP, MODERATE = 0.45, 0.20, 0.25
#: Queries and rows of a tile of the exact search, and queries whose scores are held at once.
QUERIES, ROWS, SCORED = 512, 8192, 128
#: Of the approximate search: cells at most (about the root of the rows), rows for a cell that centres are fitted on,
#: share of the nearest rows of the sample that the cells of a query must hold, steps of a code, and candidates that are
#: ranked exactly for each row that is asked for.
CELLS, FITTED, HELD, LEVELS, OVERFETCH = 4096, 16, 0.97, 7, 8
#: Fixed references that every document gets at most.
FIXED = 1000


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequally long or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def strength(score: Column, overlap: Column) -> Column:
    return F.when((score >= STRONG) & (overlap >= STRONG_OVERLAP), "strong").when(score >= MODERATE, "moderate").otherwise("weak")


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first, size) of lists; null ones are empty."""
    lists = column.combine_chunks()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    size = np.where(np.asarray(lists.is_valid()), np.diff(offsets), 0)
    return lists.values.to_numpy(zero_copy_only=False), offsets[:-1], size


def _unit(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    rows = values[first[:, None] + np.arange(size)].astype(np.float64)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=rows, where=norm > 0)


class _Shared:
    """How many tokens a query shares with each row of a tile: lists of rows by token, added up."""

    def __init__(self, values: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.values, self.first, self.size = values, first, size

    def of_rows(self, rows: np.ndarray) -> None:
        size = self.size[rows]
        self.rows, self.of = size, np.repeat(np.arange(len(rows)), size)
        flat = self.values[np.repeat(self.first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        order = np.argsort(flat, kind="stable")
        self.tokens, self.start = np.unique(flat[order], return_index=True)
        self.many, self.of = np.diff(np.append(self.start, len(flat))), self.of[order]

    def overlap(self, query: int) -> np.ndarray:
        own = self.values[self.first[query] : self.first[query] + self.size[query]]
        at = np.searchsorted(self.tokens, own)
        at = at[at < len(self.tokens)] if not len(self.tokens) else at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == own]
        many = self.many[at]
        hit = self.of[np.repeat(self.start[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        both = np.bincount(hit, minlength=len(self.rows))
        return both / np.maximum(1, len(own) + self.rows - both)


def _tile(k: int, floor: float, overlap: float | None, itself: bool):
    """The k best rows of a tile for each of its queries, read from Arrow buffers."""

    def run(tile: pa.Table) -> pa.Table:
        asked = np.asarray(tile["asked"].combine_chunks())
        ids = np.asarray(tile["row_id"].combine_chunks().fill_null(0))
        names = tile["query_id"].combine_chunks()
        own = np.asarray(tile["itself"].combine_chunks().fill_null(0)) if not itself else None
        values, first, size = _matrix(tile["vector"])
        shared = _Shared(*_matrix(tile["tokens"])) if overlap is not None else None
        found: list[tuple[np.ndarray, ...]] = []
        for n in np.unique(size[asked]):
            q, r = np.nonzero(asked & (size == n))[0], np.nonzero(~asked & (size == n))[0]
            if not n or not len(r):
                continue
            r = r[np.argsort(ids[r], kind="stable")]
            b = _unit(values, first[r], int(n))
            if shared:
                shared.of_rows(r)
            for some in np.split(q, range(SCORED, len(q), SCORED)):
                scores = np.round(np.clip(_unit(values, first[some], int(n)) @ b.T, -1, 1), 9)
                for x, row in zip(some.tolist(), scores, strict=True):
                    good = row >= floor
                    if own is not None:
                        good &= ids[r] != own[x]
                    common = None
                    if shared:
                        common = shared.overlap(x)
                        good &= common >= overlap
                    near = np.nonzero(good)[0]
                    if len(near) > k:  # no row below the k-th best can stay
                        near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k]]
                    near = near[np.argsort(-row[near], kind="stable")[:k]]
                    found.append((np.full(len(near), x), ids[r[near]], row[near], common[near] if shared else np.full(len(near), np.nan)))
        x, rows, score, common = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        out = [names.take(pa.array(x)), pa.array(rows), pa.array(score), pa.array(common, mask=np.isnan(common))]
        return pa.Table.from_arrays(out, names=["query_id", "row_id", "score", "overlap"])

    return run


_SIDE = ["query_id", "row_id", "itself", "vector", "tokens", "asked"]


def _side(df: DataFrame, asked: bool, tokens: bool, kind: str, itself: bool) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    own = F.col("id")
    return df.withColumns({
        "query_id": own.cast(kind) if asked else null(kind), "row_id": null("long") if asked else own.cast("long"), "itself": own.cast("long") if asked and not itself else null("long"),
        "tokens": F.col("tokens") if tokens else null("array<long>"), "asked": F.lit(asked),
    })


def _searched(tiles: DataFrame, keys: list[str], kind: str, k: int, floor: float, overlap: float | None, itself: bool) -> DataFrame:
    found = tiles.select(*keys, *_SIDE).groupBy(*keys).applyInArrow(_tile(k, floor, overlap, itself), f"query_id {kind}, row_id long, score double, overlap double")
    return best(found, "query_id", [F.desc("score"), F.col("row_id")], k)


def top_k(queries: DataFrame, rows: DataFrame, k: int, floor: float = FLOOR, by: str | None = None, overlap: float | None = None, itself: bool = False) -> DataFrame:
    """query_id, row_id, score (cosine, to nine digits), overlap, place: the k best of all rows for each query.

    queries and rows: id (of queries: each its own), vector, with `tokens` where a least overlap is asked for, and the
    column `by` where a query only sees rows that are equal in it (null: rows without it). Both sides are dealt to
    blocks of bounded size; every pair of blocks is one tile that keeps k rows a query, and the best of these are taken
    by a second grouping, so neither a large table nor a hot group meets in one task. A row never answers a query of
    its id, unless itself is set, as it is where queries and rows are of two tables. Ties go to the smaller id.
    """
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    kind = queries.schema["id"].dataType.simpleString()
    q, r = (_side(df.withColumn("g", group), asked, overlap is not None, kind, itself).select("g", "id", *_SIDE) for df, asked in ((queries, True), (rows, False)))
    blocks = lambda df, n, name: df.groupBy("g").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    counts = blocks(q, QUERIES, "nq").withColumnRenamed("g", "gq").join(blocks(r, ROWS, "nr"), F.col("gq").eqNullSafe(F.col("g")), "inner").drop("g")
    counts = counts.withColumnRenamed("gq", "of")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    with_counts = lambda df: df.join(counts, F.col("g").eqNullSafe(F.col("of"))).drop("of")
    a = with_counts(q).withColumn("i", own("nq")).withColumn("j", every("nr")).drop("id")
    b = with_counts(r).withColumn("j", own("nr")).withColumn("i", every("nq")).drop("id")
    return _searched(a.unionByName(b), ["g", "i", "j"], kind, k, floor, overlap, itself)


def _blocks(works: DataFrame, rows: int) -> DataFrame:
    """works (id, vector, tokens) with a block of about `rows` works of like vectors."""
    n = works.count()
    if n <= rows:
        return works.withColumn("block", F.lit(0))
    cells = min(CELLS, -(-n // rows))
    sample = works.select("vector").orderBy(F.xxhash64("id")).limit(FITTED * cells).collect()
    near = _nearest(works.sparkSession, _cells(np.array([r["vector"] for r in sample], np.float64), cells))
    placed = written(works.withColumn("cell", near(1)("vector")[0]))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
    return placed.join(parts, "cell").withColumn("block", F.xxhash64("cell", F.pmod(F.xxhash64("id", F.lit(6)), F.col("n")))).drop("cell", "n")


def pruned_top_k(queries: DataFrame, works: DataFrame, k: int, floor: float = FLOOR, overlap: float = OVERLAP_FLOOR, size: int | None = None) -> DataFrame:
    """As top_k() with a least overlap over queries and works (id, vector, tokens), but a query only meets the blocks of
    works that can hold a hit for it.

    Works lie in blocks of like vectors. An overlap of t with a work of a block needs t x max(tokens of the query, least
    tokens of a work) tokens that occur in the block at all, and t x the query's tokens may not exceed the most that a
    work has: lists of blocks by token count the first for all queries in one join, and blocks below the bound are
    passed over. What is left is scored exactly, so nothing is lost.
    """
    rows = size or ROWS
    kind = queries.schema["id"].dataType.simpleString()
    queries = written(queries.select("id", "vector", "tokens").where("size(tokens) > 0"))
    placed = written(_blocks(works.select("id", "vector", "tokens").where("size(tokens) > 0"), rows))
    bounds = placed.groupBy("block").agg(F.min(F.size("tokens")).alias("least"), F.max(F.size("tokens")).alias("most"))
    lists = placed.select(F.explode("tokens").alias("token"), "block").distinct()
    met = queries.select("id", F.size("tokens").alias("own"), F.explode("tokens").alias("token")).join(lists, "token").groupBy("id", "own", "block").agg(F.count("*").alias("both"))
    can = met.join(bounds, "block").where((F.col("both") >= F.lit(overlap) * F.greatest("own", "least") - 1e-9) & (F.lit(overlap) * F.col("own") <= F.col("most") + 1e-9))
    can = written(can.select("id", "block"))
    parts = can.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n"))
    asked = can.join(parts, "block").withColumn("i", F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")).cast("int")).drop("n")
    a = _side(queries.join(asked, "id"), True, True, kind, True)
    b = _side(placed.join(parts, "block").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))), False, True, kind, True)
    keys = ["block", "i"]
    return _searched(a.select(*keys, *_SIDE).unionByName(b.select(*keys, *_SIDE)), keys, kind, k, floor, overlap, True)


def best(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each key."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def _cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of a sample by a few rounds of spherical k-means."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(1).permutation(len(x))[:cells]]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _nearest(spark: SparkSession, fitted: np.ndarray):
    """A function of n: the column function that gives the n nearest of the fitted centres, nearest first."""
    centres = spark.sparkContext.broadcast(fitted)

    def near(n: int):
        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for some in batches:
                own = centres.value
                zero = np.zeros(own.shape[1])
                x = np.array([zero if v is None or len(v) != own.shape[1] else v for v in some], np.float64)
                yield pd.Series(np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :n].astype(np.int32).tolist())

        return run

    return near


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, held: float) -> int:
    """How many of its nearest cells a query must look into to meet `held` of its k nearest rows, measured on the sample."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    own = (x @ centres.T).argmax(axis=1)
    some = np.random.default_rng(2).permutation(len(x))[:256]
    scores = x[some] @ x.T
    scores[np.arange(len(some)), some] = -2
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(-(x[some] @ centres.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None].repeat(len(some), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(held * len(needed))))]) + 1 if len(needed) else 1


def _coded(centres):
    """Unit vectors -> cell of the nearest centre, and the rest in bytes of few steps with its scale."""

    @F.pandas_udf("cell int, code binary, scale double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = centres.value
        for some in batches:
            fits = np.array([v is not None and len(v) == own.shape[1] for v in some])
            x = np.array([v if f else np.zeros(own.shape[1]) for v, f in zip(some, fits, strict=True)], np.float64).reshape(len(some), -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cell = (x @ own.T).argmax(axis=1)
            rest = x - own[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12)
            code = np.rint(rest / scale[:, None] * LEVELS).astype(np.int8)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "code": [c.tobytes() if f else None for c, f in zip(code, fits, strict=True)], "scale": scale / LEVELS})

    return run


def _coded_tile(centres, k: int, itself: bool):
    """The k rows of a tile that are nearest to each of its queries by their codes."""

    def run(tile: pa.Table) -> pa.Table:
        own = centres.value
        asked = np.asarray(tile["asked"].combine_chunks())
        ids, names = np.asarray(tile["row_id"].combine_chunks().fill_null(0)), tile["query_id"].combine_chunks()
        same = np.asarray(tile["itself"].combine_chunks().fill_null(0))
        q, r = np.nonzero(asked)[0], np.nonzero(~asked)[0]
        x, rows, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(r):
            code = np.frombuffer(b"".join(tile["code"].take(pa.array(r)).to_pylist()), np.int8).reshape(len(r), -1)
            cell, scale = (np.asarray(tile[c].combine_chunks().fill_null(0))[r] for c in ("cell", "scale"))
            near = (own[cell] + code * scale[:, None]).astype(np.float32)
            values, first, size = _matrix(tile["vector"])
            asks = _unit(values, first[q], int(size[q[0]])).astype(np.float32)
            for lo in range(0, len(q), SCORED):
                scores = asks[lo : lo + SCORED] @ near.T
                if not itself:
                    scores[same[q[lo : lo + SCORED]][:, None] == ids[r][None]] = -2
                best = np.argpartition(-scores, min(k, len(r)) - 1, axis=1)[:, :k]
                x.append(np.repeat(q[lo : lo + SCORED], best.shape[1]))
                rows.append(ids[r][best].ravel())
                score.append(np.take_along_axis(scores, best, 1).ravel().astype(np.float64))
        return pa.Table.from_arrays([names.take(pa.array(np.concatenate(x))), pa.array(np.concatenate(rows)), pa.array(np.concatenate(score))], names=["query_id", "row_id", "score"])

    return run


def approximate_top_k(queries: DataFrame, rows: DataFrame, k: int, floor: float = FLOOR, cells: int | None = None, held: float = HELD, itself: bool = False) -> DataFrame:
    """As top_k() over an index, with few rows read in full: query_id, row_id, score (exact), place.

    Rows lie in the cell of their nearest centre, about as many cells as the root of the rows, fitted on FITTED rows a
    cell by hash. Of each a short code is kept, a byte for a number of what the centre leaves. A query looks at the codes
    of as many cells as the sample shows to hold `held` of the nearest rows: few where vectors lie in groups, most where
    they lie evenly. Its OVERFETCH x k nearest by code are then read and ranked exactly. Every row is indexed; hot cells
    and the queries of a cell are dealt to tiles of bounded size. Vectors of another length than the sample's, null and
    zero ones are not found. Ties go to the smaller id.
    """
    spark, n = rows.sparkSession, rows.count()
    cells = cells or max(1, min(CELLS, round(n**0.5)))
    sample = [r["vector"] for r in rows.where("vector is not null").select("vector").orderBy(F.xxhash64("id")).limit(FITTED * cells).collect()]
    sample = [v for v in sample if len(v) == len(sample[0])]
    if not sample:
        return top_k(queries, rows, k, floor).drop("overlap")
    x = np.array(sample, np.float64)
    fitted = _cells(x, min(cells, len(x)))
    centres, probes = spark.sparkContext.broadcast(fitted), _probes(x, fitted, k, held)
    kind, size = queries.schema["id"].dataType.simpleString(), F.size("vector") == x.shape[1]
    some = written(rows.where(F.col("vector").isNotNull() & size).withColumn("c", _coded(centres)("vector")).select("id", "c.*"))
    asks = queries.where(F.col("vector").isNotNull() & size)
    a = _side(asks.withColumn("cell", F.explode(_nearest(spark, fitted)(probes)("vector"))), True, False, kind, itself).withColumns({"code": F.lit(None).cast("binary"), "scale": F.lit(None).cast("double")})
    b = _side(some.withColumn("vector", F.lit(None).cast("array<double>")), False, False, kind, itself)
    blocks = lambda df, m, name: df.groupBy("cell").agg(F.ceil(F.count("*") / m).cast("int").alias(name))
    counts = blocks(a, QUERIES, "nq").join(blocks(b, ROWS, "nr"), "cell")
    own, every = (lambda m: F.pmod(F.xxhash64("id", F.lit(5)), F.col(m)).cast("int")), (lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    keys, columns = ["cell", "i", "j"], ["query_id", "row_id", "itself", "vector", "asked", "code", "scale"]
    left = a.join(counts, "cell").withColumn("i", own("nq")).withColumn("j", every("nr")).select(*keys, *columns)
    right = b.join(counts, "cell").withColumn("j", own("nr")).withColumn("i", every("nq")).select(*keys, *columns)
    found = left.unionByName(right).groupBy(*keys).applyInArrow(_coded_tile(centres, OVERFETCH * k, itself), f"query_id {kind}, row_id long, score double")
    close = best(found, "query_id", [F.desc("score"), F.col("row_id")], OVERFETCH * k).select("query_id", "row_id")
    exact = close.join(rows.select(F.col("id").cast("long").alias("row_id"), F.col("vector").alias("v")), "row_id").join(asks.select(F.col("id").alias("query_id"), F.col("vector").alias("u")), "query_id")
    scored = exact.select("query_id", "row_id", F.round(cosine(F.col("u"), F.col("v")), 9).alias("score")).where(F.col("score") >= floor)
    return best(scored, "query_id", [F.desc("score"), F.col("row_id")], k)


def identify_sources(docs: DataFrame, corpus: DataFrame, k: int = 4, vectorizer: Vectorizer | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the kept columns, item_id, place, score, overlap, strength, identified, claim_type, confidence: the works
    that each text of docs (doc_id, text) may come from, of corpus (item_id, text).

    Hits have a cosine of at least 0.18 and share at least 0.02 of their tokens. The best is an identification if it is
    strong; the next three are named beside it. Texts without a hit have a row without an item. Every row of docs gets
    rows of its own, whatever its doc_id; equal texts are looked up once. Equal corpus texts are looked up once under
    their smallest id; works without an id are not named.
    """
    works = corpus.where("item_id is not null").groupBy("text").agg(F.min("item_id").alias("id"))
    named = docs.select("doc_id", *(keep or []), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_key"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("id", F.sha2("text", 256))
    hits = pruned_top_k(embed(texts, "id", vectorizer), embed(works, "id", vectorizer), k)
    found = named.join(hits, F.col("_key") == F.col("query_id"), "left")
    grade = strength(F.col("score"), F.col("overlap"))
    known = F.coalesce((F.col("place") == 1) & (grade == "strong"), F.lit(False))
    sure = F.when(F.col("row_id").isNull(), 0.8).when(F.col("place") == 1, F.least("score", F.lit(0.9))).otherwise(F.least("score", F.lit(0.5)))
    kind = F.when(F.col("row_id").isNull(), "uncertain").when(known, "scholarly_interpretation").otherwise("ai_hypothesis")
    return found.select("doc_id", *(keep or []), F.col("row_id").alias("item_id"), F.coalesce("place", F.lit(1)).alias("place"), "score", "overlap", F.when(F.col("row_id").isNotNull(), grade).alias("strength"), known.alias("identified"), kind.alias("claim_type"), sure.alias("confidence"))


def chunks(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """kind, source_key, title, content, citation: what is indexed for retrieval.

    passages: source_key, label, text, note (may be null); sources: source_key, title, author, description. A passage
    is a chunk, its note another, and every source has one of its profile; a citation names the source and the place.
    """
    cited = passages.join(sources.select("source_key", F.col("title").alias("of"), "author"), "source_key")
    named = F.concat("of", F.lit(", "), "label")
    citation = F.concat("author", F.lit(", "), named)
    body = cited.select(F.lit("passage").alias("kind"), "source_key", named.alias("title"), F.col("text").alias("content"), citation.alias("citation"))
    notes = cited.where("note is not null and trim(note) <> ''").select(F.lit("note").alias("kind"), "source_key", F.concat(named, F.lit(" (note)")).alias("title"), F.col("note").alias("content"), citation.alias("citation"))
    profile = sources.select(F.lit("source").alias("kind"), "source_key", "title", F.concat_ws(". ", "title", "author", "description").alias("content"), F.concat("author", F.lit(", "), "title").alias("citation"))
    return body.unionByName(notes).unionByName(profile)


def further_reading(hits: DataFrame, fixed: DataFrame) -> DataFrame:
    """Of hits (doc_id, citation, score) and fixed references (citation, place) each document's citations once, hits by
    score, then the fixed ones in their order."""
    named = hits.select("doc_id", "citation", F.struct(F.lit(0).alias("kind"), (-F.col("score")).alias("by")).alias("at"))
    listed = fixed.select("citation", "place").limit(FIXED + 1).collect()
    if len(listed) > FIXED:
        raise ValueError(f"more than {FIXED} fixed references")
    kept = F.explode(F.array(*(F.struct(F.lit(r["citation"]).alias("citation"), F.lit(r["place"]).alias("place")) for r in listed))) if listed else None
    always = hits.select("doc_id").distinct().select("doc_id", kept.alias("f")).select("doc_id", "f.*") if listed else hits.limit(0).select("doc_id", "citation", F.lit(0).alias("place"))
    always = always.select("doc_id", "citation", F.struct(F.lit(1).alias("kind"), F.col("place").cast("double").alias("by")).alias("at"))
    first = named.unionByName(always).groupBy("doc_id", "citation").agg(F.min("at").alias("at"))
    return first.select("doc_id", "citation", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "citation")).alias("place"))


def refreshed(index: DataFrame, analyses: DataFrame, vectorizer: Vectorizer | None = None) -> DataFrame:
    """The index (analysis_id, vector) with the vectors of title and summary of the given analyses, one row each; those
    that were there are replaced."""
    texts = analyses.select("analysis_id", F.concat_ws(". ", "title", "summary").alias("text"))
    return upsert(index, embed(texts, "analysis_id", vectorizer).select("analysis_id", "vector"), ["analysis_id"])


_WORDS = lambda t, k: f"SELECT DISTINCT {k}, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x NOT IN ({', '.join(repr(w) for w in tx.STOP_WORDS)}))) AS token FROM {t}"
_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9)"


@query("m6_source_identification")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no such vectors; tests compare with brute force."""
    return identify_sources(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("g3_token_jaccard", f"""WITH b AS (SELECT item_id, list(DISTINCT token) AS w FROM ({_WORDS("benchmark", "item_id")}) GROUP BY item_id)
SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) AS jaccard FROM b x JOIN b y ON y.item_id = x.item_id + 1""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tx.tokens(tx.matching_form(F.col("text")))).alias("w"))
    a, b = sets.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), sets.select(F.col("item_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("jaccard"))


@query("h17_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h17(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a, b = v.withColumnsRenamed({"vec_id": "a", "embedding": "ea"}), v.withColumnsRenamed({"vec_id": "b", "embedding": "eb"})
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine(F.col("ea"), F.col("eb")), 9).alias("cosine"))


@query("h18_match_strength", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 100 >= 45 AND l_suppkey % 100 >= 20 THEN 'strong' WHEN l_partkey % 100 >= 25 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem")
def h18(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = strength((F.col("l_partkey") % 100).cast("double") / 100, (F.col("l_suppkey") % 100).cast("double") / 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", grade.alias("strength"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


_TOP = """SELECT query_id, vec_id, cosine, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM (
  SELECT q.vec_id AS query_id, v.vec_id, {cos} AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id {on}) WHERE cosine >= 0.18) WHERE place <= 5"""


@query("e7_top_k", _TOP.format(cos=_COS, on=""))
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search of a stated query set, every twentieth vector, against all rows."""
    v = _vectors(spark, sf_dir)
    return top_k(v.where("id % 20 = 0"), v, 5).select("query_id", F.col("row_id").alias("vec_id"), F.col("score").alias("cosine"), "place")


@query("e12_owner_scoped", _TOP.format(cos=_COS, on="AND q.label IS NOT DISTINCT FROM v.label"))
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As e7, but a query sees only the rows of its own owner, here the label; those without one see each other."""
    v = _vectors(spark, sf_dir)
    return top_k(v.where("id % 20 = 0"), v, 5, by="label").select("query_id", F.col("row_id").alias("vec_id"), F.col("score").alias("cosine"), "place")


@query("e9_approximate_top_k")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As e7 over an index; tests measure its recall."""
    v = _vectors(spark, sf_dir)
    return approximate_top_k(v.where("id % 20 = 0"), v, 5).select("query_id", F.col("row_id").alias("vec_id"), F.col("score").alias("cosine"), "place")


@query("h16_hash_embedding")
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the corpus texts; SQL lacks the hash function, tests compare with a plain version."""
    return embed(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "vector")


_CHUNKS = """WITH s AS (SELECT 's' || s_suppkey AS source_key, s_name AS title, n_name AS author, CASE WHEN s_acctbal > 0 THEN 'a source in credit' ELSE 'a source in debt' END AS description FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT 's' || l_suppkey AS source_key, concat(l_orderkey, '.', l_linenumber) AS label, concat('part ', l_partkey) AS text, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS note FROM lineitem),
c AS (SELECT p.*, s.title AS of, author FROM p JOIN s USING (source_key))
SELECT 'passage' AS kind, source_key, concat(of, ', ', label) AS title, text AS content, concat(author, ', ', of, ', ', label) AS citation FROM c
UNION ALL SELECT 'note', source_key, concat(of, ', ', label, ' (note)'), note, concat(author, ', ', of, ', ', label) FROM c WHERE note IS NOT NULL
UNION ALL SELECT 'source', source_key, title, concat_ws('. ', title, author, description), concat(author, ', ', title) FROM s"""


@query("a13_chunks", _CHUNKS)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("author"))
    s = table(spark, sf_dir, "supplier").join(nations, "s_nationkey")
    s = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source_key"), F.col("s_name").alias("title"), "author", F.when(F.col("s_acctbal") > 0, "a source in credit").otherwise("a source in debt").alias("description"))
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source_key"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("label"), F.concat(F.lit("part "), "l_partkey").alias("text"), F.when(F.col("l_returnflag") == "R", "returned").alias("note"))
    return chunks(p, s)


@query("g4_further_reading", """
WITH h AS (SELECT l_orderkey AS doc_id, concat('work ', l_suppkey % 20) AS citation, l_discount::DOUBLE AS score FROM lineitem), f AS (SELECT * FROM (VALUES ('work 3', 0), ('calendar arithmetic', 1), ('lunar series', 2)) AS t(citation, place)),
u AS (SELECT doc_id, citation, 0 AS kind, -score AS ahead FROM h UNION ALL SELECT doc_id, citation, 1, place::DOUBLE FROM (SELECT DISTINCT doc_id FROM h), f),
m AS (SELECT doc_id, citation, min((kind, ahead)) AS pos FROM u GROUP BY ALL)
SELECT doc_id, citation, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, citation) AS INT) AS place FROM m""")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("work "), F.col("l_suppkey") % 20).alias("citation"), F.col("l_discount").cast("double").alias("score"))
    fixed = spark.createDataFrame([("work 3", 0), ("calendar arithmetic", 1), ("lunar series", 2)], "citation string, place int")
    return further_reading(hits, fixed)


@query("e13_refreshed_index")
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all corpus texts, those of a third of them replaced by a rerun's; tests compare with a plain version."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("analysis_id"), F.concat(F.lit("Item "), "item_id").alias("title"), F.col("text").alias("summary"))
    index = embed(items.select("analysis_id", F.concat_ws(". ", "title", "summary").alias("text")), "analysis_id").select("analysis_id", "vector")
    return refreshed(index, items.where("analysis_id % 3 = 0").withColumn("summary", F.concat(F.lit("Revised. "), "summary")))


@query("g2_merged_search", f"""
WITH hits AS (SELECT d.doc_id, 'keyword' AS kind, 1.0::DOUBLE AS score FROM documents d WHERE contains(lower(text), 'tion the')),
near AS (SELECT v.vec_id AS doc_id, 'semantic' AS kind, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.vec_id = 0 AND v.vec_id <> 0 JOIN documents d ON d.doc_id = v.vec_id)
SELECT doc_id, kind, score FROM (SELECT * FROM hits UNION ALL SELECT * FROM near WHERE score >= 0.12 AND doc_id NOT IN (SELECT doc_id FROM hits)) ORDER BY score DESC, kind, doc_id LIMIT 50""")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits, then the documents near the query's vector that are not among them, best first."""
    docs, v = table(spark, sf_dir, "documents"), _vectors(spark, sf_dir)
    keyword = docs.where(F.lower("text").contains("tion the")).select("doc_id")
    others = docs.select("doc_id").join(keyword, "doc_id", "left_anti")
    near = top_k(v.where("id = 0"), v.join(others, F.col("id") == F.col("doc_id"), "left_semi"), 50, 0.12).select(F.col("row_id").alias("doc_id"), "score")
    union = keyword.select("doc_id", F.lit("keyword").alias("kind"), F.lit(1.0).alias("score")).unionByName(near.select("doc_id", F.lit("semantic").alias("kind"), "score"))
    return union.orderBy(F.desc("score"), "kind", "doc_id").limit(50)
