"""Source divergence audit: how far the terms of each source of a language are from those of its other sources.

Every source gives every kept term of its language a smoothed share p; two shares differ by f = floor((p-q)^2 / (p+q)).
The sum of f over all terms would need terms x sources^2 steps, though most counts are zero. So a pair of sources starts
from the value that it would have without any count, and corrections are added: for the terms of one source from the
histogram of its counts, and for terms of both from a frequent-pattern tree. Its rows are the nonzero shares of a term in
the order of the sources, with the number of terms that have just this row; rows with a common beginning share its
nodes, and a node meets each of its ancestors once, whatever the number of terms that pass through it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read

#: A term must be in so many documents of its language; terms listed for a source; shares are in units of 1 / SCALE.
LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Distinct words that a task counts before it passes them on, and cells of a tree.
HELD, CELLS = 200_000, 400_000
_LETTERS = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 97 <= k <= 122 else 32 for k in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (n) and documents (df) of each term in each source, for what the task has read."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def passed() -> pa.RecordBatch:
        flat = [(*key, w, n, df[w]) for key, (all_, df) in held.items() for w, n in all_.items()]
        lang, source, term, n, df = zip(*flat, strict=True) if flat else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])

    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().translate(_LETTERS).split()
            all_, df = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(all_)
            all_.update(words)
            df.update(set(words))
            size += len(all_)
            if size > HELD:
                yield passed()
                held.clear()
                size = 0
    yield passed()


def term_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, n, cells (source, n): each term in at least `least` documents of its language, with its sources."""
    counted = docs.select("text", "lang", "source").mapInArrow(_count, "lang string, source string, term string, n long, df long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    rows = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return rows.where(F.col("df") >= least).drop("df")


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """p of a term that occurs n times where all terms occur total times; null without terms."""
    whole = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({whole(n)} + 2)) DIV ({whole(total)} + 2 * {whole(terms)}) END")


def apart(p: Column, q: Column) -> Column:
    """f: the square of at most 10^18 fits a long, and DIV of positive longs is the floor."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_corrections(root: np.ndarray, size: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(root, a, b, value) for each pair of sources a before b that share a row of a root.

    Row k has size[k] cells (source, p, base), one after the other, belongs to tree root[k] and stands for times[k]
    terms. A term of both sources has counted f(p, base) and f(base, q) for them; the value puts this right.
    """
    first = np.cumsum(size) - size
    parent, where, deep, tree = [], [], [], []  # of each node: parent, one cell with its source and shares, multiplicity, root
    top = np.unique(root)
    at = np.searchsorted(top, root) - len(top)  # roots are -1, -2, ...
    alive, depth, made = np.arange(len(size)), 0, 0
    while len(alive := alive[size[alive] > depth]):
        cell = first[alive] + depth
        order = np.lexsort((p[cell], source[cell], at[alive]))
        key = np.stack([at[alive], source[cell], p[cell]])[:, order]
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        starts = np.nonzero(new)[0]
        parent.append(key[0, starts])
        where.append(cell[order[starts]])
        deep.append(np.add.reduceat(times[alive[order]], starts))
        tree.append(root[alive[order[starts]]])
        at[alive[order]] = made + np.cumsum(new) - 1
        made += len(starts)
        depth += 1
    if not made:
        return (np.zeros(0, np.int64),) * 4
    parent, where, deep, tree = map(np.concatenate, (parent, where, deep, tree))
    tree = np.searchsorted(top, tree)
    node, above, many = np.arange(made), parent, int(source.max()) + 1
    keys, values = [], []
    while len(node := node[above >= 0]):
        above = above[above >= 0]
        a, b = where[above], where[node]
        right = _far(p[a], p[b]) - _far(p[a], base[b]) - _far(base[a], p[b]) + _far(base[a], base[b])
        key, back = np.unique((tree[node] * many + source[a]) * many + source[b], return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, back, right * deep[node])
        keys.append(key)
        values.append(sums)
        above = parent[above]
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, back, np.concatenate(values))
    return top[key // many**2], key // many % many, key % many, sums


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over as many rows (lang, path, times) as make CELLS cells. Rows come in the order of their paths, so those
    with a common beginning meet in one tree; where one is cut, its pairs are only added up later."""
    held, size = [], 0

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lang, path = rows["lang"].combine_chunks().dictionary_encode(), rows["path"].combine_chunks()
        cells = path.flatten()
        source = cells.field("source").dictionary_encode()
        root, a, b, v = tree_corrections(np.asarray(lang.indices).astype(np.int64), np.diff(np.asarray(path.offsets)).astype(np.int64), np.asarray(source.indices).astype(np.int64), np.asarray(cells.field("p")), np.asarray(cells.field("base")), np.asarray(rows["times"]))
        take = lambda d, k: d.dictionary.take(pa.array(k))
        return pa.RecordBatch.from_arrays([take(lang, root), take(source, a), take(source, b), pa.array(v)], names=["lang", "a", "b", "value"])

    for batch in batches:
        held.append(batch)
        size += len(batch.column(1).flatten())
        if size > CELLS:
            yield done()
            held, size = [], 0
    if size:
        yield done()


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    part `pair`: every other source of the language by its distance; part `term`: the `top` terms that the source uses
    more than its language does. Null text, lang and source count as ''; a row is a document whatever its other columns.
    Sources without a kept term are compared too, languages without one have pairs of value 0, an empty table no rows.
    Ties are ordered by the bytes of the item. All numbers are exact. The counts of one term in all sources of a
    language make one row, and all pairs of sources are the result, so the sources of a language must be few enough for
    that; nothing else depends on their number.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    rows = cut(term_rows(docs, least))
    sums = rows.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = cut(groups.withColumn("base", share("0", "total", "terms")))
    cells = rows.select("lang", "term", F.col("n").alias("lang_n"), F.explode("cells").alias("c")).select("lang", "term", "lang_n", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    cells = cut(cells.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"), "base"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    terms = ranked(cells.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= top)

    one, two = groups.select("lang", F.col("source").alias("a"), F.col("base").alias("of_a"), "terms"), groups.select("lang", F.col("source").alias("b"), F.col("base").alias("of_b"))
    start = one.join(two, "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * apart(F.col("of_a"), F.col("of_b")), F.lit(0)).cast("long").alias("value"))
    # terms of one source against a source without them
    seen = cells.groupBy("lang", F.col("source").alias("a"), "base", "p").agg(F.count("*").alias("times"))
    alone = seen.join(two, "lang").where("a <> b").select("lang", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("times") * (apart(F.col("p"), F.col("of_b")) - apart(F.col("base"), F.col("of_b")))).alias("value"))
    paths = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "base"))).alias("path")).where(F.size("path") > 1)
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("times"))
    both = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(_trees, "lang string, a string, b string, value long")
    pairs = start.unionByName(alone.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), "value")).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = ranked(pairs.select("lang", ways.alias("w"), "value").select("lang", "w.*", "value"), "pair")
    return pairs.unionByName(terms)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= {LEAST}),
l AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(terms), 0) AS terms, coalesce(any_value(total), 0) AS lang_total FROM d LEFT JOIN l USING (lang) GROUP BY ALL),
s AS (SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * g.terms) AS p,
  1 + ({SCALE}::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.terms) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
v AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= {TOP}"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
