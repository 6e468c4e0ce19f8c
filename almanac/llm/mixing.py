"""Mixing sources to target weights: quotas of blocks are split over output shards by hypergeometric draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read, whole_row

#: Blocks of a source, and output shards (a power of two).
BLOCKS, SHARDS = 1024, 64
#: Words of a shard that are shuffled together; a larger shard is dealt to several tasks.
PIECE_WORDS = 4_000_000
#: Up to how many rows the table of blocks is broadcast (about 60 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target for sizes (source, source_size): one row for each source, however many rows it has.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes. No target exceeds most
    times its source's size; what it gives up goes to the others by weight. With sources in the order of
    size / weight the first k are at their limit, and the others get an equal level by weight: k is the first place
    from which no source exceeds its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * most)
    rise = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    placed = ranked.withColumns({
        "below": F.coalesce(F.sum("limit").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    level = (F.col("total") - F.col("below")) / F.col("left")
    # the level at the first source that stays within its limit, which is the highest of those that do
    placed = placed.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("limit"), level)).over(everything))
    return placed.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _log_ratio(k: Column, good: Column, total: Column, n: Column) -> Column:
    """log p(k + 1) - log p(k) of the hypergeometric law: good among total, n drawn."""
    return F.log((good - k) * (n - k)) - F.log((k + 1) * (total - good - n + k + 1))


def hypergeometric(good: Column, total: Column, n: Column, u: Column) -> Column:
    """The number of good ones among n drawn without replacement, from a uniform u: the inverse of the distribution."""
    lo, hi = F.greatest(F.lit(0).cast("long"), n - (total - good)), F.least(good, n)
    steps = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        at = acc["at"] + _log_ratio(k, good, total, n)
        top = F.greatest(acc["top"], at)
        return F.struct(at.alias("at"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(at - top)).alias("sum"))

    mass = F.aggregate(steps, start, add)
    # the first k whose cumulative probability reaches u; what all steps need travels in the state, worked out once
    scan = F.transform(F.array(mass), lambda m: F.struct(F.lit(0.0).alias("at"), F.exp(-(m["top"] + F.log(m["sum"]))).alias("p"), lo.alias("k"), (m["top"] + F.log(m["sum"])).alias("all")))[0]

    def walk(acc: Column, k: Column) -> Column:
        at = acc["at"] + _log_ratio(k, good, total, n)
        p = F.when(acc["p"] >= u, acc["p"]).otherwise(acc["p"] + F.exp(at - acc["all"]))
        return F.struct(at.alias("at"), p.alias("p"), F.when(acc["p"] >= u, acc["k"]).otherwise(k + 1).alias("k"), acc["all"].alias("all"))

    return F.aggregate(steps, scan, walk)["k"]


def uniform(*by: Column) -> Column:
    """A repeatable number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*by), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, source rank, drawn, first: how many of each source's quota of block copies each output shard gets.

    quotas: (source_rank long, quota long). A node holds a quota for each source; half of its copies, drawn without
    regard to the source, go to its left child: a multivariate hypergeometric draw, source by source. The leaves are
    the shards, and the quotas add up exactly at every level. `first` is where the shard's run begins in the source's
    permuted list of copies.
    """
    node = quotas.groupBy(F.lit(0).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("source_rank", "quota"))).alias("own"))
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        start = F.struct(total.alias("total"), F.floor(total / 2).alias("draw"), F.expr("cast(array() as array<struct<source_rank:bigint,quota:bigint>>)").alias("out"))

        def one(acc: Column, x: Column) -> Column:  # called at once, with this level
            got = hypergeometric(x["quota"], acc["total"], acc["draw"], uniform(F.col("node"), x["source_rank"], F.lit(level), F.lit(seed)))
            after = lambda k: F.struct(
                (acc["total"] - x["quota"]).alias("total"),
                (acc["draw"] - k).alias("draw"),
                F.concat(acc["out"], F.array(F.struct(x["source_rank"].alias("source_rank"), k.alias("quota")))).alias("out"),
            )
            return F.transform(F.array(got), after)[0]

        drawn = node.withColumn("left", F.aggregate("own", start, one)["out"])
        right = F.zip_with("own", "left", lambda a, b: F.struct(a["source_rank"].alias("source_rank"), (a["quota"] - b["quota"]).alias("quota")))
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("own")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("own")))
        node = drawn.select(F.explode(children).alias("c")).select("c.node", "c.own")
    leaves = node.select(F.col("node").cast("int").alias("shard"), F.explode("own").alias("x")).select("shard", "x.source_rank", F.col("x.quota").alias("drawn"))
    before = Window.partitionBy("source_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows; else the join is left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def block_of(seed: int, blocks: int, own: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), own), F.lit(blocks)).cast("int")


def place_of(seed: int, own: Column) -> Column:
    """Where a document stands in the permutation of its block."""
    return F.xxhash64(F.lit(seed), own)


def key_of(doc_id: Column, text: Column) -> Column:
    """What names a document: its id and its text, so that missing or repeated ids do not tie documents together."""
    return F.xxhash64(doc_id, text)


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, block plan). rows: doc_id, source, size, block, place of each document. Block plan: one row for each block
    of each source with source_size, target, whole (copies of all its documents), until (one more copy of the documents
    whose place is at most this), also (the place of one document more) and the shards of its copies."""
    rows = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("own")))
    rows = rows.withColumns({"block": block_of(seed, blocks, F.col("own")), "place": place_of(seed, F.col("own"))})
    sums = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    wanted = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most).withColumn("source_rank", F.xxhash64("source"))
    # copies in full for all blocks, and one more for the first blocks of the source's permutation, the last in part
    per = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    b = sums.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    b = b.withColumns({"whole": full, "turn": F.row_number().over(per) - 1, "before": F.coalesce(F.sum("words").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    b = b.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size") - F.col("before"))
    partial = b.where("rest > 0 and rest < words").select("source", "block", "rest")
    # the documents of the one block of a source that is taken in part
    inner = Window.partitionBy("source", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = rows.join(partial.withColumnsRenamed({"source": "of", "block": "bk"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("bk"))).drop("of", "bk")
    fits = F.col("sum") <= F.col("rest")
    ends = tail.withColumn("sum", F.sum("size").over(inner)).groupBy("source", "block").agg(F.max(F.when(fits, F.col("place"))).alias("end"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0)).alias("got"))
    b = b.join(ends.withColumnsRenamed({"source": "of", "block": "bk"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("bk")), "left").drop("of", "bk")
    whole_block = (F.col("rest") >= F.col("words")) & (F.col("rest") > 0)
    b = cut(b.withColumns({"until": F.when(whole_block, F.lit(2**63 - 1)).otherwise(F.col("end")), "more": F.when(whole_block, F.col("words")).otherwise(F.coalesce("got", F.lit(0)))}))
    # the words that a source still lacks: the one document not yet drawn again whose size comes nearest, if that helps
    gaps = b.groupBy("source").agg((F.first("target") - F.first("whole") * F.first("source_size") - F.sum("more")).alias("gap")).where("gap > 0.5").withColumnRenamed("source", "of")
    spare = rows.join(_small(b.select(F.col("source").alias("so"), F.col("block").alias("bk"), "until")), F.col("source").eqNullSafe(F.col("so")) & (F.col("block") == F.col("bk"))).where("until is null or place > until")
    near = spare.join(_small(gaps), F.col("source").eqNullSafe(F.col("of"))).where("abs(size - gap) < gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "block", "place")).alias("x"))
    near = near.select(F.col("source").alias("of"), F.col("x.block").alias("bk"), F.col("x.place").alias("also"))
    b = b.join(near, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("bk")), "left").drop("of", "bk")
    b = b.withColumn("copies", F.col("whole") + F.when(F.coalesce("until", "also").isNotNull(), 1).otherwise(0))
    # the copies of a source in a permuted order: all blocks, then all again, then those with one more
    copies = b.where("copies > 0").select("source", "source_rank", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    turn = Window.partitionBy("source_rank").orderBy(F.xxhash64(F.lit(seed + 3), "source", "block", "copy"), "block", "copy")
    copies = copies.withColumn("nth", F.row_number().over(turn) - 1)
    quotas = copies.groupBy("source_rank").agg(F.count("*").alias("quota"))
    tree = split_tree(quotas, shards, seed + 4).where("drawn > 0").withColumnRenamed("source_rank", "rank")
    dealt = copies.join(tree, (F.col("source_rank") == F.col("rank")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("drawn")))
    dealt = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    b = b.join(dealt.withColumnsRenamed({"source": "of", "block": "bk"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("bk")), "left").drop("of", "bk")
    return rows, cut(b.select("source", "block", "source_size", "target", "whole", "until", "also", F.transform("dealt", lambda x: x["shard"]).alias("shards")))


def _with_plan(rows: DataFrame, blocks: DataFrame, seed: int, n: int) -> DataFrame:
    """rows (source, own, ...) with plan, that of their block, and shards, one for each copy of the row."""
    side = _small(blocks).select(F.col("source").alias("of"), F.col("block").alias("bk"), F.struct("source_size", "target", "whole", "until", "also", "shards").alias("plan"))
    out = rows.join(side, F.col("source").eqNullSafe(F.col("of")) & (block_of(seed, n, F.col("own")) == F.col("bk"))).drop("of", "bk")
    place = place_of(seed, F.col("own"))
    copies = F.col("plan.whole") + F.when((place <= F.col("plan.until")) | (place == F.col("plan.also")), 1).otherwise(0)
    return out.withColumn("shards", F.when(copies > 0, F.slice("plan.shards", 1, copies)).otherwise(F.array().cast("array<int>")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as it is drawn, dealt to shards and shuffled there.

    docs: doc_id, text, source, and any further columns, whatever their names. Every source gives about its target in
    words; no document is drawn more than `most` times. Null texts have no words; documents without words are drawn
    with their block. Rows without a doc_id, or with one that repeats, are told apart by their text; rows that repeat
    both share a place and are drawn together. An empty table gives an empty result.
    """
    _, by_block = plan(docs, weights, most, blocks, shards, seed)
    rows = docs.select("source", key_of(F.col("doc_id"), F.col("text")).alias("own"), whole_row(docs).alias("row"))
    out = _with_plan(rows, by_block, seed, blocks).select("row", "own", F.posexplode("shards").alias("copy", "shard"))
    total = by_block.groupBy("source").agg(F.first("target").alias("t")).agg(F.coalesce(F.sum("t"), F.lit(0.0))).first()[0]
    out = out.withColumn("order", F.xxhash64(F.lit(seed + 5), "own", "copy")).withColumn("piece", F.pmod("order", F.lit(1 + int(total / shards / PIECE_WORDS))))
    return out.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "order").select("row.*")


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted) and copies.

    One row for each row of docs, also for those that are not drawn; see mix() for nulls, repeats and empty tables.
    """
    rows, by_block = plan(docs, weights, most, blocks, shards, seed)
    out = _with_plan(rows, by_block, seed, blocks)
    copies = F.size("shards")
    return out.select("doc_id", "size", "plan.source_size", "plan.target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"))
