"""A training corpus from the documents table: language ID, exact and near dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet and read back as
the next stage's docs. All stages but the last return the columns of documents, and further columns of docs, whatever
their names, come through unchanged. A stage works on all that its predecessor kept. Ids may be missing or repeat: a
row is then told apart by its text. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import cuckoo_dedup, language_id, mixing, packing, simhash_dedup
from almanac.llm.common import cut, read, trained_on, whole_row
from almanac.llm.token_counts import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: null texts and those without any letter, also where no row has a lang
    to learn from. All other rows stay, repeated ones too."""
    model = language_id.train(docs, trained_on(0))
    if model is None:
        return docs.where(language_id.has_letters("text"))
    return language_id.identify(docs.select("text", whole_row(docs).alias("row")), model).where("lang_pred <> 'und'").select("row.*")


#: Up to how many ids are broadcast to the scan of the texts (about 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_NO_ID = -(2**63)


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (doc_id, all different)."""
    ids = ids.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("own"), whole_row(docs).alias("row"))
    return rows.join(ids, F.col("own") == F.col("id"), "left_semi").select("row.*")


def _unique(found: DataFrame) -> bool:
    return found.count() == found.select("doc_id").distinct().count()


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the one of most code points, then of
    smallest doc_id (null last). Null, empty and blank texts are one group. Of rows that repeat id and text one stays."""
    found = cut(cuckoo_dedup.exact_duplicates(docs))
    kept = found.where("kept")
    if _unique(found):
        return _with_ids(docs, kept)
    # ids repeat: rows are told apart by their text
    named = docs.select("doc_id", cuckoo_dedup.text_sha(F.col("text")).alias("sha"), F.length(F.coalesce("text", F.lit(""))).alias("len"), whole_row(docs).alias("row"))
    kept = kept.select(F.col("doc_id").alias("id"), "text_sha256").distinct()
    rows = named.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    best = rows.groupBy(F.col("sha").alias("of")).agg(F.max("len").alias("most"))
    return rows.join(best, (F.col("sha") == F.col("of")) & (F.col("len") == F.col("most"))).dropDuplicates(["sha"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of smallest doc_id (null last), then of smallest text hash. Null,
    empty and blank texts have the fingerprint zero. Of rows that repeat id and text one stays."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    found = cut(simhash_dedup.near_groups(docs, 3, sha.alias("sha")))
    if _unique(found):
        return _with_ids(docs, found.select(F.col("component_id").alias("doc_id")).distinct())
    # ids repeat: groups go by their fingerprint, and rows are told apart by their text
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("sha").isNull(), F.col("sha").alias("of"))
    one = found.groupBy("component").agg(F.min(rank).alias("best")).select("best.id", "best.of")
    named = docs.select("doc_id", sha.alias("sha"), whole_row(docs).alias("row"))
    rows = named.join(one, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("sha").eqNullSafe(F.col("of")), "left_semi")
    return rows.dropDuplicates(["doc_id", "sha"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target mix of the sources draws them; a null source is a source of its own, and
    null texts have no words. Rows that repeat id and text are drawn together."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each drawn document lies. Null and empty texts are one end token; every row
    is a document of its own, repeated ones too."""
    return packing.pack(docs, vocabulary())


STAGES = [("language", language), ("exact_dedup", exact), ("simhash_dedup", near), ("source_mixing", mixed), ("packing", packed)]

#: SQL can't express language ID, SimHash components and tokens; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
