"""What a reader of many analyses asks for: filtered pages over link tables, split citations, summaries in sentences, and
vectors of summaries that are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import views
from ..plans.registry import query, table
from ..plans.written import shared_dir
from ..sources.store import Kept, Outcome, Store
from .lexical import BUCKETS, SPARSE, Vectorizer, dense, embed
from .pages import page
from .summaries import is_evidence

# fixed values: terms that a summary names
TERMS = 8


def analyses_page(analyses: DataFrame, tags: DataFrame | None = None, owner: int | None = None, status: str | None = None, favourite: bool | None = None, project: int | None = None, tag: str | None = None, title: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of analyses (analysis_id, owner_id, project_id, status, is_favorite, title, created_at), newest first, with
    the total of what the filters leave. tags: analysis_id, slug; an analysis that has a tag twice is listed once. title
    is looked for anywhere, whatever its case, and taken as it is written."""
    found = analyses
    for column, value in (("owner_id", owner), ("status", status), ("is_favorite", favourite), ("project_id", project)):
        found = found if value is None else found.where(F.col(column) == value)
    if title is not None:
        found = found.where(F.contains(F.lower("title"), F.lit(title.lower())))
    if tag is not None:
        found = found.join(tags.where(F.col("slug") == tag).select("analysis_id"), "analysis_id", "left_semi")
    total = found.agg(F.count("*").alias("total")).first()["total"]
    return page(found, [F.desc("created_at"), F.col("analysis_id")], limit, offset).withColumn("total", F.lit(total))


def split_citations(citations: DataFrame) -> DataFrame:
    """analysis_id, verified, unverified: the different citations (analysis_id, citation, verified) of each analysis in
    order; one that is verified anywhere is verified."""
    each = citations.groupBy("analysis_id", "citation").agg(F.bool_or(F.coalesce("verified", F.lit(False))).alias("v"))
    listed = lambda on: F.array_sort(F.collect_list(F.when(on, F.col("citation"))))
    return each.groupBy("analysis_id").agg(listed(F.col("v")).alias("verified"), listed(~F.col("v")).alias("unverified"))


def summary(words: Column, language: Column, title: Column, identified: Column, score: Column, claims: Column, evidence: Column, conjectures: Column, calculations: Column, terms: Column, rationale: Column, failed: Column) -> Column:
    """A text of sentences that are put together from counts, none of them free; what is null or empty is passed over.
    terms and failed: arrays of names, which are told in order, of the terms TERMS at most."""
    say = F.format_string
    named = F.array_sort(F.array_distinct(terms))
    more = F.size(named) - TERMS
    return F.concat_ws(
        " ",
        F.when(language.isNotNull(), say("The text has %d words in %s.", words, language)).otherwise(say("The text has %d words.", words)),
        F.when(title.isNull(), "No work of the corpus is close to it.").when(identified, say("It corresponds to %s (%.2f).", title, score)).otherwise(say("The closest work is %s, not close enough to identify it.", title)),
        say("There are %d findings, %d of them evidence and %d conjecture.", claims, evidence, conjectures),
        F.when(calculations > 0, say("%d were calculated and can be calculated again.", calculations)),
        F.when(F.size(named) > 0, F.concat(F.lit("It speaks of "), F.array_join(F.slice(named, 1, TERMS), ", "), F.when(more > 0, say(" and %d more", more)).otherwise(""), F.lit("."))),
        rationale,
        F.when(F.size(failed) > 0, F.concat(F.lit("Stages that failed and have no findings: "), F.array_join(F.array_sort(failed), ", "), F.lit("."))),
        F.lit("Every finding is labelled by its kind; conjectures and interpretations are not established fact."),
    )


def summary_store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """A store of one row for each analysis: analysis_id, title, and its vector without the zeros."""
    named = [T.StructField("analysis_id", T.LongType()), T.StructField("title", T.StringType())]
    return Store(spark, root, {"summaries": Kept(T.StructType([*named, *SPARSE]), ("analysis_id",))}, buckets)


def stored_summaries(store: Store) -> DataFrame:
    """analysis_id, title and vector of all that is stored."""
    return dense(store.read("summaries"))


def refresh_summaries(store: Store, analyses: DataFrame, vectorizer: Vectorizer | None = None) -> Outcome:
    """Put the vectors of title and summary of analyses (analysis_id, title, summary) in place of older ones; the other
    buckets of the store stay as they are."""
    texts = analyses.select("analysis_id", "title", F.concat_ws(". ", "title", "summary").alias("text"))
    return store.put({"summaries": embed(texts, "analysis_id", vectorizer, ["title"], sparse=True).drop("tokens")})


_PROJECT = "analysis_id % 5"


@query("b1_filtered_page", views.WITH + f""", tagged AS (SELECT DISTINCT l_orderkey AS analysis_id FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT * FROM analyses WHERE status = 'completed' AND {_PROJECT} = 3 AND contains(lower(title), 'e') AND analysis_id IN (SELECT analysis_id FROM tagged))
SELECT analysis_id, owner_id, title, count(*) OVER () AS total FROM f ORDER BY created_at DESC, analysis_id LIMIT 30 OFFSET 4""")
def b1_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyses = views.analyses(spark, sf_dir).withColumn("project_id", F.expr(_PROJECT))
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_returnflag").alias("slug"))
    return analyses_page(analyses, tags, status="completed", project=3, tag="R", title="E", limit=30, offset=4).select("analysis_id", "owner_id", "title", "total")


@query("d14_split_citations", f"""WITH c AS ({views.CITATIONS_SQL}), e AS (SELECT analysis_id, citation, bool_or(verified) AS v FROM c GROUP BY ALL)
SELECT analysis_id, coalesce(string_agg(citation, '|' ORDER BY citation) FILTER (WHERE v), '') AS verified, coalesce(string_agg(citation, '|' ORDER BY citation) FILTER (WHERE NOT v), '') AS unverified FROM e GROUP BY analysis_id""")
def d14_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_citations(views.citations(spark, sf_dir)).select("analysis_id", *(F.array_join(c, "|").alias(c) for c in ("verified", "unverified")))


_EVIDENCE = "('source_text', 'verified_history', 'astronomical_calculation')"


@query("m8_whole_summaries", views.WITH + f""", c AS (SELECT analysis_id, count(*) AS n, count(*) FILTER (WHERE claim_type IN {_EVIDENCE}) AS e, count(*) FILTER (WHERE claim_type = 'ai_hypothesis') AS h, count(*) FILTER (WHERE claim_type = 'astronomical_calculation') AS k,
  list_sort(list(DISTINCT section)) AS terms, list_sort(list(DISTINCT produced_by) FILTER (WHERE engine IS NULL)) AS failed, sum(part) AS words, max(part) AS best FROM claims GROUP BY analysis_id)
SELECT analysis_id, concat_ws(' ', CASE WHEN best % 3 = 0 THEN concat('The text has ', words, ' words.') ELSE concat('The text has ', words, ' words in English.') END,
  CASE WHEN best % 5 = 0 THEN 'No work of the corpus is close to it.' WHEN best % 2 = 0 THEN concat('It corresponds to work ', best, ' (', printf('%.2f', (best % 100)::DOUBLE / 100), ').') ELSE concat('The closest work is work ', best, ', not close enough to identify it.') END,
  concat('There are ', n, ' findings, ', e, ' of them evidence and ', h, ' conjecture.'), CASE WHEN k > 0 THEN concat(k, ' were calculated and can be calculated again.') END,
  concat('It speaks of ', array_to_string(terms[1:{TERMS}], ', '), CASE WHEN len(terms) > {TERMS} THEN concat(' and ', len(terms) - {TERMS}, ' more') ELSE '' END, '.'),
  CASE WHEN len(failed) > 0 THEN concat('Stages that failed and have no findings: ', array_to_string(failed, ', '), '.') END, 'Every finding is labelled by its kind; conjectures and interpretations are not established fact.') AS summary FROM c""")
def m8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries over claims, with sections as the terms and the stages without an engine as those that failed."""
    count, best = F.count_if, F.col("best")
    c = views.claims(spark, sf_dir).groupBy("analysis_id").agg(
        F.count("*").alias("n"), count(is_evidence()).alias("e"), count(F.col("claim_type") == "ai_hypothesis").alias("h"), count(F.col("claim_type") == "astronomical_calculation").alias("k"),
        F.collect_set("section").alias("terms"), F.collect_set(F.when(F.col("engine").isNull(), F.col("produced_by"))).alias("failed"), F.sum("part").alias("words"), F.max("part").alias("best"),
    )
    text = summary(F.col("words"), F.when(best % 3 != 0, "English"), F.when(best % 5 != 0, F.format_string("work %d", best)), best % 2 == 0, (best % 100).cast("double") / 100, F.col("n"), F.col("e"), F.col("h"), F.col("k"), F.col("terms"), F.lit(None).cast("string"), F.col("failed"))
    return c.select("analysis_id", text.alias("summary"))


@query("e13_stored_summaries", f"SELECT o_orderkey AS analysis_id, concat('Order ', o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN ', revised' ELSE '' END) AS title, {BUCKETS} AS size FROM orders")
def e13_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all orders as analyses, and then again of every fiftieth, which only changes those buckets."""
    store = summary_store(spark, f"{shared_dir(spark)}/summaries-{uuid.uuid4().hex}", 16)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("summary"))
    refresh_summaries(store, rows)
    refresh_summaries(store, rows.where("analysis_id % 50 = 0").withColumn("title", F.concat("title", F.lit(", revised"))))
    return stored_summaries(store).select("analysis_id", "title", F.size("vector").alias("size"))
