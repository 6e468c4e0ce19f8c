"""Token counts by a compiled byte-level BPE transducer (see transducer.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transducer
from .common import read


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary file; the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    Null and empty texts have no bytes and no tokens. Texts are counted whole, however long; no begin or end token is
    added, and strings of added tokens inside a text count as one token. An empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer.load(path)
        for t in texts:
            yield pd.Series(machine.count(t.tolist()))

    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": count(text)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")
