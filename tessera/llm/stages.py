"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator.

A stage gives its rows keys of its own first, so that null and repeated ids don't matter:
each row is judged by its own text, and stays or goes by itself.  All but the last return
the columns of ``docs``, whatever these are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, staged, without
from tessera.llm.decontamination import leak_free
from tessera.llm.language_id import identify_documents
from tessera.llm.mixing import choose
from tessera.llm.sharding import shard_documents
from tessera.llm.simhash import similar_documents

KEY = "_row_key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows in which no language is recognised: null, empty and letterless texts.

    Ties between languages don't matter here.  Very long texts are read whole.
    """
    rows = keyed(docs, KEY)
    return without(rows, identify_documents(rows, (KEY,)).filter("NOT kept"), KEY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more over five-word shingles, found by SimHash, keep one.

    It is the one with the smallest doc_id, a null id coming last; of repeated rows the
    first.  Null, empty and wordless texts are copies of one another.  Very long texts are
    compared whole.
    """
    rows = keyed(docs, KEY)
    found = staged(similar_documents(rows, similarity=0.8, shingle_words=5, id_col=KEY, unique=True).select(KEY, "component_id"), "components-of-rows")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", KEY)
    stays = found.join(rows.select(KEY, "doc_id"), KEY).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{KEY}").alias(KEY))
    return without(rows, found.join(stays, KEY, "left_anti"), KEY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds a benchmark item at a similarity of 0.8 or more.

    Null and empty texts stay, as do all rows if the benchmark is empty; repeated rows are
    judged alike.  Very long texts are searched whole.
    """
    return leak_free(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose rows by target weights, each at most once; see ``mix`` for nulls, ties and long texts."""
    return choose(docs, fraction=0.6)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in a shard; the last stage returns places, not texts.  See ``shard_documents``."""
    return shard_documents(docs)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mix_sources), ("sharding", shard)]
