"""Preference ranking: taste, prefilter, submitted order, exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _n(partition: str, *order) -> F.Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1


def prefilter(scored: DataFrame, query: str, item: str, top_n: int) -> DataFrame:
    """The head: each query's ``top_n`` of falling taste, numbered by ``taste_pos``; each task keeps no more of a query before the shuffle."""
    return scored.withColumn("taste_pos", _n(query, F.desc("score"), F.col(item))).filter(F.col("taste_pos") < top_n)


def apply_submission(head: DataFrame, submission: DataFrame, query: str) -> DataFrame:
    """Order the head by the submitted places (place, idx, why); what was left out follows in taste order."""
    order = submission.select(query, F.col("idx").alias("taste_pos"), "place", "why")
    joined = head.join(order, [query, "taste_pos"], "left")
    return joined.withColumn("rerank_pos", _n(query, F.col("place").isNull(), "place", "taste_pos"))


def explore(scored: DataFrame, head: DataFrame, query: str, item: str, slots: int) -> DataFrame:
    """Of those behind the head, the ``slots`` whose taste is least decided, in taste order at ties (``explore_pos``).

    What is behind is told by the head's last row, so nothing but the explorers is numbered.
    """
    last = head.groupBy(query).agg(F.max_by(F.struct("score", item), "taste_pos").alias("_last"))
    behind = (F.col("score") < F.col("_last.score")) | ((F.col("score") == F.col("_last.score")) & (F.col(item) > F.col(f"_last.{item}")))
    rest = scored.join(last, query).filter(behind).drop("_last")
    return rest.withColumn("explore_pos", _n(query, F.abs("score"), F.desc("score"), F.col(item))).filter(F.col("explore_pos") < slots)


def ranked(scored: DataFrame, query: str, item: str, top_n: int, slots: int, submission: DataFrame | None = None) -> DataFrame:
    """(query, item, score, rank, rationale, is_exploration), from rows of (query, item, score).

    The head gives way to the explorers, but never shows less than none of itself: with
    more explorers than places the result is longer than ``top_n``.
    """
    first = head = prefilter(scored, query, item, top_n)
    if submission is None:
        head = head.withColumn("rerank_pos", F.col("taste_pos")).withColumn("why", F.lit(None).cast("string"))
    else:
        head = apply_submission(head, submission, query)
    explorers = explore(scored, first, query, item, slots)
    count = explorers.groupBy(query).agg(F.count(F.lit(1)).alias("_explorers"))
    size = first.groupBy(query).agg(F.count(F.lit(1)).alias("_out"))
    kept = head.join(size, query).join(count, query, "left").filter(F.col("rerank_pos") < F.greatest(F.col("_out") - F.coalesce("_explorers", F.lit(0)), F.lit(0)))
    kept = kept.select(query, item, "score", F.lit(0).alias("section"), F.col("rerank_pos").alias("pos"), F.col("why").alias("rationale"))
    shown = kept.unionByName(explorers.select(query, item, "score", F.lit(1).alias("section"), F.col("explore_pos").alias("pos"), F.lit(None).cast("string").alias("rationale")))
    return shown.withColumn("rank", _n(query, "section", "pos")).select(query, item, "score", "rank", "rationale", (F.col("section") == 1).alias("is_exploration"))
