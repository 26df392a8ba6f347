"""Retrieval measures over rankings and gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import EVAL_CASE


def _hits(predicted: Column, gold: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(predicted, 1, k), gold))


def precision_at(predicted: Column, gold: Column, k: int) -> Column:
    """Hits among the first ``k`` over ``k``, even if fewer were predicted; 0 for no places."""
    return _hits(predicted, gold, k) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def recall_at(predicted: Column, gold: Column, k: int) -> Column:
    size = F.size(F.array_distinct(gold))
    return F.when(size > 0, _hits(predicted, gold, max(k, 0)) / size).otherwise(F.lit(0.0)) if k > 0 else F.lit(0.0)


def reciprocal_rank(predicted: Column, gold: Column) -> Column:
    places = F.filter(F.transform(predicted, lambda p, i: F.when(F.array_contains(gold, p), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(places) > 0, F.lit(1.0) / F.array_min(places)).otherwise(F.lit(0.0))


def cases(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """Recorded cases (name, stage, golden_ids) of JSON lines; of one stage if it is named."""
    rows = spark.read.schema(EVAL_CASE).json(path)
    return rows if stage is None else rows.filter(F.col("stage") == stage)


def scores(cases: DataFrame, name: str, predicted: str, gold: str, k: int) -> DataFrame:
    """(name, metric, value) for every case."""
    p, g = F.col(predicted), F.col(gold)
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in ((f"precision@{k}", precision_at(p, g, k)), (f"recall@{k}", recall_at(p, g, k)), ("mrr", reciprocal_rank(p, g)))))
    return cases.select(name, F.explode(pairs).alias("m")).select(name, "m.metric", "m.value")


def summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("cases"))
