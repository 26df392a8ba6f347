"""Ranked lists: numbering within a source, fan-in, reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.url import canonical_url


def rank_results(rows: DataFrame, query: str, pos: str, url: str = "url", most: int = 20) -> DataFrame:
    """Canonical urls numbered from 0 without gaps per query, blank ones dropped, the first ``most`` kept."""
    rows = rows.withColumn(url, canonical_url(F.col(url))).filter(F.col(url) != "")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(pos))
    return rows.withColumn("rank", rank - 1).filter(F.col("rank") < most)


def fan_in(lists: list[DataFrame]) -> DataFrame:
    """Lists of one query, told apart by ``list_idx``."""
    return reduce(DataFrame.unionByName, (x.withColumn("list_idx", F.lit(i).cast("bigint")) for i, x in enumerate(lists)))


def rrf(rows: DataFrame, keys: list[str], k: int = 60, order: tuple[str, ...] = ("rank", "list_idx", "pos"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Fuse by the sum of 1 / (k + rank + 1) over all sightings; ranks count from 0.

    The representative is the sighting of lowest rank, the first one at ties.  One
    aggregation, folded before the shuffle.
    """
    best = F.min_by(F.struct(*keep, *order), F.struct(*order))
    first = F.min(F.struct(*(c for c in order if c != "rank")))
    return rows.groupBy(*keys).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank") + 1.0)).alias("score"), best.alias("best"), first.alias("first_seen"), F.count(F.lit(1)).alias("sightings"))


def fused_order(fused: DataFrame, partition: list[str], tie: Column | str = "first_seen") -> DataFrame:
    """Places from 0 by falling score, first sighting first at ties."""
    return fused.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("score"), tie)) - 1)
