"""The flagship: ranked lists fused, scored by taste, with places for exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vector import as_vector, taste
from tessera.operators import taste as ranking
from tessera.operators.feedback import centroids, packed
from tessera.operators.fuse import fused_order, rrf
from tessera.sources.tables import table


def part_lists(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """Four ranked lists: the parts of highest revenue per return flag and line status."""
    items = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    revenue = items.groupBy(*keys, "l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    order = Window.partitionBy(*keys).orderBy(F.desc("revenue"), "l_partkey")
    return revenue.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).filter(F.col("rank") < most).withColumn("list", F.concat("l_returnflag", "l_linestatus"))


def taste_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scored against the centroids of liked (0, 1) and disliked (2, 3) labels; one query per label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("v", as_vector(F.col("embedding")))
    kind = F.when(F.col("label").isin(0, 1), "like").when(F.col("label").isin(2, 3), "dislike")
    means = packed(centroids(vectors.withColumn("kind", kind).filter("kind IS NOT NULL"), ["kind"], "v"), ["kind"])
    sides = means.agg(F.max(F.when(F.col("kind") == "like", F.col("centroid"))).alias("liked"), F.max(F.when(F.col("kind") == "dislike", F.col("centroid"))).alias("disliked"))
    return vectors.crossJoin(F.broadcast(sides)).select(F.col("label").alias("query"), "vec_id", F.round(taste(F.col("v"), F.col("liked"), F.col("disliked")), 6).alias("score"))  # sides is one row


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = part_lists(spark, sf_dir).withColumn("pos", F.col("l_partkey"))
    fused = fused_order(rrf(lists, ["l_partkey"], order=("rank", "list", "pos")), [])
    ranked = ranking.ranked(taste_scores(spark, sf_dir), "query", "vec_id", 25, 2)
    return ranked.join(fused.select(F.col("place").cast("int").alias("rank"), "l_partkey", F.round("score", 9).alias("fused_score")), "rank", "left")
