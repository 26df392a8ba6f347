"""Feedback: centroids, counts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ws_trim
from tessera.functions.vector import advance


def centroids(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, value, n): the mean of each component, folded before the shuffle."""
    return rows.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("value"), F.count(F.lit(1)).alias("n"))


def packed(long: DataFrame, keys: list[str], name: str = "centroid") -> DataFrame:
    """Centroids as vectors; a group holds as many rows as a vector has components."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    return long.groupBy(*keys).agg(listed.alias(name), F.max("n").alias("n"))


def fold_one(centroid: Column, count: Column, value: Column) -> Column:
    return advance(centroid, count, value)


def incremental(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, centroid, n): what folding a profile's vectors one by one comes to.

    The running mean doesn't depend on the order, so it is the folded sums' quotient: a key
    with very many vectors is one row per task and component before the shuffle.  ``order``
    is named for the caller's sake; ``fold_one`` is the single step.
    """
    return packed(centroids(rows, [key], vector), [key])


def counts(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    like, dislike = F.count_if(F.col(kind) == "like"), F.count_if(F.col(kind) == "dislike")
    return rows.groupBy(*keys).agg(like.alias("like_count"), dislike.alias("dislike_count"), (like + dislike).alias("label_count"))


def with_profiles(queries: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Every query with its profile, an empty one where it has none."""
    joined = queries.join(profiles, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("like_count", "dislike_count")})


def known_only(feedback: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Feedback on items that exist."""
    return feedback.join(items.select(item).distinct(), item, "left_semi")


class UnknownResult(LookupError):
    pass


def refuse_unknown(feedback: DataFrame, items: DataFrame, item: str) -> None:
    """Raise if any feedback is on an item that doesn't exist: nothing may be written then."""
    unknown = feedback.join(items.select(item).distinct(), item, "left_anti").select(item).distinct().limit(10).collect()
    if unknown:
        raise UnknownResult(f"no results {sorted(str(r[0]) for r in unknown)}")


def parse_summary(text: Column) -> Column:
    """A model's summary without outer space; blank is none."""
    return F.nullif(ws_trim(text), F.lit(""))


def record(profiles: DataFrame, feedback: DataFrame, items: DataFrame, summaries: DataFrame | None = None, key: str = "saved_query_id", item: str = "canonical_search_result_id") -> DataFrame:
    """Profiles after a batch of feedback: new centroids, counts and summaries, for the queries it is about.

    ``profiles``: key, nl_summary, liked_centroid, disliked_centroid, like_count,
    dislike_count.  ``feedback``: key, item, kind.  ``items``: item, embedding.  Feedback on
    an unknown item raises before anything is returned.  Each kind's vectors are summed,
    and the old centroid counts as often as it has been fed; items without a vector count
    but don't move a centroid.  ``summaries``: key, text; a blank one leaves the old.
    """
    refuse_unknown(feedback, items, item)
    rows = feedback.join(items.select(item, F.col("embedding").cast("array<double>").alias("v")), item)
    fed = counts(rows, [key], "kind")
    sums = rows.filter("v IS NOT NULL").select(key, "kind", F.posexplode("v").alias("i", "x")).groupBy(key, "kind", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    packed_sums = sums.groupBy(key, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"), F.max("n").alias("n"))
    out = fed.select(key, F.col("like_count").alias("_like"), F.col("dislike_count").alias("_dislike")).join(profiles, key, "left")
    for kind, centroid, count in (("like", "liked_centroid", "like_count"), ("dislike", "disliked_centroid", "dislike_count")):
        mine = packed_sums.filter(F.col("kind") == kind).select(key, F.col("s").alias("_s"), F.col("n").alias("_n"))
        before = F.when(F.col(centroid).isNull(), F.lit(0)).otherwise(F.coalesce(count, F.lit(0)))
        moved = F.when(F.col(centroid).isNull(), F.transform("_s", lambda x: x / F.col("_n"))).otherwise(F.zip_with(centroid, "_s", lambda c, x: (c * before + x) / (before + F.col("_n"))))
        out = out.join(mine, key, "left").withColumn(centroid, F.when(F.col("_s").isNull(), F.col(centroid)).otherwise(moved)).drop("_s", "_n")
        out = out.withColumn(count, F.coalesce(count, F.lit(0)).cast("bigint") + F.col(f"_{kind}")).drop(f"_{kind}")
    if summaries is None:
        return out
    said = summaries.select(key, parse_summary(F.col("text")).alias("_text"))
    return out.join(said, key, "left").withColumn("nl_summary", F.coalesce("_text", "nl_summary")).drop("_text")
