"""Links, shown results, upserts and deletions as set operations over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last version of each key, by one folded aggregation."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return log.groupBy(*keys).agg(newest.alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def insert_ignore(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key; the first one's ``seq`` stays."""
    return log.groupBy(*keys).agg(F.min(seq).alias(seq))


def without(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def unseen(results: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Results that the ledger doesn't have for the same user, whichever query showed them."""
    return without(results, ledger, keys)


def results_for(links: DataFrame, canonical: DataFrame, on: str) -> DataFrame:
    """Linked records that still exist; ``seq`` says in which order they were linked."""
    return links.join(canonical, on)


def delivered(ranked: DataFrame, canonical: DataFrame, on: str, rank: str, cap: str) -> DataFrame:
    """Ranked rows under each query's cap that still exist."""
    return ranked.filter(F.col(rank) < F.col(cap)).join(canonical, on)


#: Ranges of keys that are numbered apart.
RANGES = 1024


def next_seq(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """New keys with sequence numbers that go on after the existing ones, each at its smallest ``order``.

    Within a first key, numbers rise by ``order``; first keys follow by hashed ranges.  Each
    range is numbered by itself and shifted by the counts before it, RANGES at most, so no
    task numbers everything.  Columns other than these aren't returned.
    """
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_at")).join(existing.select(*keys), keys, "left_anti")
    fresh = fresh.withColumn("_range", F.pmod(F.xxhash64(keys[0]), F.lit(RANGES)).cast("int"))
    total = existing.agg(F.coalesce(F.max(seq), F.lit(0))).first()[0]
    counts = {r["_range"]: r["count"] for r in fresh.groupBy("_range").count().collect()}
    ahead, at = [], total
    for k in range(RANGES):
        ahead.append(at)
        at += counts.get(k, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(keys[0], "_at", *keys[1:]))
    start = F.array(*map(F.lit, ahead))[F.col("_range")]
    return fresh.select(*keys, *(F.col(f"_at.{c}").alias(c) for c in order if c not in keys), (start + place).alias(seq))
