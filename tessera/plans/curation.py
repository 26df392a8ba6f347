"""One run of a saved query, stage by stage, over recorded results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import doc_text
from tessera.functions.vector import taste
from tessera.operators import taste as ranking
from tessera.operators.fuse import fused_order, rank_results, rrf
from tessera.operators.ledger import next_seq, unseen
from tessera.operators.triage import Judge, Thresholds, judge_by_words, near_corpus, reconcile
from tessera.ports.models import embed_column
from tessera.ports.progress import Event, reported
from tessera.ports.search import read_recorded
from tessera.store.tables import Store, staged


def run(
    spark: SparkSession, recorded: dict[str, list[dict]], corpus: DataFrame, profile: DataFrame, shown: DataFrame, top_n: int = 25, slots: int = 2, listener: Callable[[Event], None] | None = None,
    t: Thresholds = Thresholds(), name: str = "run", judge: Judge = judge_by_words(0.5),
) -> dict[str, DataFrame]:
    """Search, merge, dedup and rank.  ``name`` tells this run from others: ids of results and new records come of it.

    ``recorded``: query id -> result rows.  ``corpus``: known records (id, url, title,
    description, city, venue, starts_at, price, embedding).  ``profile``: one row with
    liked and disliked centroids.  ``shown``: canonical_id.  Returns the stages' outputs.
    """
    with reported("search", listener):
        found = rank_results(read_recorded(spark, recorded), "query_id", "pos")
    with reported("merge", listener):
        fused = rrf(found, ["url"], order=("rank", "query_id", "pos"), keep=("title", "description"))
    with reported("dedup", listener):
        none = lambda kind: F.lit(None).cast(kind)
        placed = fused_order(fused, [], F.struct("first_seen", "url"))
        new = placed.select(
            F.lit(name).alias("run"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(name), F.col("url")), 256), 1, 22).alias("id"), "url", F.col("best.title").alias("title"), F.col("best.description").alias("description"),
            none("string").alias("city"), none("string").alias("venue"), none("timestamp").alias("starts_at"), none("string").alias("price"), F.col("place").alias("pos"),
        )
        new = staged(new.withColumn("embedding", embed_column(doc_text(F.col("title"), F.col("description")))), "candidates")
        outcomes, golden, provenance = reconcile(new, near_corpus(new, corpus.drop("run"), "run", t), "run", judge, t)
    with reported("rank", listener):
        fresh = unseen(golden.select("id", "embedding"), shown.withColumnRenamed("canonical_id", "id"), ["id"])
        if profile.limit(2).count() > 1:
            raise ValueError("a run is for one profile")
        scored = fresh.crossJoin(F.broadcast(profile)).select(F.lit(0).alias("query"), "id", taste(F.col("embedding"), F.col("liked_centroid"), F.col("disliked_centroid")).alias("score"))
        ranked = ranking.ranked(scored, "query", "id", top_n, slots)
    return {"found": found, "fused": fused, "outcomes": outcomes, "golden": golden, "provenance": provenance, "ranked": ranked}


def store_run(store: Store, query_id: str, results: dict[str, DataFrame], version: int) -> None:
    """Keep what a run found: golden records, where their fields came from, and links from the query in the order of its ranking.

    Writes are upserts by version, so storing a run again changes nothing.
    """
    store.upsert_canonical(results["golden"].drop("run", "is_new"), results["provenance"].drop("run"), version)
    ranked = results["ranked"].select(F.lit(query_id).alias("query_id"), F.col("id").alias("canonical_id"), F.col("rank").alias("pos"))
    store.link(next_seq(store.links(), ranked, ["query_id", "canonical_id"], ["pos"]), version)
