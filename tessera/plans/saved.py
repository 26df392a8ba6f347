"""A run of a saved query from its id: expand, classify, search, merge, dedup, store and rank, with stages chosen by name."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.render import render_result
from tessera.functions.text import doc_text
from tessera.functions.vector import taste
from tessera.operators import taste as ranking
from tessera.operators.feedback import with_profiles
from tessera.operators.fuse import fused_order, rank_results, rrf
from tessera.operators.ingest import classified, expand
from tessera.operators.ledger import delivered, next_seq, results_for, unseen
from tessera.operators.triage import Judge, Thresholds, judge_by_words, near_corpus, reconcile
from tessera.ports.auth import Principal, require_owner
from tessera.ports.models import embed_column
from tessera.ports.progress import Event, reported
from tessera.ports.search import AdapterMissing
from tessera.store.tables import Store, staged
from tessera.streaming.delivery import Claim, Send, deliver
from tessera.streaming.ticks import Run

#: Results of queries (query_id, text, domain, city) -> rows (query_id, pos, url, title, description).
Search = Callable[[DataFrame], DataFrame]
#: An order for the head (id, taste_pos, score) -> (query, place, idx, why); None keeps the taste's.
Rerank = Callable[[DataFrame], DataFrame]


#: Results shown where a query doesn't say.
MOST_SHOWN = 10


class UnknownQuery(LookupError):
    pass


def no_translations(queries: DataFrame) -> DataFrame:
    return queries.select("id", F.lit(None).cast("string").alias("query")).filter("false")


@dataclass(frozen=True)
class Stages:
    """What a run is made of; every part may be replaced."""

    search: Search
    translate: Callable[[DataFrame], DataFrame] = no_translations
    classify: Column = field(default_factory=lambda: F.lit("events"))
    embed: Callable[[Column], Column] = embed_column
    judge: Judge = field(default_factory=lambda: judge_by_words(0.5))
    rerank: Rerank | None = None
    thresholds: Thresholds = Thresholds()
    top_n: int = 25
    slots: int = 2


#: Makers of parts by stage and name; ``build`` picks from here, and what is registered can be named in settings.
PARTS: dict[str, dict[str, Callable[[], object]]] = {
    "translate": {"identity": lambda: no_translations},
    "classify": {"fallback": lambda: F.lit("events")},
    "embed": {"hash": lambda: embed_column},
    "judge": {"words": lambda: judge_by_words(0.5), "never": lambda: lambda pairs: [False] * len(pairs)},
    "rerank": {"none": lambda: None},
    "search": {},
}
#: Names that are known but have nothing behind them here.
NAMED_ONLY = {"search": {"exa", "linkup", "perplexity", "serper"}}


def build(named: dict[str, str], **more) -> Stages:
    """Stages from names, e.g. ``{"search": "recorded", "judge": "words"}``; a part that is missing raises before anything runs."""
    parts = {}
    for stage, name in named.items():
        if stage not in PARTS:
            raise ValueError(f"no stage {stage}")
        if name in NAMED_ONLY.get(stage, ()):
            raise NotImplementedError(f"{name} is named only")
        if name not in PARTS[stage]:
            raise AdapterMissing(f"{stage} {name} isn't registered")
        parts[stage] = PARTS[stage][name]()
    if "search" not in parts:
        raise AdapterMissing("a run needs a search")
    return Stages(**parts, **more)


def _flat(canonical: DataFrame) -> DataFrame:
    """Stored records with their place as columns, as triage takes them."""
    place = (F.col(f"geo.{c}").alias(c) for c in ("city", "country", "venue", "lat", "lon"))
    return canonical.select("*", *place).withColumnRenamed("source_search_result_ids", "source_ids").drop("geo", "city_key", "starts_epoch")


def run_saved(spark: SparkSession, store: Store, query_id: str, principal: Principal, stages: Stages, session: int, unseen_only: bool = False, listener: Callable[[Event], None] | None = None) -> DataFrame:
    """Run a saved query and return its ranking: id, score, rank, rationale, is_exploration.

    The query must exist and belong to ``principal``.  ``session`` numbers its runs: ids and
    versions come of it, so a run that is started again under its number writes the same.
    Ranked is all that the query has ever been linked to, but for what its owner was shown
    if ``unseen_only``.  Records without a vector get one before they are scored.
    """
    found = store.saved_queries().filter(F.col("id") == query_id).limit(1).collect()
    if not found:
        raise UnknownQuery(query_id)
    require_owner(principal, found[0]["user_id"])
    query = store.saved_queries().filter(F.col("id") == query_id)
    run = f"{query_id}-{session}"
    with reported("expand", listener):
        query = staged(classified(query, stages.classify), "saved-query")
        if found[0]["domain"] is None:
            store.append("saved_queries", query, session)
        asked = expand(query.select("id", "text", "domain", "city"), stages.translate(query), "id")
        # Expanded queries are numbered by their text, so that ranks don't depend on where rows lie.
        asked = asked.select(F.concat_ws("/", F.lit(run), F.col("query")).alias("query_id"), F.col("query").alias("text"), "domain", "city")
    with reported("search", listener):
        ranked = staged(rank_results(stages.search(asked), "query_id", "pos"), "ranked-results")
    with reported("merge", listener):
        fused = fused_order(rrf(ranked, ["url"], order=("rank", "query_id", "pos"), keep=("title", "description")), [], F.struct("first_seen", "url"))
    none = lambda kind: F.lit(None).cast(kind)
    with reported("dedup", listener):
        new = fused.select(
            F.lit(run).alias("run"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(run), F.col("url")), 256), 1, 22).alias("id"), "url", F.col("best.title").alias("title"), F.col("best.description").alias("description"),
            none("string").alias("city"), none("string").alias("venue"), none("timestamp").alias("starts_at"), none("string").alias("price"), F.col("place").alias("pos"), "score",
        )
        new = staged(new.withColumn("embedding", stages.embed(doc_text(F.col("title"), F.col("description")))), "candidates")
        known = _flat(store.view("canonical", below=session))
        done = reconcile(new, near_corpus(new, known, "run", stages.thresholds), "run", stages.judge, stages.thresholds)
    with reported("store", listener):
        raw = new.select("id", F.lit(query_id).alias("source_query_id"), "url", "title", "description", "price", F.col("pos").cast("int").alias("rank"), "score")
        store.append_as("raw_results", raw, session, once=run)
        store.upsert_canonical(done.golden.drop("run", "is_new"), done.provenance.drop("run"), session, once=run)
        pairs = done.outcomes.join(new.select(F.col("id").alias("candidate_id"), "pos"), "candidate_id").select(F.lit(query_id).alias("query_id"), "canonical_id", "pos")
        store.link(next_seq(store.links(), pairs, ["query_id", "canonical_id"], ["pos"]), session)
    with reported("rank", listener):
        linked = store.links().filter(F.col("query_id") == query_id).withColumnRenamed("canonical_id", "id")
        items = results_for(linked, store.view("canonical").select("id", "title", "description", "embedding"), "id")
        if unseen_only:
            shown = store.shown().filter(F.col("user_id") == principal.user_id).select(F.col("result_id").alias("id"))
            items = unseen(items, shown, ["id"])
        # Split, so that only texts without a vector go to the embedder.
        has = items.filter("embedding IS NOT NULL")
        lacks = items.filter("embedding IS NULL").withColumn("embedding", stages.embed(doc_text(F.col("title"), F.col("description"))))
        profile = with_profiles(query.select(F.col("id").alias("saved_query_id")), store.view("preferences"), "saved_query_id").select(F.col("saved_query_id").alias("query"), "liked_centroid", "disliked_centroid")
        scored = has.unionByName(lacks).join(F.broadcast(profile), F.col("query_id") == F.col("query"))  # one row
        scored = scored.select("query", "id", taste(F.col("embedding"), F.col("liked_centroid"), F.col("disliked_centroid")).alias("score"))
        scored = staged(scored, "scored-records")
        order = stages.rerank(ranking.prefilter(scored, "query", "id", stages.top_n)) if stages.rerank else None
        return ranking.ranked(scored, "query", "id", stages.top_n, stages.slots, order).drop("query")


def messages_of(store: Store, query_id: str, ranked: DataFrame, chat: str) -> DataFrame:
    """(chat_id, result_id, rank, message): what a ranking shows, under the query's cap, of records that still exist."""
    cap = store.saved_queries().filter(F.col("id") == query_id).select(F.coalesce("max_results_shown", F.lit(MOST_SHOWN)).alias("cap"))
    rows = ranked.crossJoin(F.broadcast(cap))  # one row
    shown = delivered(rows, store.view("canonical"), "id", "rank", "cap")
    text = render_result(F.col("title"), F.col("url"), F.col("starts_at"), F.col("ends_at"), F.col("price"), F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.col("rationale"))
    return shown.select(F.lit(chat).alias("chat_id"), F.col("id").alias("result_id"), "rank", text.alias("message"))


def run_and_deliver(spark: SparkSession, store: Store, query_id: str, stages: Stages, session: int, send: Send, claim: Claim, at: datetime) -> None:
    """Run a query as its owner, send what the owner hasn't seen, and mark it as shown once all of it is sent."""
    user = store.saved_queries().filter(F.col("id") == query_id).first()["user_id"]
    ranked = staged(run_saved(spark, store, query_id, Principal(user, "schedule"), stages, session, unseen_only=True), "ranking")
    messages = staged(messages_of(store, query_id, ranked, user), "messages")
    mark = lambda sent: store.mark_shown(sent.select(F.lit(user).alias("user_id"), "result_id", F.lit(at).alias("shown_at")), session)
    deliver(messages, send, claim, mark)


def scheduled_run(spark: SparkSession, store: Store, stages: Stages, send: Send, claim: Claim, isolate: bool = True, at_once: int = 8) -> Run:
    """What a tick does with its due queries (see ``streaming.ticks``): each is run and delivered, ``at_once`` of them side by side.

    The driver holds the ids of what is due and starts one plan each; a failure is that
    query's own if ``isolate``, else the tick's.  A tick's second is its session's number.
    """

    def run(due: DataFrame) -> DataFrame:
        def one(row) -> tuple[str, bool]:
            try:
                run_and_deliver(spark, store, row["id"], stages, int(row["now"].timestamp()), send, claim, row["now"])
            except Exception:
                if not isolate:
                    raise
                return row["id"], False
            return row["id"], True

        with ThreadPoolExecutor(at_once) as pool:
            marks = list(pool.map(one, due.select("id", "now").collect()))
        return spark.createDataFrame(marks, "id string, ok boolean")

    return run
