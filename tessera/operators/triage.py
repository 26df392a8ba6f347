"""Deduplication decisions: tiers, held-back pairs, exact sequential mode, bulk components."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions.text import casefold, doc_text, filled, set_similarity, shingles, ws_trim
from tessera.operators.block import DAY, blocked_knn
from tessera.store.tables import staged

AUTO_MERGE, TIEBREAK, INSERT_NEW = "auto_merge", "tiebreak", "insert_new"


@dataclass(frozen=True)
class Thresholds:
    auto: float = 0.88
    low: float = 0.75
    days: int = 1
    limit: int = 10


def same_place_and_time(venue_a: Column, venue_b: Column, start_a: Column, start_b: Column) -> Column:
    """Venues alike but for case and outer space, and equal instants; an unknown one never matches."""
    key = lambda c: casefold(ws_trim(c))
    return F.coalesce(filled(venue_a).isNotNull() & filled(venue_b).isNotNull() & (key(venue_a) == key(venue_b)) & (start_a == start_b), F.lit(False))


def combined(similarity: Column, lexical: Column) -> Column:
    return F.greatest(similarity, lexical)


def tier(similarity: Column, place_time: Column, t: Thresholds = Thresholds()) -> Column:
    """2: merge, 1: ask, 0: new."""
    return F.when(similarity >= t.auto, 2).when((similarity >= t.low) | place_time, 1).otherwise(0)


def decide(best: DataFrame, same_url: str | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``decision`` and the reported ``similarity``: rows have similarity and tier of the best match, or null."""
    url = F.col(same_url) if same_url else F.lit(False)
    decision = F.when(url | (F.col("tier") == 2), AUTO_MERGE).when(F.col("tier") == 1, TIEBREAK).otherwise(INSERT_NEW)
    return best.withColumn("similarity", F.when(url, F.lit(1.0)).otherwise(F.col("similarity"))).withColumn("decision", decision)


def best_match(pairs: DataFrame, candidate: str, other: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Per candidate the pair of highest tier, then similarity, then nearest place."""
    order = Window.partitionBy(candidate).orderBy(F.desc("tier"), F.desc("similarity"), "knn_pos", other)
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def resolve(pending: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """Held-back pairs with their verdicts; a pair without one is two items."""
    return pending.join(verdicts, on, "left").withColumn("same", F.coalesce("same", F.lit(False)))


#: A key with more rows than this, or than its share of them, is joined by broadcast: there are few such keys.
HEAVY_ROWS, MOST_HEAVY = 10_000, 50_000


def _heavy(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """The keys of very many rows, MOST_HEAVY at most; None where there can't be one."""
    least = max(HEAVY_ROWS, -(-total // MOST_HEAVY))
    return rows.groupBy(key).count().filter(F.col("count") > least).select(key) if total > least else None


def _looked_up(rows: DataFrame, values: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with one row of ``values`` per key; the rows of a heavy key aren't brought together."""
    if heavy is None:
        return rows.join(values, key)
    few = F.broadcast(staged(values.join(F.broadcast(heavy), key, "left_semi"), "heavy-values"))
    usual = rows.join(F.broadcast(heavy), key, "left_anti").join(values, key)
    return usual.unionByName(rows.join(few, key))


def components(nodes: DataFrame, links: DataFrame, rounds: int = 1000) -> DataFrame:
    """Bulk mode: (id, component), the smallest id reachable over ``links`` (a, b).

    Each row offers the smallest label among its neighbours to itself and to the row that
    its own label names, so that whole trees are hooked on; then labels are replaced by
    their labels' labels.  This goes on until nothing changes; ``rounds`` is a safety bound
    at which an error is raised.  Every round is written to the shared folder.  Transitive
    closure isn't the sequential result.

    A row with very many neighbours and the label of a very large component are looked up
    by broadcast (there are at most MOST_HEAVY of them), so neither fills one task.
    """
    both = staged(links.select("a", F.col("b").alias("id")).union(links.select("b", F.col("a").alias("id"))).distinct(), "links")
    labels = staged(nodes.select("id", F.col("id").alias("component")), "labels")
    size = labels.count()
    hubs = _heavy(both, "id", both.count())
    hubs = staged(hubs, "hubs") if hubs is not None else None
    for _ in range(rounds):
        near = _looked_up(both, labels, "id", hubs).groupBy("a").agg(F.min("component").alias("m"))
        offers = staged(labels.join(near, labels.id == near.a, "left").select("id", "component", F.least("component", "m").alias("m")), "offers")
        hooks = offers.filter("m < component").groupBy(F.col("component").alias("root")).agg(F.min("m").alias("hook"))
        new = staged(offers.join(hooks, offers.id == hooks.root, "left").select("id", F.least("m", "hook").alias("component")), "hooked")
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = staged(_looked_up(new, jump, "component", _heavy(new, "component", size)).select("id", F.least("component", "further").alias("component")), "labels")
        if new.join(labels.withColumnRenamed("component", "was"), "id").filter("component <> was").isEmpty():
            return new
        labels = new
    raise RuntimeError(f"components not settled after {rounds} rounds")


def url_links(records: DataFrame) -> DataFrame:
    """(a, b): each record and the smallest id of its url, so a url of many records is a star."""
    known = staged(records.filter("url IS NOT NULL AND url <> ''").select("id", "url"), "urls")
    first = known.groupBy("url").agg(F.min("id").alias("b"))
    return _looked_up(known, first, "url", _heavy(known, "url", known.count())).filter("id <> b").select(F.col("id").alias("a"), "b")


def similarity_links(records: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(a, b, similarity): pairs that the exact mode would merge at once, among each record's nearest in its block.

    Candidates are the ``t.limit`` records of highest cosine in the block; a link is verified
    by the larger of cosine and the exact Jaccard similarity of word pairs.
    """
    place = F.nullif(casefold(ws_trim(F.col("city"))), F.lit(""))
    at = (F.unix_micros(F.col("starts_at").cast("timestamp")) / 1e6).alias("at")
    x = staged(records.select("id", place.alias("city"), at, F.col("embedding").alias("v"), shingles(doc_text(F.col("title"), F.col("description"))).alias("words")), "similar-records")
    pairs = blocked_knn(x.withColumn("k", F.lit(t.limit)), x.filter("v IS NOT NULL"), t.days)
    words = lambda name: x.select(F.col("id").alias(name), F.col("words").alias(f"{name}_words"))
    # Each record stands in ``limit`` rows on the left; on the right a hub may stand in many.
    near = staged(pairs.select(F.col("q_id").alias("a"), F.col("id").alias("b"), "similarity").join(words("a"), "a"), "near-pairs")
    near = _looked_up(near, words("b"), "b", _heavy(near, "b", near.count()))
    return near.withColumn("similarity", combined(F.col("similarity"), set_similarity(F.col("a_words"), F.col("b_words")))).filter(F.col("similarity") >= t.auto).select("a", "b", "similarity")


def bulk_reconcile(records: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(id, component): records joined by equal urls and by verified similarity, whatever their order.

    ``records``: id, url, title, description, city, starts_at, embedding.  What the golden
    record and its provenance are is then a fold per component; see ``survive``.
    """
    links = url_links(records).unionByName(similarity_links(records, t).select("a", "b"))
    return components(records.select("id"), links)


# ---------------------------------------------------------------- exact sequential mode


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    na, nb = math.sqrt(math.sumprod(a, a)), math.sqrt(math.sumprod(b, b))
    return math.sumprod(a, b) / (na * nb) if na and nb else 0.0


def _shingles(text: str) -> set[str]:
    w = text.casefold().split()
    return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _text(r: dict) -> str:
    return f"{r.get('title') or ''}\n{r.get('description') or ''}".strip()


def _blank(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v)) or (isinstance(v, str) and not v.strip()) or v is pd.NaT


#: Fields of which the first filled value stays, and the parts of a place, filled one by one.
FIELDS = ("title", "description", "starts_at", "ends_at", "price", "image_url", "city", "country", "venue", "lat", "lon")
GOLDEN = (
    "id string, url string, title string, description string, starts_at timestamp, ends_at timestamp, price string, image_url string, city string, country string, venue string, lat double, lon double, "
    "attributes map<string,string>, embedding array<double>, source_ids array<string>, first_seen_at timestamp, last_seen_at timestamp, is_new boolean"
)

#: Ambiguous pairs in, verdicts out, asked once per run and not at all without pairs.
Judge = Callable[[list[tuple[dict, dict]]], list[bool]]


class Run:
    """What one run knows: its records, the urls seen in it, outcomes, where each field came from."""

    def __init__(self, corpus: list[dict], name: Callable[[str], str] = str):
        """``name`` makes a new record's id from the id of the result it comes from."""
        self.name = name
        self.items = {r["id"]: dict(r) for r in corpus}
        self.new: set[str] = set()
        self.by_url: dict[str, str] = {}
        self.outcomes: dict[int, dict] = {}
        self.provenance: list[dict] = []

    def _took(self, target: str, c: dict, fields: list[str]) -> None:
        self.provenance += [{"canonical_id": target, "field": f, "source_id": c["id"]} for f in fields]

    def insert(self, pos: int, c: dict, decision: str, similarity: float | None) -> None:
        seen, new = c.get("fetched_at"), self.name(c["id"])
        attributes = {k: v for k, v in (c.get("attributes") or {}).items() if not _blank(v)}
        self.items[new] = {**c, "id": new, "attributes": attributes, "source_ids": [c["id"]], "first_seen_at": seen, "last_seen_at": seen}
        self.new.add(new)
        self.by_url[c["url"]] = new
        self._took(new, c, [*(f for f in FIELDS if not _blank(c.get(f))), *(f"attributes.{k}" for k in sorted(attributes))])
        self.outcomes[pos] = {"candidate_id": c["id"], "decision": decision, "canonical_id": new, "similarity": similarity}

    def merge(self, pos: int, c: dict, target: str, decision: str, similarity: float) -> None:
        """Fill what the record lacks, remember both urls, the source, and when it was seen."""
        item = self.items[target]
        filled_ = [f for f in FIELDS if _blank(item.get(f)) and not _blank(c.get(f))]
        for f in filled_:
            item[f] = c[f]
        own = dict(item.get("attributes") or {})
        more = {k: v for k, v in (c.get("attributes") or {}).items() if not _blank(v) and _blank(own.get(k))}
        item["attributes"] = own | more
        item["source_ids"] = list(dict.fromkeys([*(item.get("source_ids") if item.get("source_ids") is not None else []), c["id"]]))
        seen = [x for x in (item.get("first_seen_at"), item.get("last_seen_at"), c.get("fetched_at")) if not _blank(x)]
        item["first_seen_at"], item["last_seen_at"] = (min(seen), max(seen)) if seen else (None, None)
        self.by_url[item["url"]] = self.by_url[c["url"]] = target
        self._took(target, c, [*filled_, *(f"attributes.{k}" for k in sorted(more))])
        self.outcomes[pos] = {"candidate_id": c["id"], "decision": decision, "canonical_id": target, "similarity": similarity}

    def best(self, c: dict, t: Thresholds) -> tuple[tuple[int, float], str] | None:
        """The best of the nearest records in the candidate's block: ((tier, similarity), id)."""
        near = []
        for other in self.items.values():
            if other.get("embedding") is None:
                continue
            a, b = c.get("city"), other.get("city")
            if not _blank(a) and not _blank(b) and a.strip().casefold() != b.strip().casefold():
                continue
            if not _blank(c.get("starts_at")) and not _blank(other.get("starts_at")) and abs((c["starts_at"] - other["starts_at"]).total_seconds()) > t.days * DAY:
                continue
            near.append((_cosine(c["embedding"], other["embedding"]), other))
        near.sort(key=lambda x: (-x[0], x[1]["id"]))
        best = None
        for cos, other in near[: t.limit]:
            s = max(cos, _jaccard(_shingles(_text(c)), _shingles(_text(other))))
            placed = not any(_blank(x) for x in (c.get("venue"), other.get("venue"), c.get("starts_at"), other.get("starts_at"))) and c["venue"].strip().casefold() == other["venue"].strip().casefold() and c["starts_at"] == other["starts_at"]
            key = (2 if s >= t.auto else 1 if s >= t.low or placed else 0, s)
            if best is None or key > best[0]:
                best = (key, other["id"])
        return best


def fold_run(candidates: list[dict], corpus: list[dict], judge: Judge, t: Thresholds = Thresholds(), name: Callable[[str], str] = str) -> Run:
    """Triage candidates one after another: what one inserts or fills, the next can match.

    A url that this run has seen, be it a new record's or a merged candidate's, settles a
    candidate at once.  Ambiguous ones are held back, asked about together at the end, and
    don't see each other.
    """
    run = Run(corpus, name)
    pending: list[tuple[int, dict, str, float]] = []
    for pos, c in enumerate(candidates):
        if c["url"] in run.by_url:
            run.merge(pos, c, run.by_url[c["url"]], AUTO_MERGE, 1.0)
            continue
        best = run.best(c, t)
        if best is None:
            run.insert(pos, c, INSERT_NEW, None)
        elif best[0][0] == 2:
            run.merge(pos, c, best[1], AUTO_MERGE, best[0][1])
        elif best[0][0] == 1:
            pending.append((pos, c, best[1], best[0][1]))
        else:
            run.insert(pos, c, INSERT_NEW, best[0][1])
    verdicts = judge([(c, run.items[target]) for _, c, target, _ in pending]) if pending else []
    for (pos, c, target, s), same in zip(pending, verdicts, strict=True):
        if same and target in run.items:
            run.merge(pos, c, target, TIEBREAK, s)
        else:
            run.insert(pos, c, TIEBREAK, s)
    return run


def fresh_id(run: object, source_id: str) -> str:
    """The id of the record that a run makes of a result: the same on a retry, another in each run."""
    return hashlib.sha256(f"{run}\x1f{source_id}".encode()).hexdigest()[:22]


def near_corpus(candidates: DataFrame, corpus: DataFrame, run_col: str, t: Thresholds = Thresholds()) -> DataFrame:
    """The corpus rows that a run's fold can touch, with the run they are for.

    These are each candidate's nearest rows in its block: as many as the fold looks at, and
    as many more as the run has candidates, since each can at most move one row out of a
    block by filling a field.
    """
    at = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    place = lambda c: F.nullif(casefold(ws_trim(c)), F.lit(""))
    block = lambda df: (place(F.col("city")).alias("city"), at(F.col("starts_at")).alias("at"), F.col("embedding").alias("v"))
    size = candidates.groupBy(run_col).agg(F.count(F.lit(1)).alias("_n"))
    key = F.to_json(F.struct(run_col, "id"))
    left = candidates.join(size, run_col).select(key.alias("id"), *block(candidates), (F.col("_n") + t.limit).cast("int").alias("k"))
    found = blocked_knn(left, corpus.filter("embedding IS NOT NULL").select("id", *block(corpus)), t.days, but_itself=False)
    kind = candidates.schema[run_col].dataType.simpleString()
    asked = F.from_json("q_id", f"{run_col} {kind}")[run_col].alias(run_col)
    return found.select(asked, "id").distinct().join(corpus.drop(run_col), "id")


class Reconciled(NamedTuple):
    """Views of one staged table: what was decided, records inserted or filled, which result gave each field."""

    outcomes: DataFrame
    golden: DataFrame
    provenance: DataFrame


_OUTCOME = "candidate_id string, decision string, canonical_id string, similarity double"
_GIVEN = "field string, source_id string"


#: Rows that become Python values, or results that become a batch, at a time.
FOLDED = 1000


def _values(column: pa.Array) -> list:
    """A column as Python values: instants in the session's zone, unknown parts of a vector as NaN."""
    kind = column.type
    if pa.types.is_timestamp(kind):
        return (pc.local_timestamp(column) if kind.tz else column).to_pylist()
    if pa.types.is_list(kind) and pa.types.is_floating(kind.value_type):
        flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
        starts = [0, *ends]
        return [flat[at:to] if known else None for at, to, known in zip(starts, ends, column.is_valid().to_pylist(), strict=False)]
    return column.to_pylist()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, FOLDED):
            part = batch.slice(at, FOLDED)
            for row in zip(*map(_values, part.columns), strict=True):
                r = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in zip(part.schema.names, row, strict=True)}
                if "attributes" in r:
                    r["attributes"] = dict(r["attributes"] or {})
                yield r


def _batch(found: list[dict], schema: pa.Schema, zone: str) -> pa.RecordBatch:
    def column(f: pa.Field) -> pa.Array:
        given = [o.get(f.name) for o in found]
        if pa.types.is_timestamp(f.type):
            return pc.assume_timezone(pa.array(given, pa.timestamp("us")), zone, ambiguous="earliest", nonexistent="earliest").cast(f.type)
        return pa.array([x if x is None else list(x.items()) for x in given] if pa.types.is_map(f.type) else given, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def reconcile(candidates: DataFrame, corpus: DataFrame, run_col: str, judge: Judge, t: Thresholds = Thresholds()) -> Reconciled:
    """Exact mode: one fold per run, over the run's candidates (in the order of ``pos``, then id) and the corpus rows it may touch.

    A run is a few dozen candidates; ``near_corpus`` bounds its corpus rows; runs are spread
    over tasks, and a task reads its rows in the order of runs and folds one run after the
    other.  The fold gives outcomes, golden records and provenance at once, in one table
    that is written now: the judge is asked once a run, however often the results are read.
    ``candidates`` is read once, here; give ``near_corpus`` the same written rows.
    """
    kind = candidates.schema[run_col].dataType.simpleString()
    schema = f"{run_col} {kind}, what string, {_OUTCOME}, {_GIVEN}, {GOLDEN}"
    arrow, zone = to_arrow_schema(StructType.fromDDL(schema)), candidates.sparkSession.conf.get("spark.sql.session.timeZone")

    def results(name: object, known: list[dict], asked: list[dict]) -> Iterator[dict]:
        run = fold_run(asked, known, judge, t, lambda raw: fresh_id(name, raw))
        touched = {o["canonical_id"] for o in run.outcomes.values()}
        yield from ({run_col: name, "what": "outcome", **run.outcomes[k]} for k in sorted(run.outcomes))
        yield from ({**r, run_col: name, "what": "golden", "is_new": r["id"] in run.new} for r in run.items.values() if r["id"] in touched)
        yield from ({run_col: name, "what": "given", **r} for r in run.provenance)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        for name, rows in itertools.groupby(_records(batches), lambda r: r[run_col]):
            sides: dict[bool, list[dict]] = {True: [], False: []}
            for r in rows:
                sides[r.pop("_known")].append(r)
            if sides[False]:
                found += results(name, sides[True], sides[False])
            if len(found) >= FOLDED:
                yield _batch(found, arrow, zone)
                found = []
        if found:
            yield _batch(found, arrow, zone)

    corpus = corpus.select(*(F.col(c).alias(c) for c in corpus.columns))  # it may stem from the same table as the candidates
    both = candidates.withColumn("_known", F.lit(False)).unionByName(corpus.withColumn("_known", F.lit(True)), allowMissingColumns=True)
    ordered = both.repartition(run_col).sortWithinPartitions(run_col, F.desc("_known"), F.col("pos").asc_nulls_last(), "id")
    table = staged(ordered.mapInArrow(fold, schema), "reconciled")
    names = lambda ddl: [f.name for f in StructType.fromDDL(ddl)]
    view = lambda what, *cols: table.filter(F.col("what") == what).select(run_col, *cols)
    return Reconciled(view("outcome", *names(_OUTCOME)), view("golden", *names(GOLDEN)), view("given", "canonical_id", *names(_GIVEN)))


def judge_by_words(least: float) -> Judge:
    """A deterministic stand-in for a judging model: exact Jaccard of word pairs."""
    return lambda pairs: [_jaccard(_shingles(_text(a)), _shingles(_text(b))) >= least for a, b in pairs]


def judge_prompt(pairs: list[tuple[dict, dict]]) -> str:
    """The pairs as one request, numbered from 1."""
    show = lambda r: {k: str(r[k]) if not _blank(r.get(k)) else "unknown" for k in ("title", "description", "city", "venue", "starts_at", "price", "url")}
    return "\n".join(f"Pair {i}: {json.dumps({'A': show(a), 'B': show(b)}, ensure_ascii=False)}" for i, (a, b) in enumerate(pairs, 1))
