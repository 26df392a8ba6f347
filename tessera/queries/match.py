"""Similarity, blocking, triage, fusion and golden-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import casefold, shingles as shingles_of, set_similarity, ws_trim
from tessera.functions.vector import as_vector, cosine, normalized
from tessera.operators import block, fuse, survive, triage
from tessera.operators.triage import Thresholds
from tessera.plans.flagship import part_lists
from tessera.queries.registry import query
from tessera.queries.text import _JACC, CANON_SQL, shingles_sql
from tessera.sources.tables import seconds, table, values, values_sql
from tessera.store.tables import staged

#: Ids that are broadcast, at most (some tens of MB); more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000

_VEC = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", as_vector(F.col("embedding")).alias("v"), "label")


def _next_vector(spark, d):
    v = _vectors(spark, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


@query(f"WITH {_VEC} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    return _next_vector(spark, d).select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


@query(f"WITH {_VEC} SELECT a.vec_id, round(1 - list_cosine_distance(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def float32_cosine(spark, d):
    """One less the distance, from stored single-precision vectors."""
    distance = 1 - cosine(F.col("v"), F.col("w"))
    return _next_vector(spark, d).select("vec_id", F.round(1 - distance, 6).alias("similarity"))


@query(f"WITH {_VEC}, n AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: 9 * x * x))) AS n, v FROM vec) SELECT vec_id, round(list_sum(list_transform(v, lambda x: (3 * x / n) * (3 * x / n))), 6) AS squared FROM n")
def l2_normalize(spark, d):
    unit = normalized(F.transform("v", lambda x: x * 3))
    return _vectors(spark, d).select("vec_id", F.round(F.aggregate(F.transform(unit, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("squared"))


@query(
    f"""WITH {_VEC}, {shingles_sql('documents', 'doc_id')},
p AS (SELECT a.vec_id, round(greatest(list_cosine_similarity(a.v, b.v), 0.0), 6) AS c FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1),
j AS (SELECT a.doc_id AS vec_id, {_JACC} AS j FROM sh a JOIN sh b ON b.doc_id = a.doc_id + 1)
SELECT vec_id, greatest(c, j) AS similarity FROM p JOIN j USING (vec_id)"""
)
def combined_similarity(spark, d):
    """Neighbouring vectors and the texts of the same ids, whichever is more alike."""
    v = staged(_next_vector(spark, d).select("vec_id", F.round(F.greatest(cosine(F.col("v"), F.col("w")), F.lit(0.0)), 6).alias("c")), "vector-pairs")
    # Only texts of these ids and the next ones are compared; each is cut into shingles once.
    asked = staged(v.select(F.explode(F.array("vec_id", F.col("vec_id") + 1)).alias("doc_id")).distinct(), "asked-ids")
    docs = table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(asked) if asked.count() <= MOST_BROADCAST_IDS else asked, "doc_id", "left_semi")
    texts = staged(docs.select(F.col("doc_id").alias("vec_id"), shingles_of(F.col("text")).alias("s")), "shingles")
    j = texts.join(texts.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t")), "vec_id").select("vec_id", F.round(set_similarity(F.col("s"), F.col("t")), 6).alias("j"))
    return v.join(j, "vec_id").select("vec_id", triage.combined(F.col("c"), F.col("j")).alias("similarity"))


@query(
    f"""WITH {_VEC}, s AS (SELECT q.vec_id AS q_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity FROM vec q JOIN vec c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) - 1 AS INTEGER) AS knn_pos FROM s) SELECT * FROM r WHERE knn_pos < 10"""
)
def knn_top10(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all."""
    v = _vectors(spark, d)
    return block.knn(v.filter("vec_id % 100 = 0"), v, "vec_id", "v", 10)


_EVENTS = """ev AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS city, CASE WHEN event_id % 17 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS at FROM events)"""
_BLOCK = "(a.city IS NULL OR b.city IS NULL OR a.city = b.city) AND (a.at IS NULL OR b.at IS NULL OR abs(a.at - b.at) <= 86400)"


def _events(spark, d):
    """Events with some cities and instants made unknown."""
    e = table(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("city"), F.when(F.col("event_id") % 17 != 0, seconds("ts")).alias("at"))


def _embedded(spark, d):
    return _events(spark, d).join(_vectors(spark, d).select(F.col("vec_id").alias("event_id"), "v"), "event_id")


_PAIRS = f"""{_VEC}, {_EVENTS}, x AS (SELECT ev.*, v FROM ev JOIN vec ON event_id = vec_id),
p AS (SELECT a.event_id AS c, b.event_id AS o, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM x a JOIN x b ON a.event_id <> b.event_id AND {_BLOCK} WHERE a.event_id % 100 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c ORDER BY similarity DESC, o) - 1 AS INTEGER) AS knn_pos FROM p)"""


def _near(spark, d):
    x = _embedded(spark, d).withColumnRenamed("event_id", "id")
    found = block.blocked_knn(x.filter("id % 100 = 0").withColumn("k", F.lit(10)), x)
    return found.withColumnsRenamed({"q_id": "c", "id": "o"})


@query(f"WITH {_PAIRS} SELECT * FROM k WHERE knn_pos < 10")
def blocked_knn(spark, d):
    return _near(spark, d)


@query(f"WITH {_EVENTS} SELECT coalesce(a.city, '?') AS city, count(*) AS pairs FROM ev a JOIN ev b ON {_BLOCK} WHERE a.event_id % 100 = 0 GROUP BY a.city")
def block_pairs(spark, d):
    """How many events the block of every hundredth event holds, by city."""
    e = _events(spark, d)
    found = block.block_sizes(e.filter("event_id % 100 = 0"), e).filter("pairs > 0")
    return found.groupBy(F.coalesce("city", F.lit("?")).alias("city")).agg(F.sum("pairs").alias("pairs"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE ' V' || CAST(user_id AS VARCHAR) END AS v, date_trunc('day', ts) AS s, user_id, ts FROM events),
l AS (SELECT *, lag(v) OVER w AS pv, lag(s) OVER w AS ps FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(trim(v) <> '' AND trim(pv) <> '' AND lower(trim(v)) = lower(trim(pv)) AND s = ps, false) AS same FROM l"""
)
def venue_time_match(spark, d):
    """Each event against the user's one before: same venue, same instant (here the day)."""
    venue = F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.concat(F.lit(" V"), F.col("user_id").cast("string")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", venue.alias("v"), F.expr("cast(ts as date)").alias("s"))
    e = e.withColumn("pv", F.lag("v").over(w)).withColumn("ps", F.lag("s").over(w))
    return e.select("event_id", triage.same_place_and_time(F.col("v"), F.col("pv"), F.col("s"), F.col("ps")).alias("same"))


_RECORDS = """x AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS city, CASE WHEN event_id % 17 = 0 THEN NULL ELSE date_trunc('day', ts) END AS starts_at,
  CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'Hall ' || user_id % 2 END AS venue, event_type AS title, 'u' || user_id % 9 || ' x' || event_id % 4 || ' y' || event_id % 5 AS description, CAST(embedding AS DOUBLE[]) AS v
  FROM events JOIN embeddings ON vec_id = event_id)"""
_WORDS = "list_distinct([{0}.title || ' ' || split_part({0}.description, ' ', 1), split_part({0}.description, ' ', 1) || ' ' || split_part({0}.description, ' ', 2), split_part({0}.description, ' ', 2) || ' ' || split_part({0}.description, ' ', 3)])"
_LEXICAL = f"(len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) / CAST(len(list_distinct(list_concat({_WORDS.format('a')}, {_WORDS.format('b')}))) AS DOUBLE))"


def _matched_sql(asked: str, known: str) -> str:
    """Per record of ``asked`` its best match among the ten nearest of ``known`` in its block; null where the block is empty."""
    return f"""{_RECORDS},
pr AS (SELECT a.event_id AS c, b.event_id AS o, b.id AS oid, list_cosine_similarity(a.v, b.v) AS cos, {_LEXICAL} AS lex, a.venue <> ' ' AND b.venue <> ' ' AND lower(a.venue) = lower(b.venue) AND a.starts_at IS NOT NULL AND a.starts_at IS NOT DISTINCT FROM b.starts_at AS placed
  FROM x a JOIN x b ON a.event_id <> b.event_id AND (a.city IS NULL OR b.city IS NULL OR a.city = b.city) AND (a.starts_at IS NULL OR b.starts_at IS NULL OR abs(epoch(a.starts_at) - epoch(b.starts_at)) <= 86400) WHERE {asked} AND {known}),
kn AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(cos, 6) DESC, oid) - 1 AS knn_pos FROM pr),
ti AS (SELECT *, round(greatest(cos, lex), 6) AS similarity, CASE WHEN greatest(cos, lex) >= 0.3 THEN 2 WHEN greatest(cos, lex) >= 0.19 OR placed THEN 1 ELSE 0 END AS tier FROM kn WHERE knn_pos < 10),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tier DESC, similarity DESC, knn_pos) AS n FROM ti) WHERE n = 1),
de AS (SELECT a.event_id AS c, a.id, o, oid, similarity, lex, CASE WHEN tier = 2 THEN 'auto_merge' WHEN tier = 1 THEN 'tiebreak' ELSE 'insert_new' END AS decision FROM x a LEFT JOIN be ON be.c = a.event_id WHERE {asked})"""


_TIERS = Thresholds(auto=0.3, low=0.19)


def _records(spark, d):
    """Events that have a vector, as records: some without a city, an instant or a venue."""
    e = table(spark, d, "events").join(_vectors(spark, d).select(F.col("vec_id").alias("event_id"), "v"), "event_id")
    user, number = F.col("user_id"), F.col("event_id")
    text = F.concat(F.lit("u"), (user % 9).cast("string"), F.lit(" x"), (number % 4).cast("string"), F.lit(" y"), (number % 5).cast("string"))
    return e.select(
        "event_id", number.cast("string").alias("id"), F.when(number % 13 != 0, F.col("event_type")).alias("city"), F.when(number % 17 != 0, F.expr("cast(cast(ts as date) as timestamp)")).alias("starts_at"),
        F.when(number % 7 == 0, " ").otherwise(F.concat(F.lit("Hall "), (user % 2).cast("string"))).alias("venue"), F.col("event_type").alias("title"), text.alias("description"), F.col("v").alias("embedding"),
    )


@query(f"WITH {_matched_sql('a.event_id % 100 = 0', 'true')} SELECT c, o, CASE WHEN c % 400 = 0 THEN 1.0::DOUBLE ELSE similarity END AS similarity, CASE WHEN c % 400 = 0 THEN 'auto_merge' ELSE decision END AS decision FROM de")
def triage_decision(spark, d):
    """Every hundredth event against all, by vector, words, venue and day; every fourth of them counts as a url already known."""
    r = _records(spark, d)
    at = F.unix_micros("starts_at") / 1e6
    x = r.select("id", "city", at.alias("at"), F.col("embedding").alias("v"))
    pairs = block.blocked_knn(x.filter("id % 100 = 0").withColumn("k", F.lit(_TIERS.limit)), x, _TIERS.days)
    side = lambda p: r.select(F.col("id").alias(f"{p}_id"), F.col("event_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("venue", "starts_at")), shingles_of(F.concat_ws(" ", "title", "description")).alias(f"{p}_words"))
    pairs = pairs.withColumnsRenamed({"q_id": "c_id", "id": "o_id"}).join(side("c"), "c_id").join(side("o"), "o_id")
    similarity = F.round(triage.combined(F.col("similarity"), set_similarity(F.col("c_words"), F.col("o_words"))), 6)
    pairs = pairs.withColumn("similarity", similarity).withColumn("tier", triage.tier(F.col("similarity"), triage.same_place_and_time(F.col("c_venue"), F.col("o_venue"), F.col("c_starts_at"), F.col("o_starts_at")), _TIERS))
    best = triage.best_match(pairs, "c", "o", _TIERS)
    asked = r.filter("event_id % 100 = 0").select(F.col("event_id").alias("c")).join(best, "c", "left")
    return triage.decide(asked.withColumn("known", F.col("c") % 400 == 0), "known", _TIERS).select("c", "o", "similarity", "decision")


@query("SELECT d.doc_id, coalesce(l.quality = 1, false) AS same FROM documents d LEFT JOIN labels l USING (doc_id)")
def resolve_pending(spark, d):
    """Documents as held-back pairs; labels as verdicts; no verdict means no."""
    verdicts = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("same"))
    return triage.resolve(table(spark, d, "documents").select("doc_id"), verdicts, ["doc_id"])


@query("SELECT source, count(*) FILTER (WHERE quality = 1) AS affirmed, count(*) AS asked FROM documents JOIN labels USING (doc_id) GROUP BY source")
def verdict_count(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("affirmed"), F.count(F.lit(1)).alias("asked"))


@query(
    """WITH l AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER w <= 7200 THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM l)
SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id, g) AS component FROM s"""
)
def components(spark, d):
    """Events linked to the user's one before if at most two hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.col("event_id"), seconds("ts").alias("at"))
    links = e.withColumn("b", F.lag("id").over(w)).withColumn("gap", F.col("at") - F.lag("at").over(w)).filter("gap <= 7200").select(F.col("id").alias("a"), "b")
    return triage.components(e.select("id"), links)


# ---------------------------------------------------------------- ranking and fusion


@query(f"WITH {CANON_SQL}, h AS (SELECT page_id, canon, regexp_extract(canon, '^[a-z]+://([^/?#]*)', 1) AS host FROM canon WHERE canon <> ''), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS INTEGER) AS rank FROM h) SELECT host, rank, page_id FROM r WHERE rank < 20")
def search_rank(spark, d):
    from tessera.functions.url import canonical_url

    pages = table(spark, d, "pages").select("page_id", "url").withColumn("host", F.regexp_extract(canonical_url(F.col("url")), "^[a-z]+://([^/?#]*)", 1))
    return fuse.rank_results(pages, "host", "page_id").select("host", "rank", "page_id")


_LISTS = """rv AS (SELECT l_returnflag, l_linestatus, l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY revenue DESC, l_partkey) - 1 AS rank, l_returnflag || l_linestatus AS list FROM rv),
li AS (SELECT * FROM rk WHERE rank < 50)"""


def _fused(spark, d):
    return fuse.rrf(part_lists(spark, d), ["l_partkey"], order=("rank", "list"))


@query(f"WITH {_LISTS} SELECT l_partkey, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, count(*) AS sightings FROM li GROUP BY l_partkey")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("l_partkey", F.round("score", 9).alias("score"), "sightings")


@query(f"WITH {_LISTS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY rank, list) AS n FROM li) SELECT l_partkey, list, rank FROM o WHERE n = 1")
def rrf_representative(spark, d):
    return _fused(spark, d).select("l_partkey", "best.list", "best.rank")


@query(f"WITH {_LISTS}, t AS (SELECT l_partkey, rank FROM li UNION ALL SELECT l_partkey, rank + 10 FROM li WHERE rank = 0) SELECT l_partkey, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM t GROUP BY l_partkey")
def rrf_duplicate_in_list(spark, d):
    """Each list's first part is sighted in it a second time; both sightings count."""
    lists = part_lists(spark, d)
    twice = lists.unionByName(lists.filter("rank = 0").withColumn("rank", F.col("rank") + 10))
    return fuse.rrf(twice, ["l_partkey"], order=("rank", "list")).select("l_partkey", F.round("score", 9).alias("score"))


@query("SELECT event_id, 0::BIGINT AS list_idx FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, 1::BIGINT FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 2::BIGINT FROM events WHERE event_type = 'purchase'")
def fan_in_union(spark, d):
    e = table(spark, d, "events")
    return fuse.fan_in([e.filter(F.col("event_type") == k).select("event_id") for k in ("signup", "error", "purchase")])


# ---------------------------------------------------------------- golden records

_SEEN = """seen AS (SELECT o_custkey AS k, o_orderkey AS source, epoch_us(o_orderdate) // 1000000 AS tm, CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS priority FROM orders)"""


def _first_sql(field: str, what: str) -> str:
    return f"(array_agg({what} ORDER BY tm, source) FILTER (WHERE nullif(trim({field}), '') IS NOT NULL))[1]"


def _sightings(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderstatus"))
    priority = F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("source"), seconds("o_orderdate").alias("at"), status.alias("status"), priority.alias("priority"))


@query(f"WITH {_SEEN} SELECT k, {_first_sql('status', 'status')} AS status, {_first_sql('priority', 'priority')} AS priority FROM seen GROUP BY k")
def golden_fields(spark, d):
    return survive.golden(_sightings(spark, d), "k", ["at", "source"], ["status", "priority"])


@query(f"WITH {_SEEN}, w AS (SELECT k, {_first_sql('status', 'source')} AS s, {_first_sql('priority', 'source')} AS p FROM seen GROUP BY k) SELECT k, 'status' AS field, s AS source FROM w WHERE s IS NOT NULL UNION ALL SELECT k, 'priority', p FROM w WHERE p IS NOT NULL")
def provenance(spark, d):
    return survive.provenance(_sightings(spark, d), "k", ["at", "source"], "source", ["status", "priority"])


@query(f"WITH {_SEEN} SELECT k, min(tm) AS first_seen, max(tm) AS last_seen FROM seen GROUP BY k")
def golden_seen_window(spark, d):
    return survive.seen_window(_sightings(spark, d), "k", "at")


@query(f"WITH {_SEEN}, f AS (SELECT k, coalesce(priority, '?') AS s, min((tm, source)) AS a FROM seen GROUP BY ALL) SELECT k, string_agg(s, ',' ORDER BY a) AS source_ids FROM f GROUP BY k")
def golden_sources(spark, d):
    s = _sightings(spark, d).withColumn("s", F.coalesce("priority", F.lit("?")))
    return survive.source_ids(s, "k", ["at", "source"], "s").select("k", F.array_join("source_ids", ",").alias("source_ids"))


@query("WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS v, ts, event_id FROM events) SELECT user_id, event_type, arg_min(v, (ts, event_id)) AS v FROM e WHERE trim(v) <> '' GROUP BY ALL")
def golden_attributes(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_id").cast("string")))
    return survive.attribute_fill(e, "user_id", ["ts", "event_id"], "event_type", "v")


@query(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'a=' || o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'a=x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'b=' || o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN 'c=' || o_custkey END) AS filled FROM orders"""
)
def fill_attributes(spark, d):
    """Attributes of two sightings, the first one's staying."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    some = lambda *pairs: F.map_filter(F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in pairs for x in p)), lambda k, v: v.isNotNull())
    base = some(("a", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))), ("b", F.when(key % 3 == 0, F.col("o_orderpriority"))))
    extra = some(("a", F.when(key % 2 == 0, F.lit("x"))), ("c", F.when(key % 2 == 0, F.col("o_custkey").cast("string"))))
    entries = F.array_sort(F.map_entries(survive.fill_map(base, extra)))
    return o.select("o_orderkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("filled"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE n_name END AS city, r_name AS country, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_name END AS venue, CAST(n_nationkey AS DOUBLE) AS lat FROM nation JOIN region ON n_regionkey = r_regionkey")
def golden_geo_fill(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None)
    base = F.struct(F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias("city"), none.cast("string").alias("country"), none.cast("string").alias("venue"), F.col("n_nationkey").cast("double").alias("lat"), none.cast("double").alias("lon"))
    extra = F.struct(F.col("r_name").alias("city"), F.col("r_name").alias("country"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("v"), "n_name")).alias("venue"), F.lit(-1.0).alias("lat"), none.cast("double").alias("lon"))
    return n.select("n_nationkey", survive.fill_geo(base, extra).alias("g")).select("n_nationkey", "g.city", "g.country", "g.venue", "g.lat")


_TRIAGE = """ev AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
ur AS (SELECT *, min(pos) OVER (PARTITION BY user_id, event_type) AS first_pos FROM ev),
fi AS (SELECT user_id, event_type, event_id AS first_id FROM ur WHERE pos = first_pos)"""


@query(
    f"""WITH {_TRIAGE} SELECT user_id AS run, CAST(event_id AS VARCHAR) AS candidate_id, CASE WHEN pos = first_pos THEN 'insert_new' ELSE 'auto_merge' END AS decision,
substring(sha256(user_id || chr(31) || first_id), 1, 22) AS canonical_id, CASE WHEN pos = first_pos THEN CASE WHEN pos = 0 THEN NULL ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE END AS similarity FROM ur JOIN fi USING (user_id, event_type)"""
)
def sequential_triage(spark, d):
    """The exact mode over all events: a user's are a run, an event's type is its url, and types have vectors at right angles.

    So the first of a type is new and the others merge by url, whatever the order within.
    """
    kinds = ("click", "error", "purchase", "signup", "view")
    e = table(spark, d, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    none = lambda kind: F.lit(None).cast(kind)
    at = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type"))
    vector = F.transform(F.sequence(F.lit(1), F.lit(len(kinds))), lambda i: (i == at).cast("double"))
    candidates = e.select(
        F.col("user_id").alias("run"), pos.alias("pos"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("url"), F.col("event_type").alias("title"), none("string").alias("description"),
        none("string").alias("city"), none("string").alias("venue"), none("timestamp").alias("starts_at"), none("string").alias("price"), vector.alias("embedding"),
    )
    candidates = staged(candidates, "triage-candidates")
    return triage.reconcile(candidates, candidates.filter("false"), "run", triage.judge_by_words(0.4)).outcomes


def _id_sql(raw: str) -> str:
    return f"substring(sha256(c || chr(31) || {raw}), 1, 22)"


#: Even events are runs of two results each, the second a copy of the first under the same url; odd events are the known records.
_RECONCILED = f"""{_matched_sql('a.event_id % 2 = 0', 'b.event_id % 2 = 1')},
ju AS (SELECT *, decision = 'auto_merge' OR (decision = 'tiebreak' AND lex >= 0.3) AS joins FROM de),
ou AS (SELECT c, 0 AS pos, id AS candidate_id, decision, similarity, CASE WHEN joins THEN oid ELSE {_id_sql('id')} END AS canonical_id, joins FROM ju
  UNION ALL SELECT c, 1, id || 'b', CASE WHEN decision = 'tiebreak' THEN decision ELSE 'auto_merge' END, CASE WHEN decision = 'tiebreak' THEN similarity ELSE 1.0::DOUBLE END,
    CASE WHEN joins THEN oid WHEN decision = 'tiebreak' THEN {_id_sql("id || 'b'")} ELSE {_id_sql('id')} END, joins FROM ju),
ta AS (SELECT c, canonical_id, bool_or(joins) AS known, string_agg(candidate_id, ',' ORDER BY pos) AS given, arg_min(candidate_id, pos) AS first FROM ou GROUP BY c, canonical_id),
go AS (SELECT ta.c, canonical_id AS id, NOT known AS is_new, CASE WHEN known THEN canonical_id || ',' || given ELSE given END AS source_ids, first, k.title AS known_title, nullif(trim(k.venue), '') AS known_venue, k.city AS known_city, k.starts_at AS known_start,
  a.title, nullif(trim(a.venue), '') AS venue, a.city, a.starts_at FROM ta JOIN x a ON a.event_id = ta.c LEFT JOIN x k ON known AND k.id = canonical_id)"""


def _reconciled(spark, d):
    r = _records(spark, d).withColumns({"url": F.concat(F.lit("http://e.example/"), "id"), "price": F.lit(None).cast("string")})
    ask = r.filter("event_id % 2 = 0").withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("run", F.col("event_id"))
    ask = staged(ask.withColumn("id", F.when(F.col("pos") == 1, F.concat("id", F.lit("b"))).otherwise(F.col("id"))).drop("event_id"), "reconcile-candidates")
    known = r.filter("event_id % 2 = 1").withColumn("source_ids", F.array("id")).drop("event_id")
    return triage.reconcile(ask, triage.near_corpus(ask, known, "run", _TIERS), "run", triage.judge_by_words(0.3), _TIERS)


@query(f"WITH {_RECONCILED} SELECT c AS run, candidate_id, decision, canonical_id, similarity FROM ou")
def reconcile_outcomes(spark, d):
    """Exact mode against a known corpus: all tiers, a judge for the ambiguous, urls seen in the run."""
    return _reconciled(spark, d).outcomes.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_RECONCILED} SELECT c AS run, id, is_new, source_ids, coalesce(known_title, title) AS title, coalesce(known_venue, venue) AS venue, coalesce(known_city, city) AS city, epoch(coalesce(known_start, starts_at))::BIGINT AS start FROM go")
def reconcile_golden(spark, d):
    g = _reconciled(spark, d).golden
    return g.select("run", "id", "is_new", F.array_join("source_ids", ",").alias("source_ids"), "title", F.nullif(ws_trim(F.col("venue")), F.lit("")).alias("venue"), "city", F.unix_seconds("starts_at").alias("start"))


@query(
    f"""WITH {_RECONCILED}, f AS (SELECT c, id, first, unnest(['title', 'description', 'venue', 'city', 'starts_at']) AS field, unnest([is_new, is_new, known_venue IS NULL AND venue IS NOT NULL, known_city IS NULL AND city IS NOT NULL, known_start IS NULL AND starts_at IS NOT NULL]) AS gave FROM go)
SELECT c AS run, id AS canonical_id, field, first AS source_id FROM f WHERE gave"""
)
def reconcile_provenance(spark, d):
    return _reconciled(spark, d).provenance


#: Links of equal urls and of merging similarity among all records, and their closure.
_BULK = f"""RECURSIVE {_matched_sql('true', 'true').split('kn AS')[0]}
kn AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(cos, 6) DESC, o) - 1 AS knn_pos FROM pr),
ul AS (SELECT event_id, 'http://e.example/' || user_id % 11 || '/' || event_id % 20 AS url FROM events WHERE event_id IN (SELECT event_id FROM x)),
li AS (SELECT c AS a, o AS b FROM kn WHERE knn_pos < 10 AND greatest(round(cos, 6), lex) >= 0.55 UNION SELECT p.event_id, q.event_id FROM ul p JOIN ul q USING (url) WHERE p.event_id <> q.event_id),
bo AS MATERIALIZED (SELECT a, b FROM li UNION SELECT b, a FROM li),
re AS (SELECT event_id AS id, event_id AS r FROM x UNION SELECT re.id, bo.b FROM re JOIN bo ON bo.a = re.r),
co AS (SELECT id, min(r) AS component FROM re GROUP BY id)"""


def _bulk(spark, d):
    """Records with numbers as ids and their components."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("http://e.example/"), (F.col("user_id") % 11).cast("string"), F.lit("/"), (F.col("event_id") % 20).cast("string")).alias("url"))
    r = _records(spark, d).drop("id").join(e, "event_id").withColumnRenamed("event_id", "id")
    r = staged(r, "bulk-records")
    return r.join(triage.bulk_reconcile(r, Thresholds(auto=0.55)), "id")


@query(f"WITH {_BULK} SELECT id, component FROM co")
def bulk_components(spark, d):
    """All records joined by urls and verified similarity, in any order."""
    return _bulk(spark, d).select("id", "component")


@query(
    f"""WITH {_BULK}, m AS (SELECT component, x.* FROM co JOIN x ON x.event_id = co.id) SELECT component, arg_min(city, event_id) FILTER (city IS NOT NULL) AS city, arg_min(venue, event_id) FILTER (trim(venue) <> '') AS venue,
epoch(arg_min(starts_at, event_id) FILTER (starts_at IS NOT NULL))::BIGINT AS start, count(*) AS sources FROM m GROUP BY component"""
)
def bulk_golden(spark, d):
    """The golden record of each component: every field's first filled value in the order of ids."""
    m = _bulk(spark, d).withColumn("start", F.unix_seconds("starts_at").cast("string"))
    fields = survive.golden(m, "component", ["id"], ["city", "venue", "start"])
    return fields.join(m.groupBy("component").agg(F.count(F.lit(1)).alias("sources")), "component").withColumn("start", F.col("start").cast("bigint"))


@query(
    f"""WITH {_BULK}, m AS (SELECT component, x.* FROM co JOIN x ON x.event_id = co.id), f AS (SELECT component, event_id, unnest(['city', 'venue']) AS field, unnest([city, nullif(trim(venue), '')]) AS v FROM m)
SELECT component, field, min(event_id) AS source FROM f WHERE v IS NOT NULL GROUP BY ALL"""
)
def bulk_provenance(spark, d):
    """Which record gave each field of its component's golden record."""
    return survive.provenance(_bulk(spark, d), "component", ["id"], "id", ["city", "venue"]).withColumnRenamed("id", "source")
