"""Store, ledger, ranking, feedback, contract, schedule, evaluation and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import contracts
from tessera.functions.cron import valid_cron
from tessera.functions.vector import as_vector
from tessera.operators import embed, evaluate, feedback, ingest, ledger, schedule, taste
from tessera.operators.survive import has_geo
from tessera.plans.flagship import taste_scores
from tessera.ports import search
from tessera.queries.registry import query
from tessera.sources.tables import SAVED_SQL, saved_queries, seconds, table, values, values_sql
from tessera.store import bucketed
from tessera.store.tables import scratch
from tessera.streaming import ticks, twins
from tessera.vocabulary import ATTRIBUTES

_AT = "epoch_us(ts) // 1000000"


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", seconds("ts"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n = 1")
def upsert_latest(spark, d):
    return ledger.latest(_events(spark, d).select("user_id", "event_id", "event_type", "at"), ["user_id"], ["at", "event_id"]).select("user_id", "event_id", "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS n FROM (SELECT user_id, event_id, event_type FROM events)) SELECT user_id, event_id, event_type FROM r WHERE n = 1")
def bucketed_latest(spark, d):
    """Three writes to a bucketed log, compacted between the second and the third; each write has a user's last event of its batch."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    log = bucketed.BucketedLog(spark, scratch(spark, "bucketed-events"), e.schema, "user_id")
    for version in range(3):
        if version == 2:
            log.compact()
        log.append(ledger.latest(e.filter(F.col("event_id") % 3 == version), ["user_id"], ["event_id"]), version)
    return log.view().select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY user_id, event_type")
def insert_ignore_links(spark, d):
    return ledger.insert_ignore(_events(spark, d).withColumnRenamed("event_id", "seq"), ["user_id", "event_type"], "seq")


@query("SELECT user_id, event_type, min(event_id) AS seq FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) GROUP BY ALL")
def delete_cascade(spark, d):
    """Deleting a query clears its links; here some users' errors delete them."""
    gone = _events(spark, d).filter("event_type = 'error' AND value > 90").select("user_id")
    return ledger.without(insert_ignore_links(spark, d), gone, ["user_id"])


@query("SELECT seq, user_id, event_type, c_name FROM (SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY ALL) JOIN customer ON c_custkey = user_id")
def results_for_query(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return ledger.results_for(insert_ignore_links(spark, d), known, "user_id").select("seq", "user_id", "event_type", "c_name")


@query(f"SELECT user_id, event_type AS result_id, min({_AT}) AS shown_at FROM events GROUP BY ALL")
def shown_ledger(spark, d):
    return ledger.insert_ignore(_events(spark, d).select("user_id", F.col("event_type").alias("result_id"), F.col("at").alias("shown_at")), ["user_id", "result_id"], "shown_at")


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.value < 10)")
def unseen_only(spark, d):
    e = _events(spark, d)
    return ledger.unseen(e.select("user_id", "event_type").distinct(), e.filter("value < 10"), ["user_id", "event_type"])


@query("SELECT DISTINCT user_id, event_type AS result_id FROM events WHERE event_id % 2 = 0 UNION SELECT user_id, event_type FROM events WHERE value > 50")
def ledger_union(spark, d):
    """Two batches of shown results; each pair is kept once."""
    e = _events(spark, d).select("user_id", F.col("event_type").alias("result_id"), "event_id", "value", "at")
    return ledger.insert_ignore(e.filter("event_id % 2 = 0").unionByName(e.filter("value > 50")), ["user_id", "result_id"], "at").select("user_id", "result_id")


@query(f"WITH {SAVED_SQL}, r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders) SELECT o_custkey, o_orderkey, rank FROM r JOIN saved ON id = o_custkey WHERE rank < cap")
def delivery_cap(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))
    caps = saved_queries(spark, d).select(F.col("id").alias("o_custkey"), "cap")
    items = table(spark, d, "orders").select("o_orderkey")
    return ledger.delivered(o.join(caps, "o_custkey").select("o_custkey", "o_orderkey", "rank", "cap"), items, "o_orderkey", "rank", "cap").select("o_custkey", "o_orderkey", "rank")


@query(f"WITH {SAVED_SQL} SELECT id, schedule_cron FROM saved WHERE enabled AND coalesce(length(schedule_cron) > 0, false)")
def list_scheduled(spark, d):
    return schedule.scheduled(saved_queries(spark, d)).select("id", "schedule_cron")


@query(f"WITH {SAVED_SQL} SELECT id, user_id FROM saved WHERE user_id = '7'")
def owner_filter(spark, d):
    return ingest.owned(saved_queries(spark, d), F.lit("7")).select("id", "user_id")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def table_preview(spark, d):
    """What a browser of the table reads, all of it: no order says which rows a page would hold."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, n_name AS city, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE r_name END AS country, true AS has_geo FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def raw_projection(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select("c_custkey", F.col("n_name").alias("city"), F.when(F.col("c_custkey") % 4 != 0, F.col("r_name")).alias("country"), F.lit(None).cast("string").alias("venue"), F.col("c_name").alias("url"), F.lit(0).alias("rank"))
    raw = ingest.raw_results(c, "frontier_native", F.lit("run"))
    return raw.select("c_custkey", "geo.city", "geo.country", has_geo(F.col("geo")).alias("has_geo"))


@query("SELECT event_id, user_id AS c_custkey, CASE event_type WHEN 'signup' THEN 'like' ELSE 'dislike' END AS kind FROM events WHERE event_type IN ('signup', 'error') AND user_id IN (SELECT c_custkey FROM customer)")
def append_feedback(spark, d):
    kind = F.when(F.col("event_type") == "signup", "like").otherwise("dislike")
    log = _events(spark, d).filter(F.col("event_type").isin("signup", "error")).select("event_id", F.col("user_id").alias("c_custkey"), kind.alias("kind"))
    return feedback.known_only(log, table(spark, d, "customer"), "c_custkey").select("event_id", "c_custkey", "kind")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT event_id FROM events)")
def point_lookup(spark, d):
    """A batch of keys looked up at once."""
    keys = _events(spark, d).select(F.col("event_id").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(keys, "o_orderkey")


# ---------------------------------------------------------------- taste and feedback

_VEC = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_CENT = """ex AS (SELECT label, CASE WHEN label IN (0, 1) THEN 'l' WHEN label IN (2, 3) THEN 'd' END AS kind, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec),
me AS (SELECT kind, i, avg(x) AS m FROM ex WHERE kind IS NOT NULL GROUP BY ALL), ce AS (SELECT kind, list(m ORDER BY i) AS c FROM me GROUP BY kind)"""
_TASTE = f"""{_VEC}, {_CENT}, ts AS (SELECT label AS query, vec_id, round(list_cosine_similarity(v, (SELECT c FROM ce WHERE kind = 'l')) - list_cosine_similarity(v, (SELECT c FROM ce WHERE kind = 'd')), 6) AS score FROM vec),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS taste_pos FROM ts)"""
_TOP, _SLOTS = 25, 2


def _placed(spark, d):
    return taste.prefilter(taste_scores(spark, d), "query", "vec_id", _TOP)


@query(f"WITH {_TASTE} SELECT * FROM ts")
def taste_score(spark, d):
    return taste_scores(spark, d)


@query(f"WITH {_TASTE} SELECT query, vec_id, taste_pos FROM pl WHERE taste_pos < 25")
def taste_topn(spark, d):
    return _placed(spark, d).select("query", "vec_id", "taste_pos")


_SUBMITTED = [(0, '{"ranking":[{"id":3,"why":"near"},{"id":1},{"id":3,"why":"again"},{"id":99},{"id":2,"why":"  "}]}', 25), (1, '{"ranking":[{"id":5,"why":"x"}]}', 25), (2, "broken", 25), (3, '{"ranking":[{"why":"no id"}]}', 25)]
_SUBMISSION = "sb(query, place, idx, why) AS (VALUES (0, 0, 2, 'near'), (0, 1, 0, NULL), (0, 2, 1, NULL), (1, 0, 4, 'x'))"


def _submission(spark):
    return contracts.parse_ranking(values(spark, _SUBMITTED, "query int, payload string, count int"), "query", "payload", "count")


@query(f"WITH {_TASTE}, {_SUBMISSION}, j AS (SELECT pl.query, vec_id, why, row_number() OVER (PARTITION BY pl.query ORDER BY place IS NULL, place, taste_pos) - 1 AS p FROM pl LEFT JOIN sb ON sb.query = pl.query AND idx = taste_pos WHERE taste_pos < 25) SELECT query, vec_id, why, CAST(p AS INTEGER) AS rerank_pos FROM j")
def rerank_apply(spark, d):
    return taste.apply_submission(_placed(spark, d), _submission(spark), "query").select("query", "vec_id", "why", "rerank_pos")


_RANKED = f"""{_TASTE}, {_SUBMISSION}, ee AS (SELECT query, vec_id, score, taste_pos, row_number() OVER (PARTITION BY query ORDER BY abs(score), taste_pos) - 1 AS p FROM pl WHERE taste_pos >= 25),
e AS (SELECT * FROM ee WHERE p < 2), sz AS (SELECT query, least(count(*), 25) AS n FROM pl GROUP BY query), ec AS (SELECT query, count(*) AS k FROM e GROUP BY query),
hd AS (SELECT pl.query, vec_id, score, why, row_number() OVER (PARTITION BY pl.query ORDER BY place IS NULL, place, taste_pos) - 1 AS p FROM pl LEFT JOIN sb ON sb.query = pl.query AND idx = taste_pos WHERE taste_pos < 25),
al AS (SELECT hd.query, vec_id, score, why, 0 AS sec, p FROM hd JOIN sz USING (query) LEFT JOIN ec USING (query) WHERE p < greatest(n - coalesce(k, 0), 0) UNION ALL SELECT query, vec_id, score, NULL, 1, p FROM e)"""


@query(f"WITH {_RANKED} SELECT query, vec_id, score, sec = 1 AS is_exploration FROM al")
def exploration_slots(spark, d):
    return taste.ranked(taste_scores(spark, d), "query", "vec_id", _TOP, _SLOTS, _submission(spark)).select("query", "vec_id", "score", "is_exploration")


@query(f"WITH {_RANKED} SELECT query, vec_id, CAST(row_number() OVER (PARTITION BY query ORDER BY sec, p) - 1 AS INTEGER) AS rank, why AS rationale, sec = 1 AS is_exploration FROM al")
def rank_final(spark, d):
    return taste.ranked(taste_scores(spark, d), "query", "vec_id", _TOP, _SLOTS, _submission(spark)).select("query", "vec_id", "rank", "rationale", "is_exploration")


@query(f"WITH {_VEC}, x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS value, count(*) AS n FROM x GROUP BY label, i")
def centroid_batch(spark, d):
    return feedback.centroids(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "i", F.round("value", 6).alias("value"), "n")


@query(f"WITH {_VEC}, x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS value, count(*) AS n FROM x GROUP BY label, i")
def centroid_incremental(spark, d):
    folded = feedback.incremental(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return folded.select("label", "n", F.posexplode("centroid").alias("i", "value")).select("label", "i", F.round("value", 6).alias("value"), "n")


_KIND = "CASE event_type WHEN 'signup' THEN 'like' WHEN 'error' THEN 'dislike' END"


def _kinds(spark, d):
    return _events(spark, d).withColumn("kind", F.when(F.col("event_type") == "signup", "like").when(F.col("event_type") == "error", "dislike"))


@query(f"SELECT user_id, count(*) FILTER (WHERE {_KIND} = 'like') AS like_count, count(*) FILTER (WHERE {_KIND} = 'dislike') AS dislike_count, count({_KIND}) AS label_count FROM events GROUP BY user_id")
def feedback_counts(spark, d):
    return feedback.counts(_kinds(spark, d), ["user_id"], "kind")


@query(f"WITH p AS (SELECT user_id, count(*) FILTER (WHERE {_KIND} = 'like') AS l, count(*) FILTER (WHERE {_KIND} = 'dislike') AS d FROM events GROUP BY user_id) SELECT c_custkey AS user_id, coalesce(l, 0) AS like_count, coalesce(d, 0) AS dislike_count FROM customer LEFT JOIN p ON p.user_id = c_custkey")
def profile_default(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return feedback.with_profiles(q, feedback_counts(spark, d), "user_id").select("user_id", "like_count", "dislike_count")


# ---------------------------------------------------------------- contracts

def _payloads_sql(rows) -> str:
    """A reply per document: one of ``rows`` (number, text, count) in turn, with the document's source and id put in."""
    shown = values_sql([(k, *r[1:]) for k, r in enumerate(rows)])
    return f"p AS (SELECT doc_id AS id, replace(replace(payload, '[w]', source), '[i]', CAST(doc_id AS VARCHAR)) AS payload, n FROM documents JOIN ({shown}) t(k, payload, n) ON doc_id % {len(rows)} = k)"


def _payloads(spark, d, rows):
    shapes = values(spark, [(k, *r[1:]) for k, r in enumerate(rows)], "k bigint, payload string, n bigint")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", (F.col("doc_id") % len(rows)).alias("k")).join(F.broadcast(shapes), "k")
    return docs.select("id", F.replace(F.replace("payload", F.lit("[w]"), F.col("source")), F.lit("[i]"), F.col("id").cast("string")).alias("payload"), "n")


def _entries_sql(rows, field, columns, required):
    """One row per entry of the replies that are valid as a whole."""
    cols = ", ".join(f"CAST(json_extract_string(x, '$.{c}') AS {t}) AS {c}" for c, t in columns)
    bad = " OR ".join(f"{c} IS NULL" for c in required)
    return f"""{_payloads_sql(rows)}, arr AS (SELECT id, n, json_extract(payload, '$.{field}') AS a FROM p WHERE json_valid(payload)),
el AS (SELECT id, n, i AS pos, json_extract(a, '$[' || i || ']') AS x FROM arr, unnest(range(CAST(json_array_length(a) AS BIGINT))) t(i) WHERE json_type(a) = 'ARRAY'),
en AS (SELECT id, n, pos, {cols} FROM el), ok AS (SELECT * FROM en WHERE id NOT IN (SELECT id FROM en WHERE {bad}))"""


_QUERIES = [(1, '{"queries":[{"language":"German","query":"Konzerte [w]"},{"language":" ","query":"concerts [w] [i]"},{"language":"English","query":" CONCERTS [w] [i] "},{"language":"x","query":"  "}]}', 0), (2, "not json", 0), (3, '{"queries":[{"language":"French"}]}', 0), (4, '{"queries":[]}', 0), (5, '{"other":1}', 0), (6, '{"queries":[{"language":"Dutch","query":"straße [i]"},{"language":"de","query":"STRASSE [i]"}]}', 0)]


@query(f"WITH {_entries_sql(_QUERIES, 'queries', [('language', 'VARCHAR'), ('query', 'VARCHAR')], ['language', 'query'])}, t AS (SELECT id, pos, trim(language) AS l, trim(query) AS q, row_number() OVER (PARTITION BY id, replace(lower(trim(query)), 'ß', 'ss') ORDER BY pos) AS k FROM ok WHERE trim(query) <> '') SELECT id, pos, CASE WHEN l = '' THEN 'unknown' ELSE l END AS language, q AS query FROM t WHERE k = 1")
def parse_queries(spark, d):
    return contracts.parse_queries(_payloads(spark, d, _QUERIES), "id", "payload")


_CHOICES = [(1, '{"domain":"papers"}', 0), (2, '{"domain":"nothing"}', 0), (3, "{", 0), (4, '{"x":"papers"}', 0), (5, '{"domain":"travel"}', 0)]


@query(f"WITH {_payloads_sql(_CHOICES)}, c AS (SELECT id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.domain') END AS d FROM p) SELECT id, CASE WHEN d IN ({', '.join(repr(k) for k in ATTRIBUTES)}) THEN d ELSE 'events' END AS domain FROM c")
def parse_choice(spark, d):
    return _payloads(spark, d, _CHOICES).select("id", contracts.parse_choice(F.col("payload"), list(ATTRIBUTES)).alias("domain"))


_VERDICTS = [(1, '{"verdicts":[{"pair":1,"same":true},{"pair":1,"same":false},{"pair":4,"same":true},{"pair":3,"same":false},{"pair":0,"same":true}]}', 3), (2, '{"verdicts":[{"pair":1}]}', 3), (3, "?", 3), (4, '{"verdicts":[{"pair":2,"same":true},{"pair":[i],"same":false}]}', 2)]


@query(f"WITH {_entries_sql(_VERDICTS, 'verdicts', [('pair', 'BIGINT'), ('same', 'BOOLEAN')], ['pair', 'same'])}, t AS (SELECT id, pair - 1 AS pair, same, row_number() OVER (PARTITION BY id, pair ORDER BY pos) AS k FROM ok WHERE pair BETWEEN 1 AND n) SELECT id, pair, same FROM t WHERE k = 1")
def parse_verdicts(spark, d):
    return contracts.parse_verdicts(_payloads(spark, d, _VERDICTS), "id", "payload", "n")


_RANKINGS = [(1, '{"ranking":[{"id":9,"why":"a"},{"id":1,"why":" "},{"id":1,"why":"b"},{"id":0}]}', 2), (2, '{"ranking":[{"id":2,"why":"[w] [i]"},{"id":1},{"id":3,"why":" y "}]}', 3), (3, "[", 3), (4, '{"ranking":[{"why":"z"}]}', 3)]


@query(f"WITH {_entries_sql(_RANKINGS, 'ranking', [('id', 'BIGINT'), ('why', 'VARCHAR')], ['id_1']).replace('BIGINT) AS id,', 'BIGINT) AS id_1,')}, t AS (SELECT id, pos, id_1 - 1 AS idx, nullif(trim(why), '') AS why, row_number() OVER (PARTITION BY id, id_1 ORDER BY pos) AS k FROM ok WHERE id_1 BETWEEN 1 AND n) SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place, idx, why FROM t WHERE k = 1")
def parse_ranking(spark, d):
    return contracts.parse_ranking(_payloads(spark, d, _RANKINGS), "id", "payload", "n")


_ROWS = [(1, '{"results":[{"url":"u[i]","title":"[w]"},{"url":"u2"},5,{"url":"u3","title":"t3","price":"5 EUR"},{"url":"u4","title":"t4"},{"url":"u5","title":"t5"}]}', 0), (2, '{"results":"none"}', 0), (3, "{}", 0)]


@query(
    f"""WITH {_payloads_sql(_ROWS)}, arr AS (SELECT id, json_extract(payload, '$.results') AS a FROM p),
el AS (SELECT id, i, json_extract(a, '$[' || i || ']') AS x FROM arr, unnest(range(CAST(json_array_length(a) AS BIGINT))) t(i) WHERE json_type(a) = 'ARRAY'),
v AS (SELECT id, i, json_extract_string(x, '$.url') AS url, json_extract_string(x, '$.title') AS title, json_extract_string(x, '$.price') AS price FROM el),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM v WHERE url IS NOT NULL AND title IS NOT NULL) SELECT id, pos, url, title, price FROM r WHERE pos < 3"""
)
def parse_rows(spark, d):
    return contracts.parse_rows(_payloads(spark, d, _ROWS), "id", "payload", 3).select("id", "pos", "url", "title", "price")


_TURNS = [(1, '{"message":"ok [i]","ready":true,"text":" jazz [w] ","city":" ","schedule_cron":"0 9 * * *","schedule_text":"daily","max_results_shown":5}', 0), (2, '{"message":"where?","ready":false,"text":"jazz"}', 0), (3, '{"message":" ","ready":true,"text":"  "}', 0), (4, "oops", 0), (5, '{"message":"","ready":true,"text":"rock [i]"}', 0)]


@query(
    f"""WITH {_payloads_sql(_TURNS)}, j AS (SELECT id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS x FROM p),
e AS (SELECT id, trim(json_extract_string(x, '$.message')) AS m, CAST(json_extract_string(x, '$.ready') AS BOOLEAN) AS r, trim(coalesce(json_extract_string(x, '$.text'), '')) AS t, nullif(trim(coalesce(json_extract_string(x, '$.city'), '')), '') AS city, nullif(trim(coalesce(json_extract_string(x, '$.schedule_cron'), '')), '') AS cron, CAST(coalesce(json_extract_string(x, '$.max_results_shown'), '10') AS INTEGER) AS cap FROM j),
f AS (SELECT *, coalesce(m IS NOT NULL AND r AND t <> '', false) AS ready FROM e)
SELECT id, CASE WHEN m IS NOT NULL AND r IS NOT NULL AND m <> '' THEN m WHEN ready THEN 'Here''s your search:' ELSE 'Could you say that again in other words?' END AS message, CASE WHEN ready THEN t END AS text, CASE WHEN ready THEN city END AS city, CASE WHEN ready THEN cron END AS schedule_cron, CASE WHEN ready THEN cap END AS max_results_shown FROM f"""
)
def parse_turn(spark, d):
    turn = _payloads(spark, d, _TURNS).select("id", contracts.parse_turn(F.col("payload")).alias("t"))
    return turn.select("id", "t.message", "t.text", "t.city", "t.schedule_cron", "t.max_results_shown")


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'organizer=' || event_type ELSE '' END AS kept FROM events")
def attribute_vocab(spark, d):
    """Of three attributes only the one that the domain knows stays; blank values go."""
    m = F.create_map(F.lit("organizer"), F.col("event_type"), F.lit("doi"), F.lit("10.1"), F.lit("other"), F.lit("x"))
    kept = F.map_filter(ingest.narrow(m, "events"), lambda k, v: v == "signup")
    return _events(spark, d).select("event_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


@query(f"WITH {SAVED_SQL}, x(user_id, query) AS (VALUES ('7', 'sieben'), ('7', 'seven'), ('8', 'acht')) SELECT id, coalesce(query, text) AS query FROM saved LEFT JOIN x USING (user_id)")
def expand_fanout(spark, d):
    found = values(spark, [("7", "sieben"), ("7", "seven"), ("8", "acht")], "user_id string, query string")
    return ingest.expand(saved_queries(spark, d), found, "user_id").select("id", "query")


@query(f"WITH {SAVED_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'papers' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'vehicles' WHEN c_mktsegment = 'BUILDING' THEN 'real_estate' ELSE 'events' END AS domain FROM saved")
def classify_cached(spark, d):
    rule = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "vehicles").when(F.col("c_mktsegment") == "BUILDING", "real_estate").otherwise("no such domain")
    q = saved_queries(spark, d).withColumn("domain", F.when(F.col("id") % 3 == 0, "papers"))
    return ingest.classified(q, rule).select("id", "domain")


# ---------------------------------------------------------------- schedule


def _last_runs(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_ntz")).withColumns({"last_run_at": F.col("last_ntz").cast("timestamp"), "created_at": F.lit(None).cast("timestamp"), "enabled": F.lit(True)})


#: A user's schedule, by the id modulo six; the last one can't be read.
_CRONS = ("0 9 * * *", "30 6 * * 1-5", "*/15 8-18 * * mon-fri", "0 12 29 2 *", "5 0 13 * fri", "0 25 * * *")
_FIRES = """d AS (SELECT CAST(x AS TIMESTAMP) AS d FROM range(TIMESTAMP '2019-12-01', TIMESTAMP '2029-01-01', INTERVAL 1 DAY) t(x)),
fi AS (SELECT 0 AS k, d + INTERVAL 9 HOUR AS f FROM d UNION ALL SELECT 1, d + INTERVAL 390 MINUTE FROM d WHERE dayofweek(d) BETWEEN 1 AND 5
  UNION ALL SELECT 2, d + to_minutes(CAST(480 + 15 * q AS BIGINT)) FROM d, range(0, 44) t(q) WHERE dayofweek(d) BETWEEN 1 AND 5
  UNION ALL SELECT 3, d + INTERVAL 12 HOUR FROM d WHERE month(d) = 2 AND day(d) = 29 UNION ALL SELECT 4, d + INTERVAL 5 MINUTE FROM d WHERE day(d) = 13 OR dayofweek(d) = 5),
l AS (SELECT user_id, user_id % 6 AS k, max(ts) AS t FROM events GROUP BY user_id)"""


def _scheduled(spark, d):
    return _last_runs(spark, d).withColumn("schedule_cron", F.array(*map(F.lit, _CRONS))[(F.col("user_id") % 6).cast("int")])


@query(f"WITH {_FIRES}, p AS (SELECT k, max(f) AS f FROM fi WHERE f <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY k) SELECT user_id, epoch_us(f) // 1000000 AS fire FROM l JOIN p USING (k) WHERE t < f")
def due_queries(spark, d):
    """Six schedules; the clock says 2024-01-30 12:00."""
    found = schedule.due(_scheduled(spark, d), F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return found.select("user_id", F.unix_seconds("fire").alias("fire"))


@query(f"WITH {_FIRES} SELECT user_id, epoch_us(f) // 1000000 AS next FROM l ASOF JOIN fi ON l.k = fi.k AND l.t < fi.f")
def next_fire(spark, d):
    """After the last event, by six schedules; the unreadable one has none."""
    q = schedule.upcoming(_scheduled(spark, d), F.col("last_run_at")).filter("next IS NOT NULL")
    return q.select("user_id", F.unix_seconds("next").alias("next"))


_DRAFTS = [(1, "0 9 * * *"), (2, "  "), (3, None), (4, "61 * * * *"), (5, "*/15 8-18 * * mon-fri"), (6, "a b c d e"), (7, "0 0 1 1"), (8, "5 4 * * 7")]


@query(f"WITH p(k, c) AS ({values_sql(_DRAFTS)}) SELECT c_custkey AS id, nullif(trim(c), '') AS schedule_cron, k NOT IN (4, 6, 7) AS valid FROM customer JOIN p ON k = c_custkey % 8 + 1")
def save_search(spark, d):
    """Customers' drafts with eight kinds of schedule: blank ones are manual, unreadable ones invalid."""
    kinds = F.broadcast(values(spark, _DRAFTS, "k bigint, schedule_cron string"))
    drafts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8 + 1).alias("k")).join(kinds, "k")
    return schedule.saveable(drafts).select("id", "schedule_cron", "valid")


# ---------------------------------------------------------------- evaluation

_EVAL = """gd AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
rk AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
hi AS (SELECT rk.source, count(*) FILTER (WHERE r <= 10) AS h, min(r) AS f FROM rk JOIN gd USING (source, doc_id) GROUP BY rk.source),
gs AS (SELECT source, count(*) AS g FROM gd GROUP BY source),
sc AS (SELECT s.source, coalesce(h, 0) / 10.0::DOUBLE AS p, CASE WHEN g > 0 THEN coalesce(h, 0) / CAST(g AS DOUBLE) ELSE 0.0 END AS rc, CASE WHEN f IS NULL THEN 0.0 ELSE 1.0::DOUBLE / f END AS m FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN hi USING (source) LEFT JOIN gs USING (source))"""


def _rankings(spark, d):
    """Cases of the evaluation: per source the first ten documents by falling length, padded to the first good one's place, against those labelled good.

    The measures look at the ten first documents and at the first good one, so a ranking is
    listed no further; what lies between is filled with nulls' stand-ins, not with ids.
    """
    docs = table(spark, d, "documents").select("source", "doc_id", (-F.col("n_chars")).alias("key"))
    good = docs.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    top = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("key", "doc_id"))).filter("r <= 10")
    lists = top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"]).alias("predicted"))
    gold = good.groupBy("source").agg(F.collect_set("doc_id").alias("gold"), F.min(F.struct("key", "doc_id")).alias("best"))
    ahead = docs.join(gold.select("source", "best"), "source").filter(F.struct("key", "doc_id") < F.col("best")).groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("ahead"))
    rows = lists.join(gold, "source", "left").join(ahead, "source", "left")
    gap = F.array_repeat(F.lit(-1).cast("bigint"), F.greatest(F.coalesce("ahead", F.lit(0)) - 10, F.lit(0)))
    late = F.when(F.coalesce("ahead", F.lit(0)) >= 10, F.array(F.col("best.doc_id"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("source", F.concat("predicted", gap, late).alias("predicted"), F.coalesce("gold", F.array().cast("array<bigint>")).alias("gold"))


@query(f"WITH {_EVAL} SELECT source, round(p, 6) AS precision_at_10 FROM sc")
def precision_at_k(spark, d):
    return _rankings(spark, d).select("source", F.round(evaluate.precision_at(F.col("predicted"), F.col("gold"), 10), 6).alias("precision_at_10"))


@query(f"WITH {_EVAL} SELECT source, round(rc, 6) AS recall_at_10 FROM sc")
def recall_at_k(spark, d):
    return _rankings(spark, d).select("source", F.round(evaluate.recall_at(F.col("predicted"), F.col("gold"), 10), 6).alias("recall_at_10"))


@query(f"WITH {_EVAL} SELECT source, round(m, 6) AS mrr FROM sc")
def mrr(spark, d):
    return _rankings(spark, d).select("source", F.round(evaluate.reciprocal_rank(F.col("predicted"), F.col("gold")), 6).alias("mrr"))


@query(
    f"""WITH {_EVAL}, l AS (SELECT 'precision@10' AS metric, p AS v FROM sc UNION ALL SELECT 'recall@10', rc FROM sc UNION ALL SELECT 'mrr', m FROM sc)
SELECT metric, round(avg(v), 6) AS mean, count(*) AS cases FROM l GROUP BY metric"""
)
def eval_summary(spark, d):
    return evaluate.summary(evaluate.scores(_rankings(spark, d), "source", "predicted", "gold", 10)).select("metric", F.round("mean", 6).alias("mean"), "cases")


# ---------------------------------------------------------------- sources and streams


@query("SELECT 'p' || page_id % 7 AS query_id, CAST(page_id // 7 AS INTEGER) AS pos, url, 'page ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'even' END AS description FROM pages")
def web_source(spark, d):
    """A recording of seven searches, made of all pages, and played back."""
    p = F.col("page_id")
    found = table(spark, d, "pages").select(F.concat(F.lit("p"), (p % 7).cast("string")).alias("query_id"), F.floor(p / 7).cast("int").alias("pos"), "url", F.concat(F.lit("page "), p.cast("string")).alias("title"), F.when(p % 2 == 0, "even").alias("description"))
    path = scratch(spark, "recording")
    search.record(found, path)
    return search.played(spark, path)


@query("SELECT doc_id, text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) AS made, CASE WHEN text IS NOT NULL THEN 384 END AS width FROM documents")
def embed_missing(spark, d):
    """Every third document was embedded in an earlier session; of all documents only new texts are embedded now."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = embed.VectorCache(spark, scratch(spark, "vectors"))
    cache.embed(docs.filter("doc_id % 3 = 0"))
    found = cache.embed(docs).select("doc_id", "made", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))
    cache.close()
    return found


@query(
    f"""WITH {_VEC}, fb AS (SELECT user_id, event_id, {_KIND} AS kind FROM events WHERE {_KIND} IS NOT NULL AND event_id IN (SELECT vec_id FROM vec)),
ct AS (SELECT user_id, count(*) FILTER (kind = 'like') AS l, count(*) FILTER (kind = 'dislike') AS d FROM fb GROUP BY user_id),
su AS (SELECT user_id, kind, i, sum(x) AS s, count(*) AS n FROM (SELECT user_id, kind, unnest(v) AS x, unnest(range(len(v))) AS i FROM fb JOIN vec ON vec_id = event_id) GROUP BY ALL),
pr AS (SELECT vec_id AS user_id, 'like' AS kind, unnest(v) AS c, unnest(range(len(v))) AS i FROM vec WHERE vec_id % 2 = 0)
SELECT su.user_id, su.kind, CAST(i AS INTEGER) AS i, round(CASE WHEN c IS NULL THEN s / n ELSE (3 * c + s) / (3 + n) END, 6) AS value, CASE WHEN su.kind = 'like' THEN l + CASE WHEN su.user_id % 2 = 0 AND c IS NOT NULL THEN 3 ELSE 0 END ELSE d END AS fed
FROM su JOIN ct USING (user_id) LEFT JOIN pr USING (user_id, kind, i)"""
)
def profile_record(spark, d):
    """Profiles after a batch of feedback on known records; users with an even id already had three likes, their own vector."""
    vectors = table(spark, d, "embeddings").select("vec_id", as_vector(F.col("embedding")).alias("embedding"))
    items = vectors.withColumnRenamed("vec_id", "item")
    given = _kinds(spark, d).filter("kind IS NOT NULL").select(F.col("user_id").alias("who"), F.col("event_id").alias("item"), "kind")
    given = feedback.known_only(given, items, "item")
    none = F.lit(None)
    before = vectors.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("who"), none.cast("string").alias("nl_summary"), F.col("embedding").alias("liked_centroid"), none.cast("array<double>").alias("disliked_centroid"), F.lit(3).alias("like_count"), F.lit(0).alias("dislike_count"))
    after = feedback.record(before, given, items, key="who", item="item")
    sides = [after.filter(F.col(f"{c}d_centroid").isNotNull()).select(F.col("who").alias("user_id"), F.lit(c).alias("kind"), F.posexplode(f"{c}d_centroid").alias("i", "value"), F.col(f"{c}_count").alias("fed")) for c in ("like", "dislike")]
    # A side without feedback keeps what it was.
    fed = given.select(F.col("who").alias("user_id"), "kind").distinct()
    return sides[0].unionByName(sides[1]).join(fed, ["user_id", "kind"], "left_semi").withColumn("value", F.round("value", 6))


@query(f"SELECT user_id, event_type AS result_id, min({_AT}) AS shown_at FROM events GROUP BY ALL")
def stream_ledger(spark, d):
    stream = twins.table_stream(spark, d, "events").select("user_id", F.col("event_type").alias("result_id"), seconds("ts").alias("shown_at"))
    return twins.shown_ledger(spark, stream, ["user_id", "result_id"], "shown_at", scratch(spark, "stream-ledger"))


@query(f"WITH {_VEC}, x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vec) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS value, count(*) AS n FROM x GROUP BY label, i")
def stream_centroid(spark, d):
    """Each label's centroid, kept as sums in the state store."""
    found = twins.running_centroids(spark, twins.table_stream(spark, d, "embeddings"), ["label"], "embedding", scratch(spark, "stream-centroids"))
    return found.select("label", "i", F.round("value", 6).alias("value"), "n")


@query(
    f"""WITH {_FIRES}, c AS (SELECT user_id, user_id % 6 AS k, min(ts) AS since FROM events GROUP BY user_id), w AS (SELECT date_trunc('millisecond', max(ts)) AS now FROM events),
p AS (SELECT k, max(f) AS f FROM fi, w WHERE f <= now GROUP BY k) SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(f) // 1000000 AS fire, epoch_us(now) // 1000000 AS now, true AS ok FROM c JOIN p USING (k), w WHERE epoch_ms(f) > epoch_ms(since)"""
)
def stream_tick(spark, d):
    """Users as saved queries of six schedules, created with their first event; the events are the clock."""
    q = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").cast("timestamp").alias("created_at"))
    q = q.withColumns({"schedule_cron": F.array(*map(F.lit, _CRONS))[(F.col("id") % 6).cast("int")], "enabled": F.lit(True), "last_run_at": F.lit(None).cast("timestamp")})
    done = ticks.ticks(spark, twins.table_stream(spark, d, "events"), q, lambda due: due.select("id", F.lit(True).alias("ok")), scratch(spark, "stream-ticks"), "ts")
    return done.select("id", F.unix_seconds("fire").alias("fire"), F.unix_seconds("now").alias("now"), "ok")
