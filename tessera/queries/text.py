"""Text, URL and rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import render
from tessera.functions.minhash import PRIME, coefficients, estimate, signature_rows
from tessera.functions.text import WS, city_key as city_key_of, doc_text as doc_text_of, set_similarity, shingles as shingles_of, ws_trim
from tessera.functions.url import TRACKING_KEYS, bare_host, canonical_url
from tessera.queries.registry import query
from tessera.sources.tables import SAVED_SQL, saved_queries, seconds, table

_TRIM = f"'^{WS}+|{WS}+$'"
_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)
CANON_SQL = rf"""
u0 AS (SELECT page_id, regexp_replace(url, {_TRIM}, '', 'g') AS u FROM pages),
u1 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', '') AS pl,
  regexp_extract(u, '^[^:]*://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM u0),
u2 AS (SELECT *, regexp_replace(lower(regexp_extract(pl, '^([^:]*)', 1)), '^www\.', '') AS h, regexp_extract(pl, ':([0-9]+)$', 1) AS po,
  CASE WHEN length(pa) > 1 THEN regexp_replace(pa, '/+$', '') ELSE pa END AS p2,
  array_to_string(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT starts_with(lower(regexp_extract(p, '^([^=]*)', 1)), 'utm_') AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({_KEYS})), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS qq FROM u1),
canon AS (SELECT page_id, CASE WHEN s IN ('http', 'https') AND h <> '' THEN s || '://' || h || CASE WHEN po <> '' AND po <> CASE s WHEN 'http' THEN '80' ELSE '443' END THEN ':' || po ELSE '' END || p2 || CASE WHEN qq <> '' THEN '?' || qq ELSE '' END ELSE u END AS canon FROM u2)"""


@query(f"WITH {CANON_SQL} SELECT page_id, canon AS url FROM canon")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))


@query(f"WITH {CANON_SQL} SELECT canon AS url, count(*) AS n, min(page_id) AS first_page FROM canon GROUP BY canon")
def url_collisions(spark, d):
    return url_canonical(spark, d).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(r"SELECT page_id, regexp_replace(CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) <> '' THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) ELSE url END, '^www\.', '') AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", bare_host(F.col("url")).alias("host"))


@query(f"WITH {CANON_SQL} SELECT a.page_id, b.first_page FROM canon a JOIN (SELECT canon, min(page_id) AS first_page FROM canon GROUP BY canon) b USING (canon) WHERE b.first_page < a.page_id")
def url_probe(spark, d):
    """Pages whose resource an earlier page has: the earliest of each url is the index that is probed."""
    canon = url_canonical(spark, d)
    index = canon.groupBy("url").agg(F.min("page_id").alias("first_page"))
    return canon.join(index, "url").filter("first_page < page_id").select("page_id", "first_page")


@query(f"WITH t AS (SELECT doc_id, regexp_replace(coalesce(source, '') || chr(10) || coalesce(text, ''), {_TRIM}, '', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS h, CAST(length(t) AS BIGINT) AS n FROM t")
def doc_text(spark, d):
    t = doc_text_of(F.col("source"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.cast("binary")).alias("h"), F.length(t).cast("bigint").alias("n"))


@query(f"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 2 = 1 THEN '  ' || c_mktsegment || chr(160) ELSE lower(c_mktsegment) END AS c FROM customer) SELECT c_custkey, nullif(replace(lower(regexp_replace(c, {_TRIM}, '', 'g')), 'ß', 'ss'), '') AS city_key FROM c")
def city_key(spark, d):
    seg = F.col("c_mktsegment")
    city = F.when(F.col("c_custkey") % 7 == 0, "  ").when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("  "), seg, F.lit(" "))).otherwise(F.lower(seg))
    return table(spark, d, "customer").select("c_custkey", city_key_of(city).alias("city_key"))


def shingles_sql(source: str, id_col: str, text: str = "text") -> str:
    return f"""sh_w AS (SELECT {id_col}, list_filter(regexp_split_to_array(replace(lower({text}), 'ß', 'ss'), '{WS}+'), lambda x: x <> '') AS w FROM {source}),
sh AS (SELECT {id_col}, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 1), ' '))) END AS s FROM sh_w)"""


@query(f"WITH {shingles_sql('benchmark', 'item_id')} SELECT item_id, CAST(len(s) AS BIGINT) AS n FROM sh")
def shingles(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(shingles_of(F.col("text"))).cast("bigint").alias("n"))


_COEF = "coef(i, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, a, b in coefficients()) + ")"
_SIG = f"""{shingles_sql('benchmark', 'item_id')}, {_COEF},
hx AS (SELECT item_id, CAST(('0x' || substr(md5(x), 1, 15)) AS BIGINT)::HUGEINT AS x FROM (SELECT item_id, unnest(s) AS x FROM sh)),
sig AS (SELECT item_id, CAST(i AS BIGINT) AS i, CAST(min((x * a + b) % {PRIME}::HUGEINT) AS BIGINT) AS h FROM hx, coef GROUP BY item_id, i)"""


def _signatures(spark, d):
    return signature_rows(table(spark, d, "benchmark"), "item_id", shingles_of(F.col("text")))


@query(f"WITH {_SIG} SELECT item_id, i, h FROM sig")
def minhash_signature(spark, d):
    return _signatures(spark, d).select("item_id", F.posexplode("signature").alias("i", "h")).select("item_id", F.col("i").cast("bigint").alias("i"), "h")


@query(f"WITH {_SIG} SELECT a.item_id, round(sum(CASE WHEN a.h = b.h THEN 1 ELSE 0 END) / 64.0::DOUBLE, 6) AS jaccard FROM sig a JOIN sig b ON b.item_id = a.item_id + 1 AND a.i = b.i GROUP BY a.item_id")
def minhash_jaccard(spark, d):
    """Each item against the next."""
    s = _signatures(spark, d)
    other = s.select((F.col("item_id") - 1).alias("item_id"), F.col("signature").alias("next"))
    return s.join(other, "item_id").select("item_id", F.round(estimate(F.col("signature"), F.col("next")), 6).alias("jaccard"))


_JACC = "CASE WHEN len(list_distinct(list_concat(a.s, b.s))) > 0 THEN round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) ELSE 0.0 END"


@query(f"WITH c AS (SELECT conv_id, turn, text, conv_id * 1000000 + turn AS k FROM conversations), {shingles_sql('c', 'k')} SELECT a.k, {_JACC} AS jaccard FROM sh a JOIN sh b ON b.k = a.k + 1")
def exact_jaccard(spark, d):
    """Each turn of a conversation against the one before."""
    s = table(spark, d, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("k"), shingles_of(F.col("text")).alias("s"))
    other = s.select((F.col("k") - 1).alias("k"), F.col("s").alias("next"))
    return s.join(other, "k").select("k", F.round(set_similarity(F.col("s"), F.col("next")), 6).alias("jaccard"))


def _when_sql(c: str) -> str:
    return f"strftime({c}, '%-d %b %Y, %H:%M')"


@query(
    f"""WITH e AS (SELECT event_id, ts AS a, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 50 HOUR END AS b FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN b IS NULL THEN {_when_sql('a')} WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN {_when_sql('a')} || '-' || strftime(b, '%H:%M') ELSE {_when_sql('a')} || ' - ' || {_when_sql('b')} END AS w FROM e"""
)
def format_when(spark, d):
    end = F.when(F.col("event_id") % 3 == 1, F.expr("ts + INTERVAL 2 HOURS")).when(F.col("event_id") % 3 == 2, F.expr("ts + INTERVAL 50 HOURS"))
    start = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    return table(spark, d, "events").select("event_id", render.format_when(start, end).alias("w"))


@query("SELECT event_id, 'Event Type: ' || event_type || ', User Id: ' || CAST(user_id AS VARCHAR) AS facts FROM events")
def format_facts(spark, d):
    m = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("a_note"), F.lit("  "))
    return table(spark, d, "events").select("event_id", render.format_facts(m).alias("facts"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS h FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(render.escape_html(F.col("html")).cast("binary")).alias("h"))


@query(f"WITH {SAVED_SQL} SELECT id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'weekdays &amp; early' WHEN coalesce(schedule_cron, '') <> '' THEN '<code>' || schedule_cron || '</code>' ELSE 'manual (run on demand)' END AS line FROM saved")
def schedule_line(spark, d):
    said = F.when(F.col("c_mktsegment") == "MACHINERY", "weekdays & early")
    return saved_queries(spark, d).select("id", render.schedule_line(said, F.col("schedule_cron")).alias("line"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_prompt(spark, d):
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(said, lambda x: x["line"]), "\n").cast("binary")).alias("prompt"), F.count(F.lit(1)).alias("turns"))


_TEMPLATE = "Find up to {max_results} results for: {query}"


@query(f"SELECT item_id, md5('Find up to 20 results for: ' || regexp_replace('  ' || text || chr(10), {_TRIM}, '', 'g')) AS prompt FROM benchmark")
def prompt_template(spark, d):
    text = ws_trim(F.concat(F.lit("  "), "text", F.lit("\n")))
    return table(spark, d, "benchmark").select("item_id", F.md5(render.fill_template(_TEMPLATE, text, 20).cast("binary")).alias("prompt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000000 AS at FROM events")
def props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), seconds("ts").alias("at"))
