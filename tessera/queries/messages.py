"""Messages and prompts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts, render
from tessera.queries.registry import query
from tessera.sources.tables import SAVED_SQL, saved_queries, table
from tessera.vocabulary import ATTRIBUTES

_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), '''', '&#x27;')"


@query(
    f"""SELECT o_orderkey, '<a href="' || {_HTML.format("'http://x/?a=1&o=' || o_orderkey")} || '"><b>' || {_HTML.format("'R&D <' || o_orderstatus || '>'")} || '</b></a>' || chr(10) || strftime(o_orderdate, '%-d %b %Y, %H:%M')
|| CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || {_HTML.format("'<' || o_totalprice::DECIMAL(15,2) || '>'")} END || chr(10) || 'Organizer: ' || {_HTML.format('o_orderpriority')} || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '<i>' || {_HTML.format("'it''s ' || o_orderstatus")} || '</i>' ELSE '' END AS message FROM orders"""
)
def render_messages(spark, d):
    """Orders as results in a chat: escaped, blank parts left out."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    price = F.when(key % 3 != 0, F.concat(F.lit("<"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit(">")))
    facts = F.create_map(F.lit("organizer"), F.col("o_orderpriority"), F.lit("tags"), F.lit(" "))
    why = F.when(key % 2 == 0, F.concat(F.lit("it's "), F.col("o_orderstatus")))
    none = F.lit(None).cast("timestamp")
    return o.select("o_orderkey", render.render_result(F.concat(F.lit("R&D <"), F.col("o_orderstatus"), F.lit(">")), F.concat(F.lit("http://x/?a=1&o="), key.cast("string")), F.col("o_orderdate").cast("timestamp"), none, price, facts, why).alias("message"))


@query(
    f"""WITH {SAVED_SQL} SELECT id, '<b>' || {_HTML.format('text')} || '</b>' || CASE WHEN trim(user_id) <> '' AND id % 2 = 0 THEN ' (' || user_id || ')' ELSE '' END || chr(10)
|| CASE WHEN coalesce(schedule_cron, '') <> '' THEN '<code>' || schedule_cron || '</code>' ELSE 'manual (run on demand)' END || CASE WHEN enabled THEN '' ELSE chr(10) || 'paused' END AS listed,
'<b>Search</b>: ' || {_HTML.format('text')} || chr(10) || '<b>When</b>: ' || CASE WHEN id % 4 = 0 THEN 'every &lt;day&gt;' WHEN coalesce(schedule_cron, '') <> '' THEN '<code>' || schedule_cron || '</code>' ELSE 'manual (run on demand)' END || chr(10) || '<b>Results</b>: ' || cap AS draft FROM saved"""
)
def render_searches(spark, d):
    """Saved searches as they are listed, and as drafts."""
    q, nothing = saved_queries(spark, d), F.lit(None).cast("string")
    city = F.when(F.col("id") % 2 == 0, F.col("user_id"))
    said = F.when(F.col("id") % 4 == 0, "every <day>")
    return q.select("id", render.render_saved_query(F.col("text"), city, nothing, F.col("schedule_cron"), F.col("enabled")).alias("listed"), render.render_draft(F.col("text"), F.lit(" "), said, F.col("schedule_cron"), F.col("cap")).alias("draft"))


@query(
    f"""WITH {SAVED_SQL} SELECT id, 'Write at most 3 web search queries for the request below, in the languages German, Dutch. Answer by calling submit_queries.' || chr(10) || 'Request: ' || text || chr(10) || 'Place: ' || CASE WHEN id % 2 = 0 THEN user_id ELSE 'anywhere' END AS expand,
'Name the domain of the request by calling submit_domain: one of {", ".join(ATTRIBUTES)}.' || chr(10) || 'Request: ' || text AS classify FROM saved"""
)
def stage_prompts(spark, d):
    """What the expanding and the classifying stage ask for each saved query."""
    city = F.when(F.col("id") % 2 == 0, F.col("user_id"))
    return saved_queries(spark, d).select("id", prompts.expand_prompt(F.col("text"), city, ["German", "Dutch"], 3).alias("expand"), prompts.classify_prompt(F.col("text")).alias("classify"))


@query(
    """WITH t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said, string_agg(CASE WHEN role = 'user' THEN text END, '|' ORDER BY turn) AS u FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
l AS (SELECT conv_id, string_agg(k || '. ' || text, chr(10) ORDER BY k) FILTER (role = 'user') AS liked, string_agg(k || '. ' || text, chr(10) ORDER BY k) FILTER (role = 'system') AS disliked FROM n GROUP BY conv_id)
SELECT conv_id, 'Help the user to describe a recurring search: its text, a city, when to run it and how many results to show. Answer by calling submit_draft; set ready once the text is clear.' || chr(10) || said AS builder,
'Sum up in a few sentences what this reader likes and dislikes. Answer with the summary alone.' || chr(10) || 'So far: nothing' || chr(10) || 'Liked:' || chr(10) || coalesce(liked, 'none') || chr(10) || 'Disliked:' || chr(10) || coalesce(disliked, 'none') AS summary FROM t JOIN l USING (conv_id)"""
)
def dialogue_prompts(spark, d):
    """Whole conversations as the turns of a draft, and what users and systems say as likes and dislikes."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    texts = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    return c.select("conv_id", prompts.builder_prompt(F.col("turns")).alias("builder"), prompts.summary_prompt(F.lit(None).cast("string"), texts("user"), texts("system")).alias("summary"))
