"""Structured replies of language models: JSON text to rows, conservatively.

A reply that doesn't validate as a whole yields nothing, except search rows, which are
judged one by one.  ``from_json`` turns malformed text into a struct of nulls and a wrong
element into null inside its array, so validity is computed, not assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import casefold, ws_trim
from tessera.vocabulary import FALLBACK_DOMAIN

FALLBACK_MESSAGE = "Could you say that again in other words?"
EXTRACTED_ROW = "url string, title string, description string, starts_at string, ends_at string, city string, country string, venue string, image_url string, attributes map<string,string>, price string"
READY_MESSAGE = "Here's your search:"


def _entries(df: DataFrame, payload: str, field: str, schema: str, required: Sequence[str]) -> DataFrame:
    """One row per entry (``pos``, ``e``) of the replies that are valid as a whole."""
    parsed = F.from_json(F.col(payload), f"{field} array<struct<{schema}>>")[field]
    wrong = F.exists(parsed, lambda e: e.isNull() | F.greatest(*(e[r].isNull() for r in required), F.lit(False)))
    return df.withColumn("_list", parsed).filter(F.col("_list").isNotNull() & ~wrong).select("*", F.posexplode("_list").alias("pos", "e")).drop("_list")


def _first_per(df: DataFrame, keys: Sequence[str | Column], pos: str = "pos") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).filter("_n = 1").drop("_n")


def parse_queries(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, pos, language, query): blanks dropped, queries that differ only in case once, unnamed languages 'unknown'."""
    rows = _entries(df, payload, "queries", "language string, query string", ("language", "query"))
    rows = rows.select(id_col, "pos", ws_trim(F.col("e.language")).alias("language"), ws_trim(F.col("e.query")).alias("query")).filter("query <> ''")
    rows = _first_per(rows.withColumn("key", casefold(F.col("query"))), [id_col, "key"])
    return rows.select(id_col, F.col("pos").cast("bigint").alias("pos"), F.when(F.col("language") == "", "unknown").otherwise(F.col("language")).alias("language"), "query")


def parse_choice(payload: Column, allowed: Sequence[str], fallback: str = FALLBACK_DOMAIN) -> Column:
    domain = F.from_json(payload, "domain string")["domain"]
    return F.when(domain.isin(*allowed), domain).otherwise(F.lit(fallback))


def parse_verdicts(df: DataFrame, id_col: str, payload: str, count: str) -> DataFrame:
    """(id, pair, same) with 0-based pairs: out-of-range and repeated numbers are dropped, so is a whole bad reply."""
    rows = _entries(df, payload, "verdicts", "pair bigint, same boolean", ("pair", "same"))
    rows = rows.select(id_col, "pos", (F.col("e.pair") - 1).alias("pair"), F.col("e.same").alias("same"), F.col(count).alias("_count"))
    return _first_per(rows.filter("pair >= 0 AND pair < _count"), [id_col, "pair"]).select(id_col, "pair", "same")


def parse_ranking(df: DataFrame, id_col: str, payload: str, count: str) -> DataFrame:
    """(id, place, idx, why): the order in which valid, unrepeated entries come; idx is 0-based, a blank why null."""
    rows = _entries(df, payload, "ranking", "id bigint, why string", ("id",))
    rows = rows.select(id_col, "pos", (F.col("e.id") - 1).alias("idx"), F.nullif(ws_trim(F.col("e.why")), F.lit("")).alias("why"), F.col(count).alias("_count"))
    rows = _first_per(rows.filter("idx >= 0 AND idx < _count"), [id_col, "idx"])
    return rows.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("pos")) - 1).cast("bigint").alias("place"), "idx", "why")


def parse_rows(df: DataFrame, id_col: str, payload: str, max_results: int, strict: bool = True) -> DataFrame:
    """(id, pos, url, title, description, starts_at, ends_at, city, country, venue, image_url, attributes, price): valid rows of a search reply, the first ``max_results``.

    Malformed text raises if ``strict``.  A reply without the array has no rows.  Rows are
    judged one by one: one without url or title, or whose instants can't be read, is
    skipped.
    """
    text = F.col(payload)
    broken = F.try_parse_json(text).isNull() & text.isNotNull()
    checked = F.when(broken, F.raise_error(F.lit("malformed search reply")).cast("string")).otherwise(text) if strict else F.when(~broken, text)
    rows = df.withColumn("_list", F.from_json(checked, "results array<string>")["results"]).select(id_col, F.posexplode("_list").alias("pos", "row"))
    rows = rows.withColumn("e", F.from_json("row", EXTRACTED_ROW)).filter("e.url IS NOT NULL AND e.title IS NOT NULL")
    for c in ("starts_at", "ends_at"):
        rows = rows.withColumn(c, F.try_to_timestamp(F.col(f"e.{c}"))).filter(F.col(f"e.{c}").isNull() | F.col(c).isNotNull())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).filter(F.col("n") <= max_results)
    plain = lambda *names: [F.col(f"e.{c}").alias(c) for c in names]
    attributes = F.coalesce(F.col("e.attributes"), F.create_map().cast("map<string,string>")).alias("attributes")
    return rows.select(id_col, (F.col("n") - 1).cast("bigint").alias("pos"), *plain("url", "title"), F.coalesce("e.description", F.lit("")).alias("description"), "starts_at", "ends_at", *plain("city", "country", "venue", "image_url"), attributes, *plain("price"))


def parse_turn(payload: Column) -> Column:
    """struct(message, text, city, schedule_cron, schedule_text, max_results_shown); text is null unless a draft is ready."""
    e = F.from_json(payload, "message string, ready boolean, text string, city string, schedule_cron string, schedule_text string, max_results_shown int")
    valid = e["message"].isNotNull() & e["ready"].isNotNull()
    text = ws_trim(F.coalesce(e["text"], F.lit("")))
    ready = valid & e["ready"] & (text != "")
    said = ws_trim(e["message"])
    optional = lambda name: F.when(ready, F.nullif(ws_trim(F.coalesce(e[name], F.lit(""))), F.lit(""))).alias(name)
    message = F.when(valid & (said != ""), said).when(ready, F.lit(READY_MESSAGE)).otherwise(F.lit(FALLBACK_MESSAGE))
    return F.struct(message.alias("message"), F.when(ready, text).alias("text"), optional("city"), optional("schedule_cron"), optional("schedule_text"), F.when(ready, F.coalesce(e["max_results_shown"], F.lit(10))).alias("max_results_shown"))
