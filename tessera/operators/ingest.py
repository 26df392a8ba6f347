"""From search rows to raw results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.vocabulary import ATTRIBUTES, FALLBACK_DOMAIN, keys_of


def raw_results(extracted: DataFrame, engine: str, run_id: Column) -> DataFrame:
    """Nest the place and give each row an id that a second evaluation gives again."""
    geo = F.struct("city", "country", "venue", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    key = F.sha2(F.concat_ws("|", run_id.cast("string"), F.col("url"), F.col("rank").cast("string")), 256)
    return extracted.withColumn("geo", geo).withColumn("id", F.substring(key, 1, 22)).withColumn("source_engine", F.lit(engine)).drop("city", "country", "venue")


def narrow(attributes: Column, domain: str | None) -> Column:
    """Only the attributes that the domain knows."""
    keys = keys_of(domain)
    return F.map_filter(attributes, lambda k, v: k.isin(*keys)) if keys else F.map_filter(attributes, lambda k, v: F.lit(False))


def catalogue(spark) -> DataFrame:
    """(domain, key): a table of fixed size."""
    return spark.createDataFrame([(d, k) for d, keys in ATTRIBUTES.items() for k in keys], "domain string, key string")


def classified(queries: DataFrame, rule: Column) -> DataFrame:
    """A query's cached domain, or what the classifier says, or the fallback."""
    return queries.withColumn("domain", F.coalesce(F.col("domain"), F.when(rule.isin(*ATTRIBUTES), rule), F.lit(FALLBACK_DOMAIN)))


def expand(queries: DataFrame, translations: DataFrame, key: str) -> DataFrame:
    """One row per translation; a query without any stays as it is."""
    return queries.join(translations, key, "left").withColumn("query", F.coalesce("query", "text"))


def owned(rows: DataFrame, user: Column) -> DataFrame:
    return rows.filter(F.col("user_id") == user)
