"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """A zoneless instant as seconds since 1970, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple]) -> str:
    """The same rows as a VALUES list."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def saved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as saved queries: owner, schedule, cap and cached domain from their columns."""
    c = table(spark, sf_dir, "customer")
    cron = F.when(F.col("c_mktsegment") == "BUILDING", "0 9 * * *").when(F.col("c_mktsegment") == "MACHINERY", "30 6 * * 1-5").when(F.col("c_mktsegment") == "HOUSEHOLD", "")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("user_id"), F.col("c_name").alias("text"), "c_mktsegment", (F.col("c_acctbal") > 0).alias("enabled"), cron.alias("schedule_cron"), (F.col("c_nationkey") % 5).alias("cap"))


SAVED_SQL = """saved AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS user_id, c_name AS text, c_mktsegment, c_acctbal > 0 AS enabled,
  CASE c_mktsegment WHEN 'BUILDING' THEN '0 9 * * *' WHEN 'MACHINERY' THEN '30 6 * * 1-5' WHEN 'HOUSEHOLD' THEN '' END AS schedule_cron, c_nationkey % 5 AS cap FROM customer)"""
