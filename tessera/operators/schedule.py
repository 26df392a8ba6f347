"""Which saved queries are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cron import next_fire_column, prev_fire_column, valid_cron


def has_cron(cron: Column) -> Column:
    return F.coalesce(F.length(cron) > 0, F.lit(False))


def scheduled(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("enabled") & has_cron(F.col("schedule_cron")))


def due(queries: DataFrame, now: Column) -> DataFrame:
    """Queries with a fire after their last run (or creation) and at or before ``now``: one row each, however many were missed."""
    since = F.coalesce("last_run_at", "created_at")
    return scheduled(queries).withColumn("fire", prev_fire_column(F.col("schedule_cron"), now)).filter(F.col("fire") > since)


def upcoming(queries: DataFrame, base: Column) -> DataFrame:
    return scheduled(queries).withColumn("next", next_fire_column(F.col("schedule_cron"), base))


def saveable(drafts: DataFrame) -> DataFrame:
    """Drafts with a blank cron made manual and ``valid`` false where a cron can't be read."""
    cron = F.nullif(F.trim("schedule_cron"), F.lit(""))
    return drafts.withColumn("schedule_cron", cron).withColumn("valid", F.col("schedule_cron").isNull() | valid_cron(F.coalesce("schedule_cron", F.lit(""))))
