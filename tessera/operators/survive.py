"""Golden records: the first filled value of each field, who gave it, when it was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import filled


def value_of(df: DataFrame, field: str) -> Column:
    """A field's value, null if it is a blank string."""
    return filled(F.col(field)) if dict(df.dtypes)[field] == "string" else F.col(field)


def golden(sightings: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """First filled value per field in order of arrival.

    One aggregation: each field's minimum over (order, value) of the rows that fill it,
    folded before the shuffle, so a record seen very often is one row per task.
    """
    at = F.struct(*order)
    aggs = [F.min_by(value_of(sightings, f), F.when(value_of(sightings, f).isNotNull(), at)).alias(f) for f in fields]
    return sightings.groupBy(key).agg(*aggs)


def provenance(sightings: DataFrame, key: str, order: list[str], source: str, fields: list[str]) -> DataFrame:
    """(key, field, source) of each field's winner; fields that nobody filled have none."""
    at = F.struct(*order)
    won = [F.min_by(F.col(source), F.when(value_of(sightings, f).isNotNull(), at)).alias(f) for f in fields]
    wide = sightings.groupBy(key).agg(*won)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("source")) for f in fields))
    return wide.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.source").filter("source IS NOT NULL")


def seen_window(sightings: DataFrame, key: str, at: str) -> DataFrame:
    return sightings.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def source_ids(sightings: DataFrame, key: str, order: list[str], source: str) -> DataFrame:
    """Distinct sources in order of their first sighting."""
    first = sightings.groupBy(key, source).agg(F.min(F.struct(*order)).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", source))), lambda x: x[source])
    return first.groupBy(key).agg(listed.alias("source_ids"))


def attribute_fill(sightings: DataFrame, key: str, order: list[str], name: str, value: str) -> DataFrame:
    """(key, name, value): the first filled value of each attribute."""
    found = sightings.withColumn("_v", filled(F.col(value))).filter("_v IS NOT NULL")
    return found.groupBy(key, name).agg(F.min_by("_v", F.struct(*order)).alias(value))


def fill_map(base: Column, extra: Column) -> Column:
    """``base`` with the keys of ``extra`` that it lacks."""
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(base, k)), base)


def fill_geo(base: Column, extra: Column) -> Column:
    """Each part from ``base``, or from ``extra`` where it is blank."""
    text = [F.coalesce(filled(base[f]), extra[f]).alias(f) for f in ("city", "country", "venue")]
    return F.struct(*text, *(F.coalesce(base[f], extra[f]).alias(f) for f in ("lat", "lon")))


def has_geo(geo: Column) -> Column:
    return F.coalesce(*(filled(geo[f]) for f in ("city", "country", "venue"))).isNotNull() | geo["lat"].isNotNull() | geo["lon"].isNotNull()
