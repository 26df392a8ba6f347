"""Search engines: a narrow port, an offline source, and the engines that are only named."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.vocabulary import SEARCH_ENGINES


class WebSearch(Protocol):
    def find(self, query: str, *, max_results: int, location: dict | None, domain: str | None) -> list[dict]: ...


class AdapterMissing(RuntimeError):
    """An adapter that is named but not installed or configured."""


def tool_options(context_size: str, allowed_domains: Sequence[str] = (), location: dict | None = None) -> dict:
    """The options of a search call: the size always, the rest only where there is something to say."""
    options: dict = {"search_context_size": context_size}
    if allowed_domains:
        options["filters"] = {"allowed_domains": list(allowed_domains)}
    if known := {k: v for k, v in (location or {}).items() if v}:
        options["user_location"] = {"type": "approximate", **known}
    return options


def first_call(reply: Sequence[dict], name: str) -> str | None:
    """The arguments of the first call of that name in a reply."""
    return next((item["arguments"] for item in reply if item.get("type") == "function_call" and item.get("name") == name), None)


def engine(kind: str, backend: WebSearch | None = None) -> WebSearch:
    if kind not in SEARCH_ENGINES:
        raise ValueError(f"unknown engine {kind}")
    if kind != "frontier_native":
        raise NotImplementedError(f"engine {kind} is named only")
    if backend is None:
        raise AdapterMissing("frontier_native needs a backend")
    return backend


class _Part(InputPartition):
    def __init__(self, query_id: str, rows: str):
        super().__init__(query_id)
        self.query_id, self.rows = query_id, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.found = json.loads(options["results"])

    def partitions(self) -> list[InputPartition]:
        return [_Part(q, json.dumps(rows)) for q, rows in sorted(self.found.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for pos, r in enumerate(json.loads(partition.rows)):
            yield partition.query_id, pos, r.get("url"), r.get("title"), r.get("description")


class OfflineWebSource(DataSource):
    """Recorded search results: option ``results`` is JSON, query id -> list of rows.  A partition per query."""

    @classmethod
    def name(cls) -> str:
        return "offline_web"

    def schema(self) -> str:
        return "query_id string, pos int, url string, title string, description string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_recorded(spark: SparkSession, results: dict[str, list[dict]]) -> DataFrame:
    spark.dataSource.register(OfflineWebSource)
    return spark.read.format("offline_web").option("results", json.dumps(results)).load()


# ---------------------------------------------------------------- a recording of any size

RECORDED = ("query_id", "pos", "url", "title", "description")


def record(results: DataFrame, path: str) -> None:
    """Keep search results (query_id, pos, url, title, description) for playing back.

    Rows lie in ranges of the query id, so a file's statistics tell which queries it has; a
    query of very many results spans several files.
    """
    results.select(*RECORDED).repartitionByRange("query_id", "pos").sortWithinPartitions("query_id", "pos").write.mode("overwrite").parquet(path)


def played(spark: SparkSession, path: str, queries: Sequence[str] | None = None) -> DataFrame:
    """Recorded results, of some queries or of all; the query ids go down to the scan and choose its files and row groups."""
    rows = spark.read.parquet(path).select(*RECORDED)
    return rows if queries is None else rows.filter(F.col("query_id").isin(list(queries)))
