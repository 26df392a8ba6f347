"""An append-only store: every write is a new version, views show the latest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions.text import city_key
from tessera.operators.block import blocked_knn
from tessera.operators.feedback import refuse_unknown
from tessera.operators.ingest import owned
from tessera.operators.ledger import insert_ignore, latest, results_for, without
from tessera.operators.schedule import scheduled
from tessera.schema import TABLES

KEYS = {"users": ["id"], "saved_queries": ["id"], "raw_results": ["id"], "canonical": ["id"], "provenance": ["canonical_id"], "feedback": ["id"], "preferences": ["saved_query_id"]}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A working folder that is deleted when the application's JVM ends."""
    path = work_dir(spark, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what made it isn't run again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _as(rows: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a table; those that ``rows`` lacks are null."""
    has = {f.name: f.dataType.simpleString() for f in rows.schema}

    def column(f: StructField) -> Column:
        if has.get(f.name) == f.dataType.simpleString():
            return F.col(f.name)
        return (F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name)

    return rows.select(*map(column, schema))


class Store:
    """Logs under one folder.  A write appends; it never touches what is being read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.open = spark, folder.rstrip("/"), True

    def _log(self, table: str) -> str:
        if not self.open:
            raise RuntimeError("the store is closed")
        return f"{self.folder}/{table}"

    def _path(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def append(self, table: str, rows: DataFrame, version: int, once: str | None = None) -> None:
        """Add rows.  Under the same ``once`` they replace what was written before, be it whole or in part.

        Each write has a folder of its own, so several may go on at a time.
        """
        own = f"once-{once}" if once else f"write-{uuid.uuid4().hex}"
        rows.withColumn("_version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{self._log(table)}/{own}")

    def append_as(self, table: str, rows: DataFrame, version: int, once: str | None = None) -> None:
        """Add rows as a table has them: its columns, those that are missing null."""
        self.append(table, _as(rows, TABLES[table]), version, once)

    def log(self, table: str) -> DataFrame:
        path = self._log(table)
        fs, hadoop = self._path(path)
        schema = StructType([*TABLES[table].fields, StructField("_version", LongType())])
        if not fs.exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def stream_base(self, name: str) -> int:
        """The version after which a stream's batches are numbered, kept from its first start on."""
        path = f"{self.folder}/_streams/{name}/base"
        fs, hadoop = self._path(path)
        if not fs.exists(hadoop):
            last = self.log("canonical").agg(F.max("_version")).first()[0] or 0
            self.spark.createDataFrame([(last,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).first()[0]

    def committed(self, name: str, epoch: int) -> bool:
        fs, hadoop = self._path(f"{self.folder}/_streams/{name}/commits/{epoch}")
        return fs.exists(hadoop)

    def commit(self, name: str, epoch: int) -> None:
        fs, hadoop = self._path(f"{self.folder}/_streams/{name}/commits/{epoch}")
        fs.create(hadoop, True).close()

    def view(self, table: str, below: int | None = None) -> DataFrame:
        """The latest version of each key (of those ``below`` one); a feedback log keeps everything, provenance each field's first winner."""
        log = self.log(table) if below is None else self.log(table).filter(F.col("_version") < below)
        if table == "feedback":
            return log.drop("_version")
        if table == "provenance":
            won = log.select("canonical_id", "_version", F.explode("winners").alias("field", "source_id"))
            won = won.groupBy("canonical_id", "field").agg(F.min_by("source_id", F.struct("_version", "source_id")).alias("source_id"))
            return won.groupBy("canonical_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source_id")))).alias("winners"))
        return latest(log, KEYS[table], ["_version"]).drop("_version")

    def get(self, table: str, key: str) -> DataFrame:
        return self.view(table).filter(F.col(KEYS[table][0]) == key)

    def upsert_canonical(self, rows: DataFrame, provenance: DataFrame, version: int, once: str | None = None) -> None:
        """Golden records (flat, as triage gives them) with the derived city key and start second, and which source gave each field."""
        geo = F.struct(*(F.col(c) for c in ("city", "country", "venue", "lat", "lon"))).alias("geo")
        flat = rows.withColumns({"geo": geo, "source_search_result_ids": F.col("source_ids"), "city_key": city_key(F.col("city")), "starts_epoch": F.unix_seconds("starts_at")})
        self.append("canonical", _as(flat, TABLES["canonical"]), version, once)
        winners = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source_id")))).alias("winners")
        given = provenance.groupBy("canonical_id", "field").agg(F.min("source_id").alias("source_id"))
        self.append("provenance", _as(given.groupBy("canonical_id").agg(winners), TABLES["provenance"]), version, once)

    def upsert_preferences(self, rows: DataFrame, version: int) -> None:
        self.append("preferences", _as(rows, TABLES["preferences"]), version)

    def add_feedback(self, rows: DataFrame, version: int) -> None:
        """Append feedback; an unknown record raises before anything is written."""
        known = self.view("canonical").select(F.col("id").alias("canonical_search_result_id"))
        refuse_unknown(rows, known, "canonical_search_result_id")
        self.append("feedback", _as(rows, TABLES["feedback"]), version)

    def location_of(self, users: DataFrame, key: str = "user_id") -> DataFrame:
        """Users with their city and country; blank where they are unknown or have said nothing."""
        told = self.view("users").select(F.col("id").alias(key), F.col("location.city").alias("city"), F.col("location.country").alias("country"))
        return users.join(told, key, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("city", "country")})

    def link(self, rows: DataFrame, version: int) -> None:
        self.append("query_results", rows.select("seq", "query_id", "canonical_id"), version)

    def links(self) -> DataFrame:
        """Links of queries that weren't deleted after they were linked, each at its first place."""
        log = self.log("query_results")
        gone = self.log("deleted_queries").groupBy(F.col("id").alias("query_id")).agg(F.max("_version").alias("_gone"))
        kept = log.join(gone, "query_id", "left").filter(F.coalesce(F.col("_gone") < F.col("_version"), F.lit(True)))
        return insert_ignore(kept, ["query_id", "canonical_id"], "seq")

    def mark_shown(self, rows: DataFrame, version: int) -> None:
        self.append("shown_ledger", rows.select("user_id", "result_id", "shown_at"), version)

    def shown(self) -> DataFrame:
        return insert_ignore(self.log("shown_ledger"), ["user_id", "result_id"], "shown_at")

    def saved_queries(self, tombstones: DataFrame | None = None) -> DataFrame:
        """Saved queries that weren't deleted after they were last written."""
        rows = latest(self.log("saved_queries"), ["id"], ["_version"])
        gone = self.log("deleted_queries").groupBy("id").agg(F.max("_version").alias("_gone"))
        rows = rows.join(gone, "id", "left").filter(F.coalesce(F.col("_gone") < F.col("_version"), F.lit(True))).drop("_gone", "_version")
        return without(rows, tombstones, ["id"]) if tombstones is not None else rows

    def delete_queries(self, ids: DataFrame, version: int) -> None:
        """Forget saved queries and what they are linked to; what users were shown stays known."""
        self.append_as("deleted_queries", ids.select("id"), version)

    def owned_queries(self, user: str) -> DataFrame:
        return owned(self.saved_queries(), F.lit(user))

    def scheduled_queries(self) -> DataFrame:
        return scheduled(self.saved_queries())

    def results_of(self, query_id: str) -> DataFrame:
        """Records that a query is linked to, with ``seq``, the order in which they were."""
        mine = self.links().filter(F.col("query_id") == query_id).select(F.col("canonical_id").alias("id"), "seq")
        return results_for(mine, self.view("canonical"), "id")

    def shown_to(self, user: str) -> DataFrame:
        return self.shown().filter(F.col("user_id") == user).select("result_id")

    def feedback_on(self, query_id: str) -> DataFrame:
        return self.view("feedback").filter(F.col("saved_query_id") == query_id)

    def nearest(self, asked: DataFrame, days: int = 1, limit: int = 10) -> DataFrame:
        """(q_id, id, similarity, knn_pos): the stored records most like each row of ``asked`` (id, city, starts_at, embedding) in its block."""
        at = (F.unix_micros(F.col("starts_at").cast("timestamp")) / 1e6).alias("at")
        block = (F.nullif(city_key(F.col("city")), F.lit("")).alias("city"), at, F.col("embedding").alias("v"))
        known = self.view("canonical").filter("embedding IS NOT NULL").withColumn("city", F.col("geo.city")).select("id", *block)
        return blocked_knn(asked.select("id", *block, F.lit(limit).alias("k")), known, days, but_itself=False)

    def compact(self, table: str, to: str) -> Store:
        """Write the latest versions to a new folder; the old one stays readable."""
        other = Store(self.spark, to)
        other.append(table, self.view(table), 0)
        return other

    def close(self) -> None:
        self.open = False


class MemoryStore:
    """The same views over DataFrames held by name, for tests."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {k: spark.createDataFrame([], v) for k, v in TABLES.items()}

    def put(self, table: str, rows: DataFrame) -> None:
        self.tables[table] = rows
        rows.createOrReplaceTempView(table)

    def view(self, table: str) -> DataFrame:
        return self.tables[table]


def preview(df: DataFrame, limit: int = 500) -> DataFrame:
    """The first rows of a table, for looking at."""
    return df.limit(limit)


def tables_of(store: Store) -> DataFrame:
    """(table, versions, rows): what a store holds, for looking at; tables that were never written aren't listed."""
    fs, folder = store._path(store.folder)
    there = [t for t in TABLES if fs.exists(store._path(f"{store.folder}/{t}")[1])]
    out = store.spark.createDataFrame([], "table string, versions bigint, rows bigint")
    for t in there:
        out = out.unionByName(store.log(t).agg(F.lit(t).alias("table"), F.count_distinct("_version").alias("versions"), F.count(F.lit(1)).alias("rows")).select("table", "versions", "rows"))
    return out
