"""A versioned log bucketed by key: the latest version of each key, and joins on it, need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.ledger import latest


class BucketedLog:
    """Rows of a schema with ``_version``, in generations; each is a table bucketed and sorted by its key.

    A write appends one sorted file per bucket to the newest generation.  ``compact`` writes
    the latest versions as a new generation and only then names it the newest, so a reader
    that began before goes on with the files it has, and one that dies leaves nothing that
    is read.  Old generations stay until ``vacuum``.  One writer at a time.

    The number of buckets is kept in each generation's name, since files written for one
    number can't be read for another; ``compact`` may change it as the log grows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = 16):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = StructType([*schema.fields, StructField("_version", LongType())])
        self.tables: dict[str, str] = {}
        if not self._generations():
            self._name(0, buckets)

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of all that have been named, oldest first."""
        fs, hadoop = self._fs(f"{self.folder}/_named-*")
        return sorted(tuple(map(int, s.getPath().getName().split("-")[1:])) for s in fs.globStatus(hadoop) or [])

    def _name(self, number: int, buckets: int) -> None:
        fs, hadoop = self._fs(f"{self.folder}/_named-{number}-{buckets}")
        fs.create(hadoop, True).close()

    def _table(self, number: int, buckets: int) -> str:
        place = f"{self.folder}/generation-{number}"
        if place not in self.tables:
            name = f"log_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
            self.tables[place] = name
        return self.tables[place]

    def append(self, rows: DataFrame, version: int) -> None:
        table = self._table(*self._generations()[-1])
        full = rows.withColumn("_version", F.lit(version).cast("bigint"))
        full.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def log(self) -> DataFrame:
        table = self._table(*self._generations()[-1])
        self.spark.catalog.refreshTable(table)
        return self.spark.table(table)

    def view(self) -> DataFrame:
        """The latest version of each key."""
        return latest(self.log(), [self.key], ["_version"]).drop("_version")

    def compact(self, buckets: int | None = None) -> None:
        number, now = self._generations()[-1]
        table = self._table(number + 1, buckets or now)
        latest(self.log(), [self.key], ["_version"]).select(*self.schema.names).write.insertInto(table, overwrite=True)
        self.spark.catalog.refreshTable(table)
        self._name(number + 1, buckets or now)

    def vacuum(self) -> None:
        """Delete all generations but the newest; readers of older ones must have ended."""
        for number, buckets in self._generations()[:-1]:
            for path in (f"{self.folder}/_named-{number}-{buckets}", f"{self.folder}/generation-{number}"):
                fs, hadoop = self._fs(path)
                fs.delete(hadoop, True)

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
