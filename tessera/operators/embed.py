"""Vectors of texts, made once and kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.ports.models import Embedder, HashEmbedder, embed_column
from tessera.store.tables import staged


class VectorCache:
    """A table digest -> embedding, bucketed and sorted by digest, that only grows.

    A batch's texts come down to one row per digest before anything is looked up, so a text
    that very many rows share is looked up and embedded once; looking up shuffles the
    batch's digests, never the table.  A null text has no vector.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, make: Callable[[], Embedder] = HashEmbedder):
        self.spark, self.make = spark, make
        self.name = f"vector_cache_{uuid.uuid4().hex}"
        n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, embedding ARRAY<DOUBLE>) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{location}'")

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def embed(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``embedding`` and ``made``: whether the vector had to be made now.

        Only texts that the table lacks are embedded, in batches, and appended.
        """
        digest = F.unhex(F.sha2(F.col(text), 256))
        texts = rows.filter(F.col(text).isNotNull()).select(digest.alias("digest"), F.col(text).alias("_text")).groupBy("digest").agg(F.any_value("_text").alias("_text"))
        missing = staged(texts.hint("merge").join(self.spark.table(self.name).select("digest"), "digest", "left_anti"), "texts-without-vector")
        missing.select("digest", embed_column(F.col("_text"), self.make).alias("embedding")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        asked = staged(self.spark.table(self.name).hint("merge").join(texts.select("digest"), "digest", "left_semi"), "vectors-of-texts")
        known = asked.join(missing.select("digest", F.lit(True).alias("made")), "digest", "left")
        return rows.withColumn("_digest", digest).join(known.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest").withColumn("made", F.coalesce("made", F.lit(False)))
