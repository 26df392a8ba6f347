"""Exact deduplication against a persistent digest index, with DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, fresh_path, staged

#: A digest with at least this share of a batch's rows is joined by broadcast; there are at most 1 / share of them.
HEAVY_SHARE = 1 / 1024


class DigestIndex:
    """An append-only table ``digest -> keep_id, group_size, batch``, bucketed and sorted by digest.

    Texts are equal when identical after lower-casing A-Z.  A new batch is aggregated to
    one row per digest, sort-merge anti-joined with the index and what is new is appended,
    bucket by bucket.  The index side of the join isn't shuffled; a bucket of several
    appends is several sorted files, which the join sorts again.

    Within a batch the row with the largest id stays.  A text that an earlier batch has
    brought in was already handed on, so its earlier row stays and the new rows go.

    The files hold the number of buckets (in the name of a ``_buckets-N`` file), since
    files written for one number can't be read for another: opening them again takes that
    number, whatever the session's settings, and refuses a different one that is asked for.

    A batch has a name, and adding a batch again gives the same result: texts that the
    index has under that name are its own.  So a job that died after its append, before
    its result was written, is simply run again, with the same name and the same rows.

    Null and empty texts are one group.  A null id is smaller than any other.  Rows that
    repeat both id and text: one of them stays.  Very long texts are digested whole.  An
    empty batch gives an empty result.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.spark, self.location = spark, location.rstrip("/")
        known = self._recorded()
        if known and buckets and buckets != known:
            raise ValueError(f"the index at {location} has {known} buckets, not {buckets}")
        self.buckets = known or buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not known:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.location}/_buckets-{self.buckets}")
            self._files().create(path, False).close()
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.location)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _recorded(self) -> int | None:
        """The number of buckets that the files were written for; None for a new index."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.location}/_buckets-*")
        found = self._files().globStatus(path) or []
        return int(found[0].getPath().getName().split("-")[1]) if len(found) else None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name; the files stay and a new index may be opened on them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Put a batch into the index, under its name.

        Returns one row per input row: id, digest, keep_id, group_size (rows of the index's
        batch that brought the text in), kept.  The result doesn't need the index any more.
        """
        # The one pass over the texts; what follows moves 32-byte digests.
        digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
        digests = staged(
            docs.select(F.col(id_col).cast("bigint").alias("id"), digest.alias("digest")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n")),
            "batch-digests",
        )
        # Written, or the anti-join would be moved below the aggregation and shuffle every row of a common text.
        groups = staged(digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("ids")), "batch-groups")
        new = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

        # Only what the batch asks of the index, written: the result outlives the index and its name.
        index = staged(self.rows().hint("merge").join(groups.select("digest"), "digest", "left_semi"), "batch-index")
        total = groups.agg(F.sum("ids")).first()[0] or 0
        # The rows of a very common text would all meet in one task of the merge join.  There are
        # at most 1 / HEAVY_SHARE such texts, so their index rows may be broadcast.
        least = max(1000, int(total * HEAVY_SHARE))
        heavy = groups.filter(F.col("ids") >= least).select("digest")
        heavy_rows = index.join(F.broadcast(heavy), "digest", "left_semi")
        light = digests.join(F.broadcast(heavy_rows.select("digest")), "digest", "left_anti").hint("merge").join(index, "digest")
        joined = light.unionByName(digests.join(F.broadcast(heavy_rows), "digest"))
        stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
        return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
            F.col("id").alias(id_col), "digest", "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept")
        )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, fresh_path(spark, "digests"))
    rows = index.add(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents")
    index.close()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
