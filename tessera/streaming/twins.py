"""Streaming twins of the ledger, the centroids and reconciling, over folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import triage
from tessera.operators.ledger import insert_ignore
from tessera.operators.triage import Judge, Thresholds, near_corpus
from tessera.sources.tables import table
from tessera.store.tables import Store, staged


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream; its schema is the batch table's."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 4)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def shown_ledger(spark: SparkSession, stream: DataFrame, keys: list[str], at: str, folder: str) -> DataFrame:
    """Keep the first sighting of each key: micro-batches append their own firsts, the view folds them.

    A batch that is run again replaces its own rows, so a restart on the same ``folder``
    goes on where it was, late rows need no watermark, and no state grows in memory.
    """
    out = f"{folder}/ledger"

    def each(batch: DataFrame, epoch: int) -> None:
        insert_ignore(batch, keys, at).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return insert_ignore(spark.read.parquet(out), keys, at)


def running_centroids(spark: SparkSession, stream: DataFrame, keys: list[str], vector: str, folder: str) -> DataFrame:
    """(keys, i, value, n): each component's mean over all vectors so far.

    Sums and counts live in the state store, per key and component; a micro-batch updates
    those it touches and writes nothing else, and the means are read from the state.  Null
    vectors don't count.  Started again on the same ``folder``, the stream goes on.
    """
    parts = stream.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    sums = parts.groupBy(*keys, "i").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    sums.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    total, count = (F.col("value")[n] for n in ("sum", "count"))
    kept = spark.read.format("statestore").load(f"{folder}/state").filter(count > 0)
    return kept.select(*(F.col("key")[k].alias(k) for k in (*keys, "i")), (total / count).alias("value"), count.alias("n"))


def reconcile(spark: SparkSession, stream: DataFrame, store: Store, judge: Judge, t: Thresholds = Thresholds(), name: str = "reconcile") -> DataFrame:
    """Triage candidates that arrive over time against all that earlier sessions stored.  Returns the stored records.

    Every micro-batch is a run: its candidates (the columns of triage, in the order of
    ``pos``) meet the store's records of their blocks, and what they insert or fill is
    upserted under a version of its own.  ``name`` names the stream: its checkpoint and a
    commit log lie in the store, so a stream that is started again goes on where it was.

    A batch takes effect once.  It reads only versions below its own, its records' ids come
    from its name and number, each of its two writes replaces what an attempt that was
    stopped has left, and a batch that is in the commit log is passed over.
    """
    base = store.stream_base(name)

    def each(batch: DataFrame, epoch: int) -> None:
        if store.committed(name, epoch):
            return
        version = base + epoch + 1
        batch = staged(batch.withColumn("run", F.lit(f"{name}-{epoch}")), "candidates")
        known = store.view("canonical", below=version).select("*", *(F.col(f"geo.{c}").alias(c) for c in ("city", "country", "venue", "lat", "lon"))).withColumnRenamed("source_search_result_ids", "source_ids").drop("geo", "city_key", "starts_epoch")
        done = triage.reconcile(batch, near_corpus(batch, known, "run", t), "run", judge, t)
        store.upsert_canonical(done.golden, done.provenance, version, once=f"{name}-{epoch}")
        store.commit(name, epoch)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{store.folder}/_streams/{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.view("canonical")
