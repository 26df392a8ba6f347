"""Schedules as a stateful stream: a timer per saved query, driven by the instants of a clock stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.cron import next_fire, prev_fire
from tessera.operators.schedule import scheduled

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # one instance takes megabytes of disk, even an empty one
}
_FAILED = "id string, at timestamp"
#: What runs due queries: (id, fire, now) in, (id, ok) out.
Run = Callable[[DataFrame], DataFrame]


def _moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


class Ticker(StatefulProcessor):
    """State per saved query: its schedule, when it ran last and before that; one timer for what comes next.

    A timer that the clock has passed looks for the last fire at or before now: however
    many were missed, that is one run.  A row that reports a failed run takes the mark
    back, and the query is due again as soon as the clock goes on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("schedule", "cron string, last bigint, before bigint")

    def _arm(self, cron: str, after: int) -> None:
        if (fire := next_fire(cron, _moment(after))) is not None:
            self.handle.registerTimer(int(fire.timestamp() * 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        cron, since = initialState["schedule_cron"].iloc[0], int(initialState["since"].iloc[0])
        self.state.update((cron, since, since))
        self._arm(cron, since)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if self.state.exists():  # a failed run; rows of the clock have a key of their own
            cron, _, before = self.state.get()
            self.state.update((cron, before, before))
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        cron, last, _ = self.state.get()
        fire = prev_fire(cron, _moment(now))
        if fire is not None and fire.timestamp() * 1000 > last:
            self.state.update((cron, now, last))
            self._arm(cron, now)
            yield pd.DataFrame({"id": [key[0]], "fire": [int(fire.timestamp() * 1000)], "now": [now]})

    def close(self) -> None:
        pass


def isolated(run: Callable[[str, datetime], None], isolate: bool = True) -> Run:
    """Run each due query in a task, by ``run`` (id, now); isolated, one failure doesn't stop the others."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = []
            for i, now in zip(f["id"], f["now"], strict=True):
                try:
                    run(i, now.to_pydatetime())
                except Exception:
                    if not isolate:
                        raise
                    ok.append(False)
                else:
                    ok.append(True)
            yield pd.DataFrame({"id": f["id"], "ok": ok})

    return lambda due: due.mapInPandas(each, "id string, ok boolean")


def start(spark: SparkSession, clock: DataFrame, queries: DataFrame, run: Run, folder: str, at: str = "at", every: str | None = "300 seconds") -> StreamingQuery:
    """Drive saved queries (id, schedule_cron, enabled, created_at, last_run_at) from a stream of instants.

    Now is the largest instant so far.  ``run`` gets all queries due at a tick at once, as
    rows (id, fire, now), and says which succeeded; those that didn't are due again at the
    next tick.  ``every`` is the period of the ticks; without one, what is there is worked
    off and the stream stops.

    ``folder`` holds the checkpoint, the marks and the failures.  Started again on it, the
    stream goes on: a tick whose marks are written isn't run again, and ``queries`` counts
    only at the first start.  Schedules that can't be read never fire.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    failed, marks = f"{folder}/failed", f"{folder}/marks"
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(failed))

    def each(due: DataFrame, epoch: int) -> None:
        own = f"{marks}/tick={epoch}"
        if fs.exists(fs_path(f"{own}/_SUCCESS")):
            return
        due = due.select("id", F.timestamp_millis("fire").alias("fire"), F.timestamp_millis("now").alias("now")).persist()
        due.join(run(due), "id").select("id", "fire", "now", "ok").write.mode("overwrite").parquet(own)
        due.unpersist()
        # A microsecond past the tick, so that it isn't late.
        again = spark.read.parquet(own).filter("NOT ok").select("id", (F.col("now") + F.expr("INTERVAL 1 MICROSECOND")).alias("at"))
        if not again.isEmpty():
            again.write.mode("overwrite").parquet(f"{failed}/tick={epoch}")

    known = scheduled(queries).select(F.col("id").cast("string").alias("id"), "schedule_cron", F.unix_millis(F.coalesce("last_run_at", "created_at").cast("timestamp")).alias("since")).filter("since IS NOT NULL")
    # The clock's key is empty but, like the failures', nullable: a key's type may not change between starts.
    moments = clock.select(F.col(at).cast("string").substr(1, 0).alias("id"), F.col(at).cast("timestamp").alias("at"))
    back = spark.readStream.schema(_FAILED).option("recursiveFileLookup", "true").parquet(failed)
    events = moments.unionByName(back).withWatermark("at", "0 seconds")
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        due = events.groupBy("id").transformWithStateInPandas(Ticker(), outputStructType="id string, fire bigint, now bigint", outputMode="Update", timeMode="EventTime", initialState=known.groupBy("id"))
        sink = due.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{folder}/state")
        return (sink.trigger(processingTime=every) if every else sink.trigger(availableNow=True)).start()
    finally:  # the query has a copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ticks(spark: SparkSession, clock: DataFrame, queries: DataFrame, run: Run, folder: str, at: str = "at") -> DataFrame:
    """``start`` over what the clock has, to its end.  Returns the marks: id, fire, now, ok."""
    start(spark, clock, queries, run, folder, at, None).awaitTermination()
    marks = f"{folder}/marks"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "id string, fire timestamp, now timestamp, ok boolean"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(marks) if fs.exists(fs_path(marks)) else spark.createDataFrame([], schema)
