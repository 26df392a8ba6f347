"""Completeness of sales that arrive in pieces: a stateful stream, keyed by bucket, with a calendar queue.

The rows of each day join their sale's open assembly, which closes as ``complete`` when it
holds the sale, a line and as many cents as are due; what stays incomplete is closed some
days after its first row.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.llm.common import buckets_for, by_bucket, fresh_path, mix64, pack, run_starts, staged, tidy, unpack

#: Sales that a bucket has, about; the number of buckets follows the input.
SALES_PER_BUCKET = 20_000
LEAST_BUCKETS = 64
#: Parts of a bucket's open assemblies that are read and written one by one.
PAGES = 4
#: Rows that a task of the stream folds at once; bounds a worker's memory.
FOLDED_ROWS = 1 << 20
#: "No day yet".
NEVER = -(1 << 40)
CLOSINGS = "sale_id bigint, first_day bigint, last_day bigint, n_lines bigint, cents bigint, due bigint, status string, closing_batch int"
FEED = "bucket int, kind int, sale_id bigint, day bigint, cents bigint, due bigint, last boolean, batch int"
LINE, SALE, TICK = 0, 1, 2
#: The state store that keeps map state, small buffers for its many instances, changes saved rather than whole tables,
#: and each instance closed once its batch is committed: the next start opens others, and one takes megabytes of disk even if empty.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _fold(sale: np.ndarray, day: np.ndarray, has: np.ndarray, lines: np.ndarray, cents: np.ndarray, due: np.ndarray) -> list[np.ndarray]:
    """One row per sale and day, in that order; ``due`` is 0 but on sale rows, which agree on it."""
    order = np.lexsort((day, sale))
    sale, day = sale[order], day[order]
    first = run_starts(sale, day)
    if not len(first):
        return [a[:0] for a in (sale, day, has, lines, cents, due)]
    fold = lambda f, a: f.reduceat(a[order], first)
    # Of a group's due values only those of sale rows count.
    dues = fold(np.maximum, np.where(has > 0, due, np.iinfo(np.int64).min))
    has = fold(np.maximum, has)
    return [sale[first], day[first], has, fold(np.add, lines), fold(np.add, cents), np.where(has > 0, dues, 0)]


@tidy
def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the feed as one packed row per bucket (and million rows of a task), and its ticks."""

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        col = lambda name: table.column(name).fill_null(0).to_numpy()
        kind, bucket = col("kind"), col("bucket")
        sale, day, cents, due = (col(c).astype(np.int64) for c in ("sale_id", "day", "cents", "due"))
        names, blobs = [], []
        data = np.flatnonzero(kind != TICK)
        for b, i in by_bucket(bucket[data]) if len(data) else ():
            i = data[i]
            line = (kind[i] == LINE).astype(np.int64)
            names.append(b)
            blobs.append(pack(*((a, k < 2) for k, a in enumerate(_fold(sale[i], day[i], 1 - line, line, cents[i], due[i])))))
        at, last, batch = [0] * len(names), [False] * len(names), [-1] * len(names)
        ticks = np.flatnonzero(kind == TICK)
        if len(ticks):
            names += bucket[ticks].tolist()
            blobs += [b""] * len(ticks)
            at += day[ticks].tolist()
            last += table.column("last").to_numpy()[ticks].tolist()
            batch += col("batch")[ticks].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.array(at, pa.int64()), pa.array(last, pa.bool_()), pa.array(batch, pa.int32())],
            ["bucket", "rows", "horizon", "last", "batch"],
        )

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= FOLDED_ROWS:
            yield from out(held)
            held, n = [], 0
    if n:
        yield from out(held)


class _Pages:
    """A bucket's open assemblies, sale_id -> [first_day, last_day, has sale, lines, cents, due], read and written by the page."""

    def __init__(self, state):
        self.state, self.pages, self.changed = state, {}, set()

    @staticmethod
    def of(sales: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(sales.astype(np.int64).view(np.uint64).copy()) % np.uint64(PAGES)).astype(np.int64)

    def page(self, number: int) -> dict[int, list[int]]:
        if number not in self.pages:
            kept = self.state.getValue((number,))
            columns = [a.tolist() for a in unpack(kept[0])] if kept is not None else [[]]
            self.pages[number] = {s: list(x) for s, *x in zip(*columns, strict=True)}
        return self.pages[number]

    def close(self) -> None:
        for number in self.changed:
            if page := self.pages[number]:
                rows = np.array([[s, *a] for s, a in sorted(page.items())], dtype=np.int64)
                self.state.updateValue((number,), (pack(*((c, k < 1) for k, c in enumerate(rows.T))),))
            else:
                self.state.removeKey((number,))


class Assembler(StatefulProcessor):
    """State of a bucket: the open assemblies by sale_id, and by first day the sales whose assembly began then.

    Both are map state.  A map call costs a round trip of about 0.3 ms to the state server,
    so neither has an entry per sale: the first holds pages of sales, the second one entry
    per day.  An assembly that closed as complete leaves its sale in the day's entry; the
    drain knows it by the first day it no longer has.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.assemblies = handle.getMapState("assemblies", "page int", "assemblies binary")
        self.slots = handle.getMapState("slots", "first_day bigint", "sale_ids binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, tick = [], None
        for frame in rows:
            for blob, horizon, last, batch in zip(frame["rows"], frame["horizon"], frame["last"], frame["batch"], strict=True):
                if len(blob):
                    parts.append(unpack(bytes(blob)))
                else:
                    tick = (int(horizon), bool(last), int(batch))
        if tick is None:
            raise ValueError(f"bucket {key[0]} got rows without a tick")
        horizon, last, batch = tick
        pages, closed = _Pages(self.assemblies), []
        if parts:
            self._join(pages, closed, _fold(*map(np.concatenate, zip(*parts, strict=True))))
        self._drain(pages, closed, horizon, last)
        pages.close()
        if closed:
            out = pd.DataFrame(closed, columns=["sale_id", "first_day", "last_day", "n_lines", "cents", "due", "status"])
            out["due"] = pd.array(out["due"], dtype="Int64")
            out["closing_batch"] = np.int32(batch)
            yield out

    def _join(self, pages: _Pages, closed: list, groups: list[np.ndarray]) -> None:
        """Each sale's days, in order, to its open assembly; then what is new to the calendar."""
        begun: dict[int, list[int]] = {}
        numbers = _Pages.of(groups[0])
        pages.changed.update(np.unique(numbers).tolist())
        for number, at in by_bucket(numbers):
            page = pages.page(number)
            fresh = set()
            for s, d, has, lines, cents, due in zip(*(g[at].tolist() for g in groups), strict=True):
                a = page.get(s)
                if a is None:
                    a = page[s] = [d, d, 0, 0, 0, 0]
                    fresh.add(s)
                a[1] = max(a[1], d)
                a[3] += lines
                a[4] += cents
                if has:
                    a[2], a[5] = 1, due
                if a[2] and a[3] and a[4] == a[5]:
                    closed.append((s, a[0], a[1], a[3], a[4], a[5], "complete"))
                    del page[s]
            for s in fresh:
                if a := page.get(s):
                    begun.setdefault(a[0], []).append(s)
        known = {k[0] for k in self.slots.keys()} if begun else set()
        for day, sales in begun.items():
            ids = np.array(sorted(sales), dtype=np.int64)
            if day in known:
                ids = np.union1d(unpack(self.slots.getValue((day,))[0])[0], ids)
            self.slots.updateValue((day,), (pack((ids, True)),))

    def _drain(self, pages: _Pages, closed: list, horizon: int, last: bool) -> None:
        """Close what the calendar has up to ``patience`` days before the horizon; at the end, everything."""
        for (day,) in list(self.slots.keys()):
            if not last and day + self.patience > horizon:
                continue
            ids = unpack(self.slots.getValue((day,))[0])[0]
            for number, at in by_bucket(_Pages.of(ids)):
                page = pages.page(number)
                for s in ids[at].tolist():
                    a = page.get(s)
                    if a is None or a[0] != day:
                        continue
                    status = "headless" if not a[2] else "orphan" if not a[3] else "short" if a[4] < a[5] else "over"
                    closed.append((s, a[0], a[1], a[3], a[4], a[5] if a[2] else None, status))
                    del page[s]
                    pages.changed.add(number)
            self.slots.removeKey((day,))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder if it is there; nothing is copied."""
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(source):
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{source} can't be moved to {target}")


def assemble(lines: DataFrame, sales: DataFrame, batches: int, patience: int = 10, folder: str | None = None) -> DataFrame:
    """Closings of assemblies, as ``CLOSINGS`` says, from lines and sales that arrive in numbered batches.

    ``lines``: sale_id, day, cents, batch; every row counts.  ``sales``: sale_id, day, due,
    batch; rows of one sale agree on due.  Days are whole numbers that don't fall from batch
    to batch.  After each batch, assemblies close whose first day lies ``patience`` days or
    more before the largest day of all earlier batches; after the last one, all.  Nulls in
    sale_id must have been dropped; null cents count 0.  Empty batches, and a wholly
    empty input, still tick.  Columns not named are ignored.

    The batches are written to ``folder`` (a new one below the shared folder, if none is
    named), each with a tick row for every bucket; one after the other they are moved to
    where a stateful stream reads, which is started anew for each on one checkpoint.  A run
    that was stopped goes on when it is called again with the same folder and input.

    A bucket is a hash of the sale_id; their number follows the input.  A hot sale's rows are
    folded to one a day in each task before the shuffle, so no bucket gets more than a few
    of them.  The largest day of each batch is all that reaches the driver.
    """
    spark = lines.sparkSession
    folder = folder or fresh_path(spark, "assembly")
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/written/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        _write_feed(lines, sales, batches, f"{folder}/written")
    with _settings(spark):
        for b in range(batches):
            _move(spark, f"{folder}/written/batch={b}", f"{folder}/feed/batch={b}")
            feed = spark.readStream.schema(FEED).option("basePath", f"{folder}/feed").parquet(f"{folder}/feed")
            packed = feed.mapInArrow(_folded, "bucket int, rows binary, horizon bigint, last boolean, batch int")
            closings = packed.groupBy("bucket").transformWithStateInPandas(Assembler(patience), outputStructType=CLOSINGS, outputMode="Append", timeMode="None")
            sink = closings.writeStream.format("parquet").option("path", f"{folder}/closings").option("checkpointLocation", f"{folder}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CLOSINGS).parquet(f"{folder}/closings")


def _write_feed(lines: DataFrame, sales: DataFrame, batches: int, path: str) -> None:
    spark = lines.sparkSession
    days = lines.select("batch", "day").unionByName(sales.select("batch", "day")).groupBy("batch").agg(F.max("day").alias("day")).collect()
    latest = {r["batch"]: r["day"] for r in days}
    horizon = [max([NEVER, *(latest[x] for x in latest if x < b)]) for b in range(batches)]
    # As many buckets as sales, headless ones included, need; lines have few sales each that no sale row has.
    buckets = buckets_for(sales.count(), SALES_PER_BUCKET, LEAST_BUCKETS)
    bucket = F.pmod(F.xxhash64("sale_id"), F.lit(buckets)).cast("int").alias("bucket")
    none = F.lit(None).cast("bigint")
    no = F.lit(False).alias("last")
    rows = lines.select(bucket, F.lit(LINE).alias("kind"), "sale_id", "day", F.coalesce("cents", F.lit(0)).alias("cents"), none.alias("due"), no, "batch")
    heads = sales.select(bucket, F.lit(SALE).alias("kind"), "sale_id", "day", F.lit(0).cast("bigint").alias("cents"), "due", no, "batch")
    ticks = spark.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    ticks = ticks.select("bucket", F.lit(TICK).alias("kind"), none.alias("sale_id"), F.array(*map(F.lit, horizon))[F.col("batch")].cast("bigint").alias("day"), none.alias("cents"), none.alias("due"), (F.col("batch") == batches - 1).alias("last"), "batch")
    rows.unionByName(heads).unionByName(ticks).write.mode("overwrite").partitionBy("batch").parquet(path)


# ---------------------------------------------------------------- the shop's tables

BATCHES, FIRST_DAY, DAYS = 10, 19723, 160
LINE_COLUMNS = ("sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "flag", "shipped_at")


def _cents(c: str) -> Column:
    """floor(100 * amount + 0.5); null and non-finite amounts are 0."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0).otherwise(F.coalesce(F.floor(F.lit(100.0) * x + F.lit(0.5)), F.lit(0))).cast("bigint")


def _day(c: str) -> Column:
    return F.unix_date(F.col(c).cast("date")).cast("bigint")


def _batch(day: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / F.lit(float(DAYS))))).cast("int")


def arrivals(sale_lines: DataFrame, sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``assemble`` takes, from the shop's sale_lines and sales.

    Rows without a sale_id are dropped.  Lines that repeat in every column are one.  A null
    line_no is written as an empty string in a line's hash, a null arrived_at is the first
    day, null and non-finite amounts are 0 cents.  A sale that repeats is due once, for its
    largest total.  Empty tables give empty results; other columns aren't read.

    Lines are made distinct by a shuffle over all their columns and summed by sale and day
    before they meet by sale, so a hot sale is at most as many rows as it has days.
    """
    lines = sale_lines.filter("sale_id IS NOT NULL").select(F.col("sale_id").cast("bigint").alias("sale_id"), *LINE_COLUMNS[1:]).distinct()
    h = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))).cast("binary"))
    day = F.coalesce(_day("shipped_at") + h % 15, FIRST_DAY + h % 152)
    lines = staged(lines.select("sale_id", day.alias("day"), _cents("amount").alias("cents")).withColumn("batch", _batch(F.col("day"))), "arrived-lines")
    daily = lines.groupBy("sale_id", "day").agg(F.sum("cents").alias("cents"))
    known = daily.groupBy("sale_id").agg(F.sum("cents").alias("all"), F.max_by("cents", "day").alias("late"))
    heads = sales.filter("sale_id IS NOT NULL").select(F.col("sale_id").cast("bigint").alias("sale_id"), F.coalesce(_day("arrived_at"), F.lit(FIRST_DAY)).alias("day"), _cents("total").alias("total"))
    heads = heads.groupBy("sale_id").agg(F.max("total").alias("total"), F.collect_set("day").alias("days")).join(known, "sale_id", "left")
    law = F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5
    due = F.when(law == 0, F.col("total")).when(law == 1, F.coalesce(F.col("all") - F.col("late"), F.lit(0))).otherwise(F.coalesce("all", F.lit(0)))
    heads = heads.select("sale_id", F.explode("days").alias("day"), due.cast("bigint").alias("due"))
    return lines, staged(heads.withColumn("batch", _batch(F.col("day"))), "arrived-sales")


def op11_sale_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, sales = arrivals(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/sales.parquet"))
    return assemble(lines, sales, BATCHES)


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in SQL: each character is followed by eight shifts, written as -1."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda z: [ascii(z)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN z >= 0 THEN xor(a, z) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, z: {step}), 4294967295::BIGINT)"


SQL = f"""
WITH RECURSIVE l0 AS (SELECT DISTINCT * FROM sale_lines WHERE sale_id IS NOT NULL),
l1 AS (SELECT sale_id, shipped_at, coalesce(CAST(floor(100 * amount + 0.5) AS BIGINT), 0) AS cents, {_crc32("sale_id || ':' || coalesce(CAST(line_no AS VARCHAR), '')")} AS h FROM l0),
l AS MATERIALIZED (SELECT sale_id, cents, CASE WHEN shipped_at IS NULL THEN 19723 + h % 152 ELSE date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) + h % 15 END AS day FROM l1),
daily AS (SELECT sale_id, day, sum(cents) AS cents FROM l GROUP BY sale_id, day),
known AS (SELECT sale_id, sum(cents) AS every, arg_max(cents, day) AS late FROM daily GROUP BY sale_id),
s0 AS (SELECT sale_id, max(coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0)) AS total, {_crc32("CAST(sale_id AS VARCHAR)")} % 5 AS law
       FROM sales WHERE sale_id IS NOT NULL GROUP BY sale_id),
s AS MATERIALIZED (SELECT DISTINCT sale_id, coalesce(date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)), 19723) AS day,
      CASE law WHEN 0 THEN s0.total WHEN 1 THEN coalesce(every - late, 0) ELSE coalesce(every, 0) END AS due
      FROM sales JOIN s0 USING (sale_id) LEFT JOIN known USING (sale_id)),
groups AS MATERIALIZED (
  SELECT sale_id, day, greatest(0, least(9, CAST(floor((day - 19723) * 10 / 160.0) AS BIGINT))) AS batch, count(due) AS heads, count(cents) AS n, coalesce(sum(cents), 0) AS cents, max(due) AS due,
         row_number() OVER (PARTITION BY sale_id ORDER BY day) AS k
  FROM (SELECT sale_id, day, cents, NULL AS due FROM l UNION ALL SELECT sale_id, day, NULL, due FROM s) GROUP BY sale_id, day),
tops AS MATERIALIZED (SELECT b, max(day) AS top FROM range(10) t(b) LEFT JOIN groups ON batch < b GROUP BY b),
ends AS MATERIALIZED (SELECT day, coalesce(min(b), 9) AS ends FROM (SELECT DISTINCT day FROM groups) LEFT JOIN tops ON top >= day + 10 GROUP BY day),
opened AS MATERIALIZED (SELECT g.*, greatest(g.batch, e.ends) AS ends FROM groups g JOIN ends e USING (day)),
walk AS (
  SELECT sale_id, k, batch, day AS first_day, day AS last_day, ends, heads > 0 AS head, n, CAST(cents AS BIGINT) AS cents, due, heads > 0 AND n > 0 AND cents = due AS complete, true AS begins
  FROM opened WHERE k = 1
  UNION ALL
  SELECT sale_id, k, batch, first_day, last_day, ends, head, n, cents, due, head AND n > 0 AND cents = due, NOT joins
  FROM (SELECT g.sale_id, g.k, g.batch, NOT w.complete AND g.batch <= w.ends AS joins, CASE WHEN joins THEN w.first_day ELSE g.day END AS first_day, g.day AS last_day,
               CASE WHEN joins THEN w.ends ELSE g.ends END AS ends, g.heads > 0 OR (joins AND w.head) AS head, g.n + CASE WHEN joins THEN w.n ELSE 0 END AS n,
               CAST(g.cents + CASE WHEN joins THEN w.cents ELSE 0 END AS BIGINT) AS cents, CASE WHEN g.heads > 0 THEN g.due WHEN joins THEN w.due END AS due
        FROM walk w JOIN opened g ON g.sale_id = w.sale_id AND g.k = w.k + 1)),
seen AS (SELECT *, coalesce(lead(begins) OVER (PARTITION BY sale_id ORDER BY k), true) AS over FROM walk)
SELECT sale_id, CAST(first_day AS BIGINT) AS first_day, CAST(last_day AS BIGINT) AS last_day, CAST(n AS BIGINT) AS n_lines, CAST(cents AS BIGINT) AS cents, CAST(CASE WHEN head THEN due END AS BIGINT) AS due,
       CASE WHEN complete THEN 'complete' WHEN NOT head THEN 'headless' WHEN n = 0 THEN 'orphan' WHEN cents < due THEN 'short' ELSE 'over' END AS status,
       CAST(CASE WHEN complete THEN batch ELSE ends END AS INTEGER) AS closing_batch
FROM seen WHERE complete OR over
"""
