"""Sharding by a minimax contiguous partition over ordered groups of equal texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import staged

#: The first look at the order is at 2**TOP ranges of it, each closer look at 2**STEP parts of a range.
TOP, STEP = 16, 8
#: Rows of one range that are numbered in one task, at least; a larger group of equal texts is dealt out by id.
BLOCK_ROWS = 10_000


@dataclass
class Ranges:
    """Consecutive ranges of the order: lowest and highest group in each, bytes, rows."""

    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray
    rows: np.ndarray

    @property
    def atomic(self) -> np.ndarray:
        return self.lo == self.hi


def greedy_cuts(total: np.ndarray, atomic: np.ndarray, capacity: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Fill shards one after another up to ``capacity``: the earliest and the latest places where they can end.

    ``total``: running sums with a leading 0.  A range that isn't ``atomic`` can be cut
    somewhere inside: the latest end takes the place wished for, the earliest the range's start.
    """
    early, late = np.zeros(shards, dtype=np.int64), np.zeros(shards, dtype=np.int64)
    a = b = 0
    for k in range(shards):
        i = int(np.searchsorted(total, a + capacity, side="right")) - 1
        a = int(total[i])
        j = int(np.searchsorted(total, b + capacity, side="right")) - 1
        b = int(total[j]) if j >= len(atomic) or atomic[j] else b + capacity
        early[k], late[k] = a, b
    return early, late


def smallest_capacity(total: np.ndarray, atomic: np.ndarray, shards: int, whole: bool) -> int:
    """Binary search for the least capacity at which ``shards`` hold everything.

    ``whole`` takes every range as atomic (an upper bound), else only those that are.
    """
    lo, hi = -(-int(total[-1]) // shards), max(int(total[-1]), 0)
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(total, atomic, mid, shards)[0 if whole else 1][-1] >= total[-1]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _sums(keys: DataFrame, bits: int) -> DataFrame:
    return keys.groupBy(F.shiftright("h", 64 - bits).alias("p")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))


def _ranges(rows: list) -> Ranges:
    rows = sorted(rows, key=lambda r: r["lo"])
    return Ranges(*(np.array([r[c] for r in rows], dtype=np.int64) for c in ("lo", "hi", "size", "rows")))


class _Order:
    """The groups in the order of their hash, known as closely as was asked for."""

    def __init__(self, keys: DataFrame):
        self.keys, self.spark = keys, keys.sparkSession
        self.known = _ranges(_sums(keys, TOP).collect())  # 2**TOP rows at most
        self.bits = np.full(len(self.known.lo), TOP)

    def refine(self, which: np.ndarray) -> None:
        """Replace the ranges ``which`` by their parts."""
        r, parts = self.known, []
        for bits in np.unique(self.bits[which]):
            chosen = self.spark.createDataFrame([(int(x >> (64 - int(bits))),) for x in r.lo[which & (self.bits == bits)]], "q bigint")
            within = self.keys.join(F.broadcast(chosen), F.shiftright("h", 64 - int(bits)) == F.col("q"), "left_semi")
            part = _ranges(_sums(within, min(64, int(bits) + STEP)).collect())
            parts.append((part, np.full(len(part.lo), min(64, int(bits) + STEP))))
        parts.append((Ranges(r.lo[~which], r.hi[~which], r.size[~which], r.rows[~which]), self.bits[~which]))
        lo, hi, size, rows = (np.concatenate([getattr(p, c) for p, _ in parts]) for c in ("lo", "hi", "size", "rows"))
        order = np.argsort(lo)
        self.known, self.bits = Ranges(lo[order], hi[order], size[order], rows[order]), np.concatenate([b for _, b in parts])[order]


def plan_shards(keys: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """Giant groups (hash -> shard), the last hash of each other shard but the last, and the capacity.

    A group larger than an even share gets a shard of its own, and what is left is
    shared out over the others; so one hot text doesn't leave the other shards empty.
    ``keys`` has h (hash of the text) and size.  Of it the driver gets sums over at most
    2**TOP ranges, then closer ones only where a cut can fall.
    """
    order = _Order(keys)
    giants: dict[int, int] = {}
    while True:
        r = order.known
        left = ~np.isin(r.lo, list(giants)) | ~r.atomic
        rest = int(r.size[left].sum())
        large = left & (r.size * max(1, shards - len(giants)) > rest) & (len(giants) < shards - 1)
        if (large & ~r.atomic).any():
            order.refine(large & ~r.atomic)
        elif large.any():
            giants[int(r.lo[np.flatnonzero(large)[np.argmax(r.size[large])]])] = len(giants)
        else:
            break
    free = shards - len(giants)
    while True:
        r = order.known
        keep = ~(np.isin(r.lo, list(giants)) & r.atomic)
        size, atomic, total = r.size[keep], r.atomic[keep], np.concatenate([[0], np.cumsum(r.size[keep])])
        least, most = (smallest_capacity(total, atomic, free, whole) for whole in (False, True))
        early, _ = greedy_cuts(total, atomic, least, free)
        _, late = greedy_cuts(total, atomic, most, free)
        open_ = np.zeros(len(size), dtype=bool)
        for a, b in zip(early[:-1], late[:-1], strict=True):
            open_[max(0, np.searchsorted(total, a, side="right") - 1) : np.searchsorted(total, b, side="right")] = True
        open_ &= ~atomic
        if not open_.any():
            break
        which = np.zeros(len(keep), dtype=bool)
        which[np.flatnonzero(keep)[open_]] = True
        order.refine(which)
    cuts, at, lo, hi = [], 0, r.lo[keep], r.hi[keep]
    for _ in range(free - 1):
        to = int(np.searchsorted(total, total[at] + least, side="right")) - 1
        cuts.append(int(hi[to - 1]) if to else -(1 << 63))
        at = to
    return giants, cuts, least


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Put each row into one of ``shards`` shards of near equal bytes; equal texts stay together.

    The atomic groups are ordered by a hash of their text, so the order doesn't depend on
    how the input is laid out.  The smallest capacity is binary-searched, greedy filling
    says whether one is feasible, and the shards are cut there.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32, law ('bytes'), shard, slot
    (gapless from 0 in each shard) and grown_shard (null: the law has none).  Null and empty
    texts are one group of size ``overhead`` each.  Null ids are allowed and come first.
    Repeated rows each have their own slot; of rows alike in text and id it doesn't matter which
    has which.  A very long text is a group like any other.  With fewer groups than shards some
    shards are empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + overhead).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-keys",
    )
    giants, cuts, _ = plan_shards(keys, shards)
    spark = keys.sparkSession
    # The cuts are in order, so a row's shard is the number of cuts before it.
    shard = F.lit(len(giants))
    for c in cuts:
        shard = shard + (F.col("h") > F.lit(c)).cast("int")
    for h, s in giants.items():
        shard = F.when(F.col("h") == F.lit(h), F.lit(s)).otherwise(shard)
    placed = keys.withColumn("shard", shard.cast("int")).withColumn("block", F.shiftright("h", 64 - TOP))

    # Slots: ranges of the order are numbered apart and shifted by what lies before them.  A text with
    # very many rows is dealt out by id; there are at most rows / least such texts.
    rows = keys.count()
    least = max(BLOCK_ROWS, rows >> TOP)
    heavy = keys.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least).select("h", F.ceil(F.col("rows") / least).cast("int").alias("ways"))
    placed = placed.join(F.broadcast(heavy), "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("ways")).cast("int"), F.lit(0))).drop("ways")
    where = ["shard", "block", "part"]
    ahead = Window.partitionBy("shard").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).drop("rows")
    within = F.row_number().over(Window.partitionBy(*where).orderBy("h", "id"))
    return (
        placed.withColumn("n", within)
        .join(F.broadcast(offsets), where)  # 2**TOP blocks, as many parts of heavy texts and the shards' cuts at most
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("n") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
