"""MinHash signatures in exact arithmetic modulo a prime."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The family's prime and width, and how its coefficients are drawn (``_hash`` of "a:i" and "b:i").
PRIME = (1 << 61) - 1
WIDTH = 64


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def coefficients(width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(i, a, b) of the family (a h + b) mod PRIME; a is odd."""
    return [(i, _hash(f"a:{i}") % PRIME | 1, _hash(f"b:{i}") % PRIME) for i in range(width)]


def shingle_hash(c: Column) -> Column:
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _reduce(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, which is 2**61 - 1: its upper bits are added to its lower ones."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def affine(h: np.ndarray, a: int, b: int) -> np.ndarray:
    """(a h + b) mod PRIME in 64-bit words, for h and a below 2**61.

    With halves of 31 and 30 bits, a h = hi 2**62 + mid 2**31 + lo, and 2**61 is 1.
    """
    low = np.uint64((1 << 31) - 1)
    h0, h1 = h & low, h >> np.uint64(31)
    a0, a1 = np.uint64(a & ((1 << 31) - 1)), np.uint64(a >> 31)
    mid = h1 * a0 + h0 * a1  # below 2**62
    hi = _reduce(h1 * a1 * np.uint64(2))
    mid = _reduce((mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)))
    return _reduce(_reduce(hi + mid) + _reduce(_reduce(h0 * a0) + np.uint64(b)))


def signature_rows(items: DataFrame, id_col: str, shingles: Column, width: int = WIDTH, hashed_by: str = "md5") -> DataFrame:
    """(id, signature): the least value of each hash function over the item's shingles; none for an item without.

    By ``md5`` shingles are hashed in the JVM and their 60-bit hashes go to an Arrow kernel,
    an item a row.  By ``blake2b`` the kernel takes all 64 bits of each shingle's digest,
    one by one; that is slower, and the same as signatures made elsewhere of it.
    """
    if hashed_by not in ("md5", "blake2b"):
        raise ValueError(f"no hash {hashed_by}")
    family = coefficients(width)
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if hashed_by == "blake2b":
                h = np.array([_hash(x) % PRIME for x in lists.flatten().to_pylist()], dtype=np.uint64)
            else:
                h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
            minima = np.stack([np.minimum.reduceat(affine(h, a, b), starts) for _, a, b in family], axis=1) if len(starts) else np.zeros((0, width), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(minima.view(np.int64)), pa.list_(pa.int64()))], names=["id", "signature"])

    hashed = items.select(F.col(id_col).alias("id"), (shingles if hashed_by == "blake2b" else F.transform(shingles, shingle_hash)).alias("h")).filter(F.size("h") > 0)
    return hashed.mapInArrow(run, f"id {kind}, signature array<bigint>").withColumnRenamed("id", id_col)


def estimate(a: Column, b: Column) -> Column:
    """The share of agreeing places; 0 if a signature is missing or empty or they differ in width."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)).otherwise(F.lit(0.0))
