"""Shared pieces: staged tables, word hashing over Arrow buffers, packed shuffles."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Word separators: space and tab to carriage return.
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one NumPy pass works on; bounds a worker's memory.
SLICE_BYTES = 2 << 20
#: Bytes of text whose words are hashed at once; a worker keeps two tables of powers of that length.
HASHED_BYTES = 1 << 19


#: Bytes that a task holds back before it writes a row group of an intermediate table.
ROW_GROUP_BYTES = 16 << 20


# ---------------------------------------------------------------- session


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir")
    import tempfile

    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Row keys that are broadcast, at most (about 16 MB as a hashed relation).
MOST_BROADCAST_KEYS = 500_000


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df``, written once with a key of its own for each row, so that null and repeated ids don't matter."""
    return staged(df.withColumn(key, F.monotonically_increasing_id()), "keyed-rows")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``gone`` (key), which is written and counted: few are broadcast, many joined by a shuffle."""
    gone = staged(gone.select(key), "gone-rows")
    few = gone.count() <= MOST_BROADCAST_KEYS
    return df.join(F.broadcast(gone) if few else gone, key, "left_anti").drop(key)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def buckets_for(total: int, each: int, least: int = 8) -> int:
    """As many buckets as keep each near ``each`` units; grows with the input."""
    return max(least, -(-total // each))


def ascii_lower(c):
    """Lower-case A-Z only.  All-ASCII strings take the byte-wise ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


# ---------------------------------------------------------------- workers


def tidy(run):
    """A batch reader that gives freed memory back when its partition ends: idle workers stay small beside the JVM."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def xxhash_long(ids: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint column, vectorised (as int64)."""
    p1, p2, p3, p4, p5 = (U64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << U64(r)) | (v >> U64(64 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(ids), U64(seed) + p5 + U64(8), dtype=U64)
        h ^= rot(ids.astype(np.int64).view(U64) * p2, 31) * p1
        h = rot(h, 27) * p1 + p4
        h ^= h >> U64(33)
        h *= p2
        h ^= h >> U64(29)
        h *= p3
        h ^= h >> U64(32)
    return h.view(np.int64)


_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = n + (n >> 3) + 1024
            self.up, self.down = (np.concatenate([[U64(1)], np.full(self.n, U64(b), dtype=U64)]) for b in (self.base, self.inverse))
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_IN_WORD, _IN_WINDOW, _IN_CHECK = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


class Words:
    """The words of a slice of documents.

    ``start`` and ``end`` are byte offsets into ``data``, ``doc`` the row each word is
    in, ``first`` the index of each row's first word (one more at the end).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = _IS_SEP):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        base = int(offsets[0])
        offsets = offsets - base
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, dtype=np.uint8)[base : base + int(offsets[-1])] if data is not None and n else np.zeros(0, dtype=np.uint8)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data | 32, self.data)
        sep = separators[self.data]
        edge = np.zeros(len(sep) + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.ones(len(sep) + 1, dtype=bool), np.ones(len(sep) + 1, dtype=bool)
        before[1:], after[:-1] = sep, sep
        self.start = np.flatnonzero(~after & (before | edge))
        self.end = np.flatnonzero(~before & (after | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        out = np.empty(len(self.start), dtype=U64)
        a = 0
        while a < len(out):  # a word's hash doesn't depend on where it stands
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + HASHED_BYTES, side="right")))
            base, top = int(self.start[a]), int(self.end[b - 1])
            up, down = _IN_WORD.upto(top - base)
            total = np.zeros(top - base + 1, dtype=U64)
            np.cumsum(_BYTE[self.data[base:top]] * up[: top - base], out=total[1:])
            start, end = self.start[a:b] - base, self.end[a:b] - base
            out[a:b] = mix64((total[end] - total[start]) * down[start] + (end - start).astype(U64))
            a = b
        return out

    def offsets_in_doc(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)


def windows(h: np.ndarray, n: int, check: bool = False) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes (``check``: an independent one)."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    up, down = (_IN_CHECK if check else _IN_WINDOW).upto(len(h))
    total = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum((h ^ (h >> U64(31)) if check else h) * up[: len(h)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text (a longer row is alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    at = 0
    cum = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


# ---------------------------------------------------------------- packing

_KINDS = [np.dtype(x) for x in ("<u8", "<i8", "<u4", "<i4", "u1", "<f4", "<f8")]


def pack(*columns: tuple[np.ndarray, bool]) -> bytes:
    """Arrays as one compressed value.  ``True`` marks slowly growing ones (stored as differences).

    Bytes of equal rank lie together, which is what lets the compressor drop the high ones.
    """
    out = []
    for a, rising in columns:
        kind, a = _KINDS.index(a.dtype), np.ascontiguousarray(a)
        if rising and len(a):
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
            if a.dtype == np.int64:
                a = (a << 1) ^ (a >> 63)
        out += [struct.pack("<BBI", kind, rising, len(a)), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, rising, n = struct.unpack_from("<BBI", raw, at)
        at += 6
        dtype = _KINDS[kind]
        a = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)
        at += n * dtype.itemsize
        if rising and n:
            if dtype == np.int64:
                a = (a.view(U64) >> U64(1)).view(np.int64) ^ -(a & 1)
            a = np.cumsum(a, dtype=dtype)
        out.append(a)
    return out


def unpack_all(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    parts = [unpack(b.as_py()) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in their order) for each bucket present."""
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    for k, idx in zip(keys, np.split(order, first[1:]), strict=True):
        yield int(k), idx


def run_starts(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """First index of each run of equal values in sorted arrays."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    change = a[1:] != a[:-1]
    for b in more:
        change |= b[1:] != b[:-1]
    return np.flatnonzero(np.concatenate([[True], change]))
