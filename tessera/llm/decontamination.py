"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, _IS_SEP, mix64, slices, tidy, windows

#: Words are runs of anything but white space and ASCII punctuation, A-Z lower-cased.
_SEPARATORS = _IS_SEP.copy()
_SEPARATORS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of 64 that still make a candidate; the blocks find every fingerprint within it.
RADIUS, BLOCKS, BLOCK_BITS = 11, 4, 16
#: Independent fingerprints of each window.
TABLES = 2
#: Window sizes rise by this factor; an item is looked for with the largest size it holds, at each of its offsets.
STEP, LEAST_WORDS = 1.15, 6
#: Words by which a candidate's place may be off.
SHIFT = 3
#: Words of a slice that are fingerprinted at once, at least.
RANGE_WORDS = 100_000
#: Bytes of text that are searched at once.
SEARCHED_BYTES = 1 << 20
#: Bytes of benchmark text that are broadcast at once; a larger benchmark goes in blocks, one after another.
BENCHMARK_BYTES = 2 << 20


def window_size(words: int) -> int:
    """The largest window size that an item of so many words holds."""
    size = LEAST_WORDS
    while (larger := max(int(size * STEP), size + 1)) <= words:
        size = larger
    return size


def lane_bits(n: int) -> int:
    """The narrowest counters that hold ``n``."""
    return 8 if n < 1 << 8 else 16 if n < 1 << 16 else 32


def _lanes(bits: int, at: int = 0) -> np.uint64:
    return U64(sum(1 << (k + at) for k in range(0, 64, bits)))


def lane_sums(shingles: np.ndarray, bits: int = 8) -> list[np.ndarray]:
    """Running counts of set bits: ``bits`` arrays, each with 64 / ``bits`` counters to a word.

    Differences of the sums are exact as long as a window's counters don't run over.
    """
    out = []
    for k in range(bits):
        total = np.zeros(len(shingles) + 1, dtype=U64)
        np.cumsum((shingles >> U64(k)) & _lanes(bits), out=total[1:])
        out.append(total)
    return out


def window_prints(sums: list[np.ndarray], n: int) -> np.ndarray:
    """The SimHash of each run of ``n`` shingles: a bit is 1 if set in over half of them."""
    bits = len(sums)
    out = np.zeros(max(0, len(sums[0]) - n), dtype=U64)
    part = np.empty_like(out)
    lift, top = U64(((1 << (bits - 1)) - 1 - n // 2) * int(_lanes(bits))), _lanes(bits, bits - 1)
    for k, total in enumerate(sums):
        np.subtract(total[n:], total[:-n], out=part)
        part += lift
        part &= top  # a counter's highest bit is now the majority
        part >>= U64(bits - 1 - k)
        out |= part
    return out


class BlockIndex:
    """Fingerprints by block: each block's table lists those whose block is within the radius' share of bits.

    A fingerprint within RADIUS bits of another has a block that differs in at most
    RADIUS // BLOCKS bits, so the tables miss none.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint32)
        near = values[np.bitwise_count(values) <= RADIUS // BLOCKS]
        self.tables = []
        for b in range(BLOCKS):
            own = ((prints >> U64(BLOCK_BITS * b)) & U64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            value, ref = (own[:, None] ^ near[None, :]).ravel(), np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)
            self.tables.append((first, np.diff(first) > 0, ref[order]))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, reference) of every pair within RADIUS; a pair may come once per block."""
        found = []
        blocks = prints.astype("<u8").view("<u2").reshape(-1, BLOCKS)
        for b, (first, some, refs) in enumerate(self.tables):
            at = np.flatnonzero(some[blocks[:, b]])
            value = blocks[at, b].astype(np.int32)
            n = first[value + 1] - first[value]
            idx = np.repeat(at, n)
            ref = refs[np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(len(idx))]
            near = np.bitwise_count(prints[idx] ^ self.prints[ref]) <= RADIUS
            found.append((idx[near], ref[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _again(shingles: np.ndarray, table: int) -> np.ndarray:
    """The shingles' hashes for a further table, independent of the first one's."""
    return mix64(shingles ^ U64(table * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if table else shingles


class Benchmark:
    """The items of one block of the benchmark, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str]):
        words = Words(pa.array(texts, pa.string()), lower=True, separators=_SEPARATORS)
        h = words.hashes()
        self.ids, self.size, self.bags = ids, words.count, []
        found: dict[int, list] = {}
        #: Items too short for a window: (words, hash, second hash) -> items.
        self.short: dict[int, dict[tuple[int, int], list[int]]] = {}
        vocabulary = [np.zeros(0, dtype=U64)]
        for i in range(len(ids)):
            own = h[words.first[i] : words.first[i + 1]]
            shingles = windows(own, SHINGLE)
            self.bags.append(np.unique(shingles, return_counts=True))
            vocabulary.append(shingles)
            if len(own) >= LEAST_WORDS:
                size = window_size(len(own))
                prints = [window_prints(lane_sums(_again(shingles, t), lane_bits(size)), size - SHINGLE + 1) for t in range(TABLES)]
                found.setdefault(size, []).append((prints, np.full(len(prints[0]), i), np.arange(len(prints[0]))))
            elif len(own):
                key = (int(windows(own, len(own))[0]), int(windows(own, len(own), check=True)[0]))
                self.short.setdefault(len(own), {}).setdefault(key, []).append(i)
        #: size -> (an index of each table's fingerprints, their items, their offsets in the item)
        self.classes = {}
        for size, parts in sorted(found.items()):
            indexes = [BlockIndex(np.concatenate([p[0][t] for p in parts])) for t in range(TABLES)]
            self.classes[size] = (indexes, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        known = np.unique(np.concatenate(vocabulary))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(known >> U64(44)).astype(np.int64)] = True

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Weighted Jaccard: shingles weigh as often as they occur."""
        own, count = self.bags[item]
        found, times = np.unique(shingles, return_counts=True)
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        both = np.minimum(times, count[at])[own[at] == found].sum()
        return float(both) / float(count.sum() + len(shingles) - both)

    def _short_leaks(self, words: Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first word) where an item of fewer than LEAST_WORDS words stands word for word."""
        for size, items in self.short.items():
            key = windows(h, size)
            if not len(key):
                continue
            own = np.array([k for k, _ in items], dtype=U64)
            at = np.flatnonzero(np.isin(key, own) & (words.doc[: len(key)] == words.doc[size - 1 :]))
            check = windows(h, size, check=True)
            for k in at:
                for item in items.get((int(key[k]), int(check[k])), ()):
                    yield int(words.doc[k]), item, int(k)

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, word after the last) for each row and item at SIMILARITY or more."""
        words = Words(texts, lower=True, separators=_SEPARATORS)
        h = words.hashes()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for row, item, a in self._short_leaks(words, h):
            best.setdefault((row, item), (1.0, a, a + int(self.size[item])))
        shingles = windows(h, SHINGLE)
        if len(shingles) and self.classes:
            done: set[tuple[int, int, int]] = set()
            for start, item, at in self._places(words, shingles):
                row = int(words.doc[at])
                self._verify(best, done, row, item, start, int(words.first[row]), int(words.first[row + 1]), shingles)
        for (row, item), (s, a, b) in sorted(best.items()):
            yield row, item, s, a - int(words.first[row]), b - int(words.first[row])

    def _places(self, words: Words, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(where the item would start, item, a word within): the places at which some window is near one of an item's."""
        left = np.repeat(words.first[1:], words.count) - np.arange(len(words.start))  # words from here to the document's end
        known = np.concatenate([[0], np.cumsum(self.seen[(shingles >> U64(44)).astype(np.int64)])])
        places: set[tuple[int, int, int]] = set()
        longest = max(self.classes)
        step = max(RANGE_WORDS, 4 * longest)
        for table in range(TABLES):
            hashes = _again(shingles, table)
            for base in range(0, len(shingles), step):
                part = hashes[base : base + step + longest]
                sums: dict[int, list[np.ndarray]] = {}
                for size, (indexes, owner, offset) in self.classes.items():
                    bits = lane_bits(size)
                    if bits not in sums:
                        sums[bits] = lane_sums(part, bits)
                    prints = window_prints(sums[bits], size - SHINGLE + 1)[:step]
                    fits = left[base : base + len(prints)] >= size
                    at, ref = indexes[table].within(prints)
                    at, ref = at[fits[at]], ref[fits[at]]
                    item, start = owner[ref], at + base - offset[ref]
                    # First step of the check: no more shingles can be shared than occur anywhere in the benchmark.
                    n = self.size[item] - SHINGLE + 1
                    lo, hi = np.clip(start - SHIFT, 0, len(shingles)), np.clip(start + n + SHIFT, 0, len(shingles))
                    likely = known[hi] - known[lo] >= SIMILARITY * n
                    places.update(zip(start[likely].tolist(), item[likely].tolist(), (at[likely] + base).tolist(), strict=True))
        return sorted(places)

    def _verify(self, best: dict, done: set, row: int, item: int, start: int, first: int, last: int, shingles: np.ndarray) -> None:
        """Judge an item's passage near ``start``, in the row of words ``first`` to ``last``."""
        for shift in range(-SHIFT, SHIFT + 1):
            a = max(first, start + shift)
            b = min(last, start + shift + int(self.size[item]))
            if b - a < SHINGLE or (item, a, b) in done:
                continue
            done.add((item, a, b))
            s = self.similarity(item, shingles[a : b - SHINGLE + 1])
            if s >= SIMILARITY and ((row, item) not in best or (s, -a) > (best[row, item][0], -best[row, item][1])):
                best[row, item] = (s, a, b)


_READY: dict[str, Benchmark] = {}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[str, list, list[str]]]:
    """(name, ids, texts) of the benchmark's blocks, each of about BENCHMARK_BYTES; equal rows once."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BENCHMARK_BYTES))
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        rows = sorted({(r["item_id"], r["text"]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield hashlib.sha256(repr(rows).encode()).hexdigest(), [r[0] for r in rows], [r[1] for r in rows]


def _ready(name: str, shared) -> Benchmark:
    """The block as this worker has it; one block is kept."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Benchmark(*shared.value)
    return _READY[name]


def leak_free(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows in which ``find_leaks`` finds nothing, with all their columns.

    Blocks of the benchmark filter one after another in the same pass; nothing is shuffled,
    and ids don't matter.
    """
    place = docs.columns.index(text_col)
    for name, ids, texts in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            ready = _ready(name, shared)
            for batch in batches:
                for piece in slices(batch, text_col, SEARCHED_BYTES):
                    good = np.ones(piece.num_rows, dtype=bool)
                    good[[f[0] for f in ready.leaks(piece.column(place))]] = False
                    yield piece.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Passages of documents that repeat a benchmark item at a similarity of 0.8 or more.

    Every window of an item's size, at every word of every document, has its SimHash over
    five-word shingles compared with the items' through block tables that guarantee all
    within RADIUS bits; there are TABLES independent fingerprints.  Candidates are verified
    by the exact weighted Jaccard similarity of shingles over the item's whole length.  An
    item too short for a window (fewer than LEAST_WORDS words) is found where its words
    stand in their order, at a similarity of 1.

    Returns one row per document and item: id, item id, similarity, start and end (words,
    end exclusive) of the best passage; of equally good ones the first.  Null and wordless
    texts hold nothing, null and wordless items are found nowhere.  Items with equal texts
    are each reported, and so are repeated documents.  Very long texts are searched whole.
    An empty table of either kind gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = None
    for name, item_ids, texts in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((item_ids, texts))

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            ready = _ready(name, shared)
            for batch in batches:
                for piece in slices(batch, "text", SEARCHED_BYTES):
                    found = list(ready.leaks(piece.column(1)))
                    ids = piece.column(0)
                    columns = [pa.array([ids[f[0]].as_py() for f in found], pa.int64()), pa.array([ready.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "similarity", "start", "end"])

        found = own.mapInArrow(run, "id bigint, item_id bigint, similarity double, start bigint, end bigint")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
