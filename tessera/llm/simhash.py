"""SimHash near-duplicates through a Gray-ordered hierarchy of masked bit patterns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST_KEYS, U64, mix64, run_starts, slices, staged, tidy

LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
#: A node of the index with more fingerprints is divided by further masks.
NODE_ROWS = 4096
#: A node of at most so many fingerprints gives all its links, a larger one a spanning forest of them.
SMALL = 32
#: Children of a node of the tree that a task builds over one node's fingerprints.
FAN_OUT = 16
#: Pairs of tree nodes that are opened at once.
NODE_PAIRS = 4096
#: Shingles that one pass counts; the lanes hold 65,535.
PASS_SHINGLES = 60_000
#: Levels of masks, at most.
LEVELS = 6
#: Coordinated samples of a set, and min-wise shingles in each.
SAMPLES, SAMPLE_SHINGLES = 12, 5
#: Standard deviations by which the share of equal minima may fall short of the similarity that is sought.
SLACK = 3.5
#: Members of a bucket that one task holds on either side of a comparison, and bytes of their sets, about.
CHUNK, CHUNK_BYTES = 2048, 4 << 20
#: Ranges of hashes in which a set's shingles are counted, and the largest count.
RANGES, FULL = 64, 65_535


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each run of ``width`` words, joined by one space; fewer words: of them all."""
    words = text.translate(LOWER).split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a + 1 : b], seed) for a, b in zip(ends, ends[width:], strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: a bit is 1 if set in over half of them; of none: 0."""
    out = np.zeros(len(counts), dtype=U64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = np.concatenate([[0], np.cumsum(counts[some])])
    # Long documents are counted in parts, since a lane of 16 bits must not run over.
    parts = -(-counts[some] // PASS_SHINGLES)
    owner = np.repeat(np.arange(len(some)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = first[owner] + nth * PASS_SHINGLES
    own = np.cumsum(parts) - parts
    for k in range(16):
        lanes = np.add.reduceat((hashes >> U64(k)) & U64(0x0001000100010001), starts)
        for j in range(4):
            ones = np.add.reduceat((lanes >> U64(16 * j)) & U64(0xFFFF), own).astype(np.int64)
            out[some] |= (ones * 2 > counts[some]).astype(U64) << U64(k + 16 * j)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (64 bits as a bigint).  Null and wordless texts: 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [np.array(shingle_hashes((t.as_py() or "").encode(), shingle_words, seed), dtype=U64) for t in part.column(1)]
                fp = majority_bits(np.concatenate(found), np.array([len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


# ---------------------------------------------------------------- the index


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_mask(mask: int, parts: int) -> list[int]:
    """Divide the set bits of a mask, from the top, into ``parts`` masks of near equal weight."""
    bits = [i for i in range(63, -1, -1) if mask >> i & 1]
    return [sum(1 << i for i in bits[k * len(bits) // parts : (k + 1) * len(bits) // parts]) for k in range(parts)]


def masks_below(mask: int, radius: int) -> list[int]:
    """The masks one level further down: ``mask`` and one of radius + 1 parts of the bits it leaves open.

    Fingerprints that agree under ``mask`` and differ in at most ``radius`` bits agree
    under at least one of these as well, so a node may be replaced by its parts.
    """
    return [mask | part for part in split_mask(~mask & (1 << 64) - 1, radius + 1)]


def gray_rank(c: Column) -> Column:
    """The place of a fingerprint in the Gray sequence (shifts fold its bits together)."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def tree_chunks(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``radius`` among fingerprints in Gray order, some at a time.

    Runs of neighbours are factored into nodes: the bits on which a run agrees, and their
    values.  Two nodes are compared on the bits that both have fixed; the differences found
    there hold for all their members, so a pair of nodes over the radius is dropped whole.
    """
    levels = [(np.full(len(fps), U64(0xFFFFFFFFFFFFFFFF)), fps)]
    while len(levels[-1][0]) > FAN_OUT:
        shared, pattern = levels[-1]
        starts = np.arange(0, len(shared), FAN_OUT)
        lead = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
        shared = np.bitwise_and.reduceat(shared, starts) & ~np.bitwise_or.reduceat(pattern ^ lead, starts)
        levels.append((shared, pattern[starts] & shared))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN_OUT), np.arange(FAN_OUT), indexing="ij"))

    def descend(depth: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        shared, pattern = levels[depth]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b]) <= radius
        a, b = a[near], b[near]
        if not depth:
            yield a[a < b], b[a < b]
            return
        below = len(levels[depth - 1][0])
        for k in range(0, len(a), NODE_PAIRS):  # so that memory stays bounded where little can be pruned
            x = (a[k : k + NODE_PAIRS, None] * FAN_OUT + i).ravel()
            y = (b[k : k + NODE_PAIRS, None] * FAN_OUT + j).ravel()
            good = (x <= y) & (y < below)
            yield from descend(depth - 1, x[good], y[good])

    yield from descend(len(levels) - 1, *np.triu_indices(len(levels[-1][0])))


def spanning_links(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which links a minimum spanning forest keeps: at most n - 1, and at every distance as connected as all of them.

    Each component takes its shortest link outwards, until none has one.
    """
    label, kept = np.arange(n), np.zeros(len(a), dtype=bool)
    order = np.lexsort((b, a, distance))
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.arange(len(a))
    open_ = np.arange(len(a))
    while len(open_):
        open_ = open_[label[a[open_]] != label[b[open_]]]
        best = np.full(n, len(a), dtype=np.int64)
        np.minimum.at(best, label[a[open_]], place[open_])
        np.minimum.at(best, label[b[open_]], place[open_])
        new = order[np.unique(best[best < len(a)])]
        kept[new] = True
        label = forest(n, a[kept], b[kept])
    return kept


def streamed_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, left_out): links that connect fingerprints in Gray order as all their links do, and which have others besides.

    The pairs come in chunks and each chunk is thinned at once, so what is held is bounded
    by the fingerprints and one chunk.
    """
    n = len(fps)
    label, left_out = np.arange(n), np.zeros(n, dtype=bool)
    kept_x, kept_y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x, y in tree_chunks(fps, radius):
        a, b = label[x], label[y]
        kept = np.zeros(len(x), dtype=bool)
        apart = np.flatnonzero(a != b)
        if len(apart):
            kept[apart] = spanning_links(n, a[apart], b[apart], np.bitwise_count(fps[x[apart]] ^ fps[y[apart]]))
            kept_x, kept_y = np.concatenate([kept_x, x[kept]]), np.concatenate([kept_y, y[kept]])
            label = forest(n, kept_x, kept_y)
        left_out[x[~kept]] = True
        left_out[y[~kept]] = True
    return kept_x, kept_y, left_out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _whole_nodes(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[list[np.ndarray]]:
    """The columns of batches, dealt anew so that no node is cut: rows alike in the first ``keys`` columns stay together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_bytes_array(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
        last = run_starts(*cols[:keys])
        cut = int(last[-1]) if len(last) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held and len(held[0]):
        yield held


def _bytes_array(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as one array of raw items."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=f"V{len(values[0])}")


def _node_links(radius: int):
    """Rows (mask, value, fp), a node's together and in Gray order -> (mask, value, u, v): the links that hold each node's links together.

    A row without v is a fingerprint u of which the node has links that were left out.
    """

    def emit(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = run_starts(mask, value)
        size = np.diff(np.append(starts, len(fp)))
        u, v, of = [], [], []
        node = np.repeat(np.arange(len(starts)), size)
        rows = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        for step in range(1, SMALL):  # small nodes: all pairs
            rows = rows[rows + step < len(fp)]
            rows = rows[node[rows] == node[rows + step]]
            if not len(rows):
                break
            near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius]
            u.append(fp[near + step])
            v.append(fp[near])
            of.append(starts[node[near]])
        left_out, left_of = [], []
        for k in np.flatnonzero(size > SMALL):
            members = fp[starts[k] : starts[k] + size[k]]
            x, y, others = streamed_forest(members, radius)
            u.append(members[y])
            v.append(members[x])
            of.append(np.full(len(x), starts[k]))
            left_out.append(members[others])
            left_of.append(np.full(int(others.sum()), starts[k]))
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        of, left_of = flat(of, np.int64), flat(left_of, np.int64)
        at = np.concatenate([of, left_of])
        u = np.concatenate([flat(u, U64), flat(left_out, U64)]).view(np.int64)
        v = np.concatenate([flat(v, U64).view(np.int64), np.zeros(len(left_of), np.int64)])
        none = np.arange(len(v)) >= len(of)
        return pa.RecordBatch.from_arrays([pa.array(mask[at]), pa.array(value[at]), pa.array(u), pa.array(v, mask=none)], names=["mask", "value", "u", "v"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, fp in _whole_nodes(batches):
            yield emit(mask, value, fp.view(U64))

    return run


def _open_links(radius: int):
    """Rows (mask, value, fp, lo, hi), a node's together and in Gray order -> (u, v): all its links but those within one component."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, fp, lo, hi in _whole_nodes(batches):
            starts = run_starts(mask, value)
            for a, b in zip(starts, np.append(starts[1:], len(fp)), strict=True):
                low, high, own = lo[a:b], hi[a:b], fp[a:b]
                if low.min() == high.max():
                    continue
                for x, y in tree_chunks(own.view(U64), radius):
                    apart = np.minimum(low[x], low[y]) < np.maximum(high[x], high[y])
                    if apart.any():
                        yield pa.RecordBatch.from_arrays([pa.array(own[y[apart]]), pa.array(own[x[apart]])], names=["u", "v"])

    return run


def index_rows(fps: DataFrame, radius: int) -> DataFrame:
    """(mask, value, u, v), see ``_node_links``: links (u, v) that connect the distinct fingerprints in ``fps`` exactly as all links of at most ``radius`` bits do.

    Upper nodes are masked bit patterns that a group of fingerprints shares.  Under a node,
    fingerprints lie in Gray order and a tree of shared bits is descended.  A node with
    more than NODE_ROWS members gives way to nodes of longer masks, which replicate its
    rows radius + 1 times; no links are lost on the way (see ``masks_below``).
    """
    spark = fps.sparkSession
    level, found = masks_below(0, radius), []
    nodes = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in level))).alias("mask"))
    for depth in range(LEVELS):
        nodes = nodes.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        last = depth == LEVELS - 1 or any(64 - m.bit_count() <= radius + 1 for m in level)
        sizes = nodes.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {NODE_ROWS}")
        heavy = None if last else staged(sizes.select("mask", "value"), "heavy-nodes")
        deeper = heavy is not None and not heavy.isEmpty()
        light = nodes.join(heavy, ["mask", "value"], "left_anti") if deeper else nodes
        ordered = light.withColumn("rank", gray_rank(F.col("fp"))).repartition("mask", "value").sortWithinPartitions("mask", "value", "rank")
        found.append(ordered.select("mask", "value", "fp").mapInArrow(_node_links(radius), "mask bigint, value bigint, u bigint, v bigint"))
        if not deeper:
            break
        below = F.lit(None)
        longer: list[int] = []
        for m in level:
            below = F.when(F.col("mask") == F.lit(_signed(m)), F.array(*(F.lit(_signed(x)) for x in masks_below(m, radius)))).otherwise(below)
            longer += masks_below(m, radius)
        nodes = staged(nodes.join(heavy, ["mask", "value"], "left_semi").select("fp", F.explode(below).alias("mask")), "divided-nodes")
        level = sorted(set(longer))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return staged(links, "simhash-links")


def index_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """The links (u, v) of ``index_rows``."""
    return index_rows(fps, radius).filter("v IS NOT NULL").select("u", "v")


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest node it reaches.

    Alternates large-star and small-star: each node's neighbours are tied to the smallest
    of them.  Only minima move, so a hub's rows are folded before the shuffle.  Each round
    is written to the shared folder.
    """

    def minimum(directed: DataFrame) -> DataFrame:
        return directed.groupBy("a").agg(F.min("b").alias("m"))

    def size(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = size(edges)
    while before[0]:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
        large = both.join(minimum(both), "a").filter("b > a").select(F.col("b").alias("u"), F.least("a", "m").alias("v")).distinct()
        large = staged(large, "large-star")
        down = large.select(F.col("u").alias("a"), F.col("v").alias("b"))
        low = minimum(down)
        small = down.join(low, "a").filter("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).union(low.select("a", "m")).distinct()
        edges = staged(small, "small-star")
        after = size(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


# ---------------------------------------------------------------- verified links


def _permutations(n: int) -> list[tuple[np.uint64, np.uint64]]:
    """(salt, odd factor) of ``n`` fixed bijections of 64-bit hashes."""
    rng = np.random.default_rng(20240517)
    drawn = rng.integers(0, 1 << 63, (n, 2), dtype=np.int64).view(U64) << U64(1)
    return [(salt, factor | U64(1)) for salt, factor in drawn]


def sample_prints(hashes: np.ndarray, counts: np.ndarray, samples: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of ``samples`` coordinated samples of each set, and a sketch: a byte of each min-wise shingle.

    A sample is the ``each`` shingles that come first under as many fixed orders, so two
    sets at similarity s have the same sample with probability s ** each, whatever the
    sets' sizes.  A set without shingles has zeros.
    """
    some = np.flatnonzero(counts)
    mins = np.zeros((len(counts), samples * each), dtype=U64)
    if len(some) and samples:
        starts = np.concatenate([[0], np.cumsum(counts[some])])[:-1]
        for j, (salt, factor) in enumerate(_permutations(samples * each)):
            mins[some, j] = np.minimum.reduceat((hashes ^ salt) * factor, starts)
        mins[some] = mix64(mins[some])
    prints = majority_bits(mins.ravel(), np.full(len(counts) * samples, each)).reshape(len(counts), samples)
    return prints, (mins & U64(0xFF)).astype(np.uint8)


def least_agreement(similarity: float, places: int) -> int:
    """Places of two sketches that must be equal: what the similarity asks for, less SLACK standard deviations."""
    return max(0, int(np.ceil(places * similarity - SLACK * np.sqrt(places * similarity * (1 - similarity)))))


def range_counts(shingles: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of RANGES ranges of the hash; FULL stands for FULL or more.

    The sum of the smaller counts of two sets bounds what they share from above.
    """
    shift = U64(64 - (RANGES - 1).bit_length())
    return np.minimum(np.bincount((shingles >> shift).astype(np.int64), minlength=RANGES), FULL).astype(np.uint16).tobytes()


def may_be_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of range counts don't rule out a Jaccard similarity of at least ``similarity``."""
    both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    total = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
    return (both >= similarity * (total - both)) | (x == FULL).any(axis=1) | (y == FULL).any(axis=1)


def _set_of(text: pa.Scalar, width: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes((text.as_py() or "").encode(), width, seed), dtype=U64))


def _digest(shingles: np.ndarray, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes(), seed)


def set_prints(docs: DataFrame, width: int, seed: int, samples: int, each: int) -> DataFrame:
    """(id, key, fp, prints, sketch, ranges, size): a digest of each text's distinct shingles, their SimHash, ``sample_prints``, ``range_counts`` and number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_set_of(t, width, seed) for t in part.column(1)]
                hashes, counts = np.concatenate(found), np.array([len(x) for x in found])
                prints, sketch = sample_prints(hashes, counts, samples, each)
                columns = [pa.array([_digest(x, seed) for x in found], pa.binary()), pa.array(majority_bits(hashes, counts).view(np.int64)), pa.array(list(prints.view(np.int64)), pa.list_(pa.int64())), pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array([range_counts(x) for x in found], pa.binary()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "key", "fp", "prints", "sketch", "ranges", "size"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, key binary, fp bigint, prints array<bigint>, sketch binary, ranges binary, size bigint")


def shingle_sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, key, shingles, ranges): the distinct shingle hashes of each text, sorted, as bytes; their digest and ``range_counts``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [_set_of(t, width, seed) for t in part.column(1)]
                columns = [part.column(0), *(pa.array([f(x) for x in sets], pa.binary()) for f in (lambda x: _digest(x, seed), np.ndarray.tobytes, range_counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "shingles", "ranges"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, key binary, shingles binary, ranges binary")


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with their group's row.  Groups with a large share of the rows are joined by broadcast.

    A row may lie in SAMPLES groups, so at most 1024 * SAMPLES groups are large.
    """
    large = F.col(size) >= max(1000, total >> 10)
    common, rare = groups.filter(large), groups.filter(~large)
    return rows.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(rare, keys).unionByName(rows.join(F.broadcast(common), keys))


def index_pairs(classes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of class names (``node``) that the index of whole fingerprints links first; and its rows.

    Classes of one fingerprint are tied to the smallest of them, which stands for it in the
    index.  ``open_index_pairs`` has the others.
    """
    own = classes.select("fp", "node")
    first = staged(own.groupBy("fp").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("k")), "fingerprint-names")
    index = index_rows(first.select("fp"), radius)
    links = index.filter("v IS NOT NULL").select("u", "v").distinct()
    tied = _beside(own, first.filter("k > 1"), ["fp"], "k", own.count()).select(F.col("node").alias("a"), F.col("name").alias("b"))
    named = links.join(first.select(F.col("fp").alias("u"), F.col("name").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("name").alias("b")), "v")
    pairs = tied.unionByName(named.select("a", "b")).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), index


def open_index_pairs(classes: DataFrame, index: DataFrame, radius: int) -> DataFrame | None:
    """All pairs (a, b), a < b, of class names within ``radius`` bits whose classes are in different components."""
    own = classes.select("fp", "node", F.col("component_id").alias("c"))
    spans = staged(own.groupBy("fp").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")), "component-spans")
    left_out = index.filter("v IS NULL").select("mask", "value", F.col("u").alias("fp")).join(spans.drop("k"), "fp").withColumn("rank", gray_rank(F.col("fp")))
    ordered = left_out.repartition("mask", "value").sortWithinPartitions("mask", "value", "rank")
    links = ordered.select("mask", "value", "fp", "lo", "hi").mapInArrow(_open_links(radius), "u bigint, v bigint")
    # A fingerprint of several classes: among themselves, and with those of the fingerprints it was linked to.
    several = staged(spans.filter("k > 1").select("fp"), "shared-fingerprints")
    linked = index.filter("v IS NOT NULL").select("u", "v")
    links = links.unionByName(spans.filter("lo < hi").select(F.col("fp").alias("u"), F.col("fp").alias("v")))
    for end in ("u", "v"):
        links = links.unionByName(linked.join(several, F.col(end) == F.col("fp"), "left_semi"))
    links = staged(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "open-links")
    if links.isEmpty():
        return None
    x, y = (own.select(*(F.col(c).alias(f"{c}_{end}") for c in own.columns)) for end in ("u", "v"))
    pairs = links.join(x, F.col("u") == F.col("fp_u")).join(y, (F.col("v") == F.col("fp_v")) & (F.col("c_u") != F.col("c_v")) & ((F.col("u") != F.col("v")) | (F.col("node_u") < F.col("node_v"))))
    return pairs.select(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b"))


def sample_members(classes: DataFrame) -> tuple[DataFrame, int]:
    """(t, print, node, name, k): the classes of each bucket, the smallest of them and how many there are; and all classes' count.

    A bucket is a sample's fingerprint that several classes have.
    """
    members = classes.select("node", F.posexplode("prints").alias("t", "print"))
    buckets = staged(members.groupBy("t", "print").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "sample-buckets")
    total = classes.count()
    return staged(_beside(members, buckets, ["t", "print"], "k", total), "bucket-members"), total


def _likely(rows: tuple[np.ndarray, ...], label: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of a probe and a base row of a cell with different labels whose sketches agree and whose ranges don't rule them out, some probes at a time.

    ``rows``: probe, node, plain, sketch, ranges.  Labels may change between two blocks.
    """
    probe, node, plain, raw, counted = rows
    places = raw.dtype.itemsize
    sketch = raw.view(np.uint8).reshape(-1, places)
    ranges = counted.view(np.uint16).reshape(-1, RANGES)
    least = least_agreement(similarity, places)
    asks, base = np.flatnonzero(probe), np.flatnonzero(~probe)
    across = np.ascontiguousarray(sketch[base].T)
    for k in range(0, len(asks), 64):
        some = asks[k : k + 64]
        # A pair of two probes comes from either side; one of them counts.
        good = (label[some][:, None] != label[base][None, :]) & (plain[base][None, :] | (node[some][:, None] < node[base][None, :]))
        if not good.any():
            continue
        equal = np.zeros(good.shape, dtype=np.uint16)
        for j in range(places):
            equal += sketch[some, j][:, None] == across[j][None, :]
        x, y = np.nonzero(good & (equal >= least))
        x, y = some[x], base[y]
        good = np.zeros(len(x), dtype=bool)
        for j in range(0, len(x), 8192):
            good[j : j + 8192] = may_be_similar(ranges[x[j : j + 8192]], ranges[y[j : j + 8192]], similarity)
        yield x[good], y[good]


def _with_partners(similarity: float):
    """Rows (cell, probe, node, c, plain, sketch, ranges), a cell's together -> those that are in a likely pair of their cell."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, probe, node, c, plain, sketch, ranges in _whole_nodes(batches, 1):
            some = np.zeros(len(cell), dtype=bool)
            starts = run_starts(cell)
            for lo, hi in zip(starts, np.append(starts[1:], len(cell)), strict=True):
                for x, y in _likely(tuple(col[lo:hi] for col in (probe, node, plain, sketch, ranges)), c[lo:hi], similarity):
                    some[lo + x] = some[lo + y] = True
            if some.any():
                columns = [pa.array(x[some].tolist(), pa.binary()) if x.dtype.kind == "V" else pa.array(x[some]) for x in (cell, probe, node, c, plain, sketch, ranges)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "probe", "node", "c", "plain", "sketch", "ranges"])

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches dealt anew: one for each run of equal values in the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column(0).to_numpy()
        starts = run_starts(cell)
        for lo, hi in zip(starts, np.append(starts[1:], len(cell)), strict=True):
            if held and held[0].column(0)[0].as_py() != cell[lo]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def _cell_links(similarity: float):
    """Rows (cell, probe, node, c, plain, sketch, ranges, shingles), a cell's together -> (u, v): links that connect its components as all its likely pairs of at least ``similarity`` do.

    A pair that the cell's links have connected isn't verified, so a cell gives fewer links
    than it has rows.  Sets are compared by numbers that the cell gives its shingles: a
    probe marks its own, and its partners' marks are counted.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            probe, node, c, plain = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            label = c.copy()
            sets = batch.column(7).to_pylist()
            size = np.array([len(x) >> 3 for x in sets])
            known, number = np.unique(np.frombuffer(b"".join(sets), U64), return_inverse=True)
            del sets
            number, first = number.astype(np.int32), np.concatenate([[0], np.cumsum(size)])
            marked, u, v = np.zeros(len(known), dtype=bool), [], []
            for x, y in _likely((probe, node, plain, _bytes_array(batch.column(5)), _bytes_array(batch.column(6))), label, similarity):
                for a in run_starts(x):
                    i = x[a]
                    others = y[a : a + int(np.searchsorted(x[a:], i, side="right"))]
                    others = others[label[others] != label[i]]
                    if not len(others):
                        continue
                    own = number[first[i] : first[i + 1]]
                    marked[own] = True
                    shared = np.concatenate([[0], np.cumsum(marked[np.concatenate([number[first[j] : first[j + 1]] for j in others])])])
                    marked[own] = False
                    both = np.diff(shared[np.concatenate([[0], np.cumsum(size[others])])])
                    for j in others[both >= similarity * (size[i] + size[others] - both)]:
                        if label[j] != label[i]:
                            u.append(node[i])
                            v.append(node[j])
                            label[label == label[j]] = label[i]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def open_sample_links(classes: DataFrame, members: DataFrame, total: int, names: DataFrame | None, docs: DataFrame, width: int, seed: int, similarity: float) -> DataFrame | None:
    """Links (u, v) that connect components as all pairs of one bucket do whose sketches agree, whose range counts don't rule them out and whose texts have at least ``similarity``.

    A bucket's rows of its commonest component needn't meet each other; only the others
    are compared, with all rows.  Both sides are cut into chunks, and a cell of one chunk
    of each is what a task holds, however large the bucket.  The first pass leaves the rows
    that have a partner in a cell; these come together again with their sets, and pairs are
    verified where they are found.  So no pair is written: a bucket's pairs may be as many as
    the square of its rows, but it gives fewer links than its cells have rows.
    """
    placed = members.select("t", "print", "node").join(classes.select("node", F.col("component_id").alias("c"), "size"), "node")
    shares = placed.groupBy("t", "print", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    buckets = shares.groupBy("t", "print").agg(F.sum("n").alias("k"), F.sum("w").alias("weight"), F.max("n").alias("most"), F.max_by("c", F.struct("n", "c")).alias("major"), F.max_by("w", F.struct("n", "c")).alias("most_weight"), F.count(F.lit(1)).alias("parts"))
    buckets = staged(buckets.filter("parts > 1").drop("parts"), "open-buckets")
    if buckets.isEmpty():
        return None
    # Written: a join may not rest on a union's partitioning, since a part of it may be dealt anew while it runs.
    rows = staged(_beside(placed.drop("size"), buckets, ["t", "print"], "k", total), "placed-rows").join(classes.select("node", "sketch", "ranges"), "node")
    chunks = lambda n, weight: F.ceil(F.greatest(n / CHUNK, weight * 8 / CHUNK_BYTES)).cast("int")
    rows = rows.withColumn("ways", chunks(F.col("k"), F.col("weight"))).withColumn("probe_ways", chunks(F.col("k") - F.col("most"), F.col("weight") - F.col("most_weight")))
    mine = lambda ways: F.pmod(F.xxhash64("node"), F.col(ways)).cast("int")
    every = lambda ways: F.explode(F.sequence(F.lit(0), F.col(ways) - 1))
    out = ["t", "print", "x", "y", "probe", "node", "c", (F.col("c") == F.col("major")).alias("plain"), "sketch", "ranges"]
    base = rows.withColumn("x", mine("ways")).withColumn("y", every("probe_ways")).withColumn("probe", F.lit(False)).select(*out)
    probes = rows.filter("c <> major").withColumn("x", every("ways")).withColumn("y", mine("probe_ways")).withColumn("probe", F.lit(True)).select(*out)
    cells = base.unionByName(probes).withColumn("cell", F.xxhash64("t", "print", "x", "y")).select("cell", "probe", "node", "c", "plain", "sketch", "ranges")
    together = lambda cells: cells.repartition("cell").sortWithinPartitions("cell")
    cells = staged(together(cells).mapInArrow(_with_partners(similarity), cells.schema), "cells-with-partners")
    if cells.isEmpty():
        return None
    asked = staged(cells.select(F.col("node").alias("id")).distinct(), "asked")
    sets = class_sets(asked, names, docs, width, seed).select(F.col("id").alias("node"), "shingles")
    return staged(together(cells.join(sets, "node").select(*cells.columns, "shingles")).mapInArrow(_cell_links(similarity), "u bigint, v bigint").distinct(), "sample-links")


def class_sets(asked: DataFrame, names: DataFrame | None, docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, shingles, ranges): the sets of the classes in ``asked`` (id), which is written; ``names``: see ``verified``."""
    few = asked.count() <= MOST_BROADCAST_KEYS
    own = docs.join(F.broadcast(asked.select("id")) if few else asked, "id", "left_semi")
    sets = shingle_sets(own, width, seed)
    if names is not None:
        sets = sets.join(names, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return sets.drop("key")


def verified(pairs: DataFrame, names: DataFrame | None, docs: DataFrame, width: int, seed: int, similarity: float) -> DataFrame:
    """Links (u, v): the pairs whose texts have a Jaccard similarity of at least ``similarity`` over distinct shingles.

    ``names``: (id, key) of the classes; None if no two rows of ``docs`` share an id, which
    saves bringing whole sets together by id and digest.  Range counts rule out most pairs of unlike texts
    before whole sets are brought together.  A class in very many pairs has its set dealt
    out in copies, so that none of them meets all its pairs.
    """
    asked = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs")), "asked")
    least = max(1000, (asked.agg(F.sum("pairs")).first()[0] or 0) >> 10)
    hot = asked.filter(F.col("pairs") >= least).select("id", F.ceil(F.col("pairs") / least).cast("int").alias("ways"))  # 1024 rows at most
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("ways"), F.lit(1)) - 1))
    sets = staged(class_sets(asked, names, docs, width, seed).join(F.broadcast(hot), "id", "left").withColumn("copy", copies).drop("ways"), "shingle-sets")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    @tidy
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, RANGES) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(may_be_similar(x, y, similarity)))

    def beside(pairs: DataFrame, what: str) -> DataFrame:
        for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
            pairs = pairs.join(F.broadcast(hot.select(F.col("id").alias(end), "ways")), end, "left")
            pairs = pairs.withColumn("copy", F.coalesce(F.pmod(F.xxhash64(other), F.col("ways")).cast("int"), F.lit(0))).drop("ways")
            pairs = pairs.join(sets.select(F.col("id").alias(end), "copy", F.col(what).alias(name)), [end, "copy"]).drop("copy")
        return pairs.select("a", "b", "x", "y")

    both = beside(staged(beside(pairs, "ranges").mapInArrow(possible, "a bigint, b bigint"), "possible-pairs"), "shingles")
    return staged(both.select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(run, "u bigint, v bigint").distinct(), "verified-links")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, radius: int = 3, samples: int = SAMPLES, each: int = SAMPLE_SHINGLES, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """Link documents whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Two kinds of SimHash give candidates.  The whole set's fingerprint goes through the
    Gray-ordered index, which finds every pair within ``radius`` bits.  It can't reach far:
    at 0.8 two fingerprints differ in 9.7 bits of 64 on average, and an index of so large a
    radius has short masks, whose nodes grow with the corpus.  So the sets' coordinated
    samples are fingerprinted too (see ``sample_prints``) and sought at equality: a pair at
    similarity s shares one of them with probability 1 - (1 - s ** each) ** samples (0.8:
    0.992), at a cost in proportion to the rows.  Of those, pairs whose sketches fall short
    of the similarity by more than SLACK standard deviations are no candidates.

    Every candidate is verified on its whole texts.  The first to be tried tie each bucket
    or node together by few pairs, so a large group of copies costs links in proportion to
    its size.  Then come all other candidates whose ends the verified links have not
    connected: a link that failed hides no other.  A bucket's are verified where its rows
    meet and leave as the links that connect them (see ``open_sample_links``).

    ``unique`` promises that no two rows share an id, which saves a shuffle of sets.

    Returns one row per input row: id, fp (of the whole set), component_id (smallest id
    reachable by links, the document's own included).  Texts with equal sets, wordless and
    null ones among them, are linked.  A null id has no component unless a document of an
    equal set has an id.  Repeated rows are in one component.  Of rows that share an id
    each is judged by its own text.  Very long texts are read whole, a slice's worth at a
    time.  An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    prints = staged(set_prints(own, shingle_words, seed, samples, each), "set-prints")
    # Copies meet here: from now on a set is one row, named by its smallest id.
    firsts = [F.first(c).alias(c) for c in ("fp", "prints", "sketch", "ranges", "size")]
    classes = staged(prints.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), *firsts), "shingle-classes")
    named = classes.filter("node IS NOT NULL")
    names = None if unique else named.select(F.col("node").alias("id"), "key")
    tried, index = index_pairs(named, radius)
    if samples:
        members, total = sample_members(named)
        tried = tried.unionByName(members.filter("node <> name").select(F.col("name").alias("a"), F.col("node").alias("b"))).distinct()
    tried = staged(tried, "first-pairs")
    links = verified(tried, names, own, shingle_words, seed, similarity)
    rooted = lambda links: components(links).select("node", F.col("root").alias("component_id"))
    roots = rooted(links)
    so_far = staged(named.drop("n").join(roots, "node", "left").withColumn("component_id", F.coalesce("component_id", "node")), "components-so-far")
    more = []
    if (near := open_index_pairs(so_far, index, radius)) is not None:
        others = staged(near.distinct().join(tried, ["a", "b"], "left_anti"), "other-pairs")
        if not others.isEmpty():
            more.append(verified(others, names, own, shingle_words, seed, similarity))
    if samples:
        more.append(open_sample_links(so_far, members, total, names, own, shingle_words, seed, similarity))
    more = [m for m in more if m is not None and not m.isEmpty()]
    if more:
        for new in more:
            links = links.unionByName(new)
        roots = rooted(links)
    tied = staged(classes.select("key", "n", "node").join(roots, "node", "left").select("key", "n", F.coalesce("component_id", "node").alias("component_id")), "tied-classes")
    return _spread(prints.select("id", "key", "fp"), tied, "key").select(F.col("id").alias(id_col), "fp", "component_id")


def _spread(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Rows with their class's component_id.  A class of very many rows is joined by broadcast; there are at most 1024 of them."""
    least = max(1000, rows.count() >> 10)
    common, rare = classes.filter(F.col("n") >= least).select(key, "component_id"), classes.filter(F.col("n") < least).select(key, "component_id")
    usual = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(rare, key)
    return usual.unionByName(rows.join(F.broadcast(common), key))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """Link documents whose fingerprints differ in at most ``radius`` bits.

    With ``similarity``, links also need that Jaccard similarity (see ``similar_documents``,
    here without samples).

    Returns one row per input row: id, fp, component_id (smallest id reachable by links,
    the document's own included).  Null and wordless texts have fingerprint 0 and are
    linked like any other.  A null id takes part but is never a component's id unless all
    of its component's ids are null.  Repeated rows are in one component.  Very long texts
    are read whole, a slice's worth at a time.  An empty table gives an empty result.
    """
    if similarity is not None:
        return similar_documents(docs, similarity, shingle_words, radius, 0, 1, seed, id_col, text_col)
    prints = staged(fingerprints(docs, shingle_words, seed, id_col, text_col), "fingerprints")
    # Exact copies meet here: from now on a fingerprint is one row however many documents have it.
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(index_links(distinct.select("fp"), radius))
    tied = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tied = staged(tied, "rooted")
    # Components of one fingerprint need no second look.
    linked = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("root", "component_id")
    classes = tied.join(linked, "root", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return _spread(prints, staged(classes, "classes"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
