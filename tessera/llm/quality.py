"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, run_starts, slices, staged, tidy, windows

#: Labelled rows that the fit uses, about, whatever the size of the corpus.
MAX_LABELLED = 100_000
FEATURES, WIDTH, RIDGE, SEED = 384, 2.5, 1e-3, 11
#: Steps of the raw score between 0 and 1 in which calibration counts its rows.
STEPS = 400

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r", b".,;:'\"?-()", b"!", b"|", b"#$%&*+<=>@[]^_`{}~/\\", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _k
_CLASSES = 11
STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "newline", "other_space", "stop", "shout", "bar", "symbol", "high_byte",
    "word_length", "word_spread", "distinct_words", "top_word", "same_as_last", "distinct_fives", "short_words", "long_words", "symbol_ends", "words_per_line",
)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document and how often its commonest one occurs."""
    key = np.sort((doc.astype(U64) << U64(40)) | (h >> U64(24)))
    starts = run_starts(key)
    owner = (key[starts] >> U64(40)).astype(np.int64)
    size = np.diff(np.append(starts, len(key)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, size)
    return np.bincount(owner, minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, over the whole text."""
    words = Words(texts)
    n, sizes = len(texts), np.zeros(len(texts), dtype=np.int64)
    offsets = np.zeros(n + 1, dtype=np.int64)
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets[1:] = np.cumsum(lengths)
    sizes = np.diff(offsets)
    kind = _CLASS[words.data]
    kind += np.repeat(np.arange(n) * _CLASSES, sizes)
    counts = np.bincount(kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    share = counts / np.maximum(sizes, 1)[:, None]
    length = (words.end - words.start).astype(np.float64)
    many = np.maximum(words.count, 1)
    by_doc = lambda w: np.bincount(words.doc, weights=w, minlength=n)
    mean = by_doc(length) / many
    spread = np.sqrt(np.maximum(by_doc(length**2) / many - mean**2, 0))
    h = words.hashes()
    distinct, top = _distinct(words.doc, h, n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    fives = windows(h, 5)
    inside = words.doc[: len(fives)] == words.doc[4:] if len(fives) else np.zeros(0, dtype=bool)
    five_doc = words.doc[: len(fives)][inside]
    n_fives = np.bincount(five_doc, minlength=n)
    d_fives, _ = _distinct(five_doc, fives[inside], n)
    ends = _CLASS[words.data[words.end - 1]] if len(h) else np.zeros(0)
    return np.column_stack([
        np.log1p(sizes), np.log1p(words.count), share[:, 1], share[:, 2], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9], share[:, 10],
        mean, spread, distinct / many, top / many, by_doc(same) / many, d_fives / np.maximum(n_fives, 1), by_doc(length <= 3) / many, by_doc(length >= 12) / many, by_doc((ends == 9) | (ends == 7)) / many,
        np.log1p(words.count / (counts[:, 4] + 1)),
    ])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in rows.T)], names=["id", *STATISTICS])

    schema = "id bigint, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Kernel:
    """cos(Wx + b): the inner product of two such vectors is near a Gaussian kernel of their distance."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0.0, 1.0 / width, (len(mean), features))
        self.b = rng.uniform(0.0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2.0 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATISTICS])


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of zz' and zy: each partition adds up its own, the sums are added by row of the matrix."""

    @tidy
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z, y = kernel(_matrix(batch)), batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            part = np.column_stack([z.T @ z, z.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r.as_py()) for r in table.column("row")], axis=0)
        return pa.table([table.column("i")[:1], pa.array([total.tobytes()], pa.binary())], names=["i", "row"])

    schema = "i int, row binary"
    found = sorted(rows.select(*STATISTICS, "y").mapInArrow(own, schema).groupBy("i").applyInArrow(add, schema).collect(), key=lambda r: r["i"])
    whole = np.array([np.frombuffer(r["row"]) for r in found])
    return whole[:, :-1], whole[:, -1]


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising step function of ``x``, as knots to interpolate between."""
    blocks: list[list[float]] = []
    for a, n, g in zip(x, total, good, strict=True):
        blocks.append([a, a, n, g])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n2, g2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += n2
            blocks[-1][3] += g2
    xs, ys = [], []
    for lo, hi, n, g in blocks:
        p = (g + 0.5) / (n + 1.0)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def fold_of(id_: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")), F.lit(folds)).cast("int")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every whole text by how likely ``label_col`` is 1.

    Inputs are STATISTICS of the text alone.  Labels are read only of rows outside the held
    fold; one other fold calibrates, the rest fit.  At most about ``max_labelled`` labelled
    rows, chosen by a hash of the id, take part.

    Returns one row per input row: id, held_out, score (0 to 1).  Null and empty texts have
    the statistics of no words and are scored like any other.  Null labels are left out;
    several labels of one id are averaged.  With no labels every score is 0.5, with labels
    of one kind only it is their share.  A null id is never labelled.  Repeated rows are
    scored alike; labelled ones each count.  Equal raw scores get equal calibrated ones.
    Very long texts are measured whole.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = staged(with_statistics(docs, id_col, text_col), "statistics")
    fold = fold_of(F.col("id"), folds)
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(fold != held).groupBy("id").agg(F.avg("y").alias("y"))
    n = known.count()
    share = min(1.0, max_labelled / n) if n else 1.0
    known = known.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = staged(found.join(known, "id").withColumn("calibrates", fold == (held + 1) % folds), "labelled")
    moments = rows.agg(F.count(F.lit(1)), F.avg("y"), F.min("y"), F.max("y"), *(F.avg(s) for s in STATISTICS), *(F.stddev_pop(s) for s in STATISTICS)).first()
    count, mean_y, least, most = moments[:4]
    if not count or least == most:
        constant = 0.5 if not count else float(mean_y)
        return found.select(F.col("id").alias(id_col), (fold == held).alias("held_out"), F.lit(constant).alias("score"))
    mean, spread = np.array(moments[4 : 4 + len(STATISTICS)]), np.array(moments[4 + len(STATISTICS) :])
    kernel = Kernel(mean, np.maximum(spread, 1e-9))
    fitted = rows.filter("NOT calibrates")
    fitted = fitted if not fitted.isEmpty() else rows
    a, c = normal_equations(fitted, kernel)
    ridge = RIDGE * a[-1, -1] * np.eye(len(a))
    ridge[-1, -1] = 0.0
    weights = np.linalg.solve(a + ridge + 1e-9 * np.eye(len(a)), c)

    def scorer(xs: np.ndarray | None, ys: np.ndarray | None):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = np.clip(kernel(_matrix(batch)) @ weights, -0.5, 1.5)
                score = raw if xs is None else np.clip(np.interp(raw, xs, ys), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

        return run

    calibrating = rows.filter("calibrates")
    calibrating = calibrating if not calibrating.isEmpty() else rows
    raw = calibrating.select("id", *STATISTICS).mapInArrow(scorer(None, None), "id bigint, score double").join(known, "id")
    steps = raw.groupBy(F.round(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect()  # 2 * STEPS + 1 rows at most
    steps = sorted((r["step"] / STEPS, r["n"], r["good"]) for r in steps)
    xs, ys = isotonic(*(np.array(x, dtype=float) for x in zip(*steps, strict=True)))
    scored = found.select("id", *STATISTICS).mapInArrow(scorer(xs, ys), "id bigint, score double")
    return scored.select(F.col("id").alias(id_col), (fold == held).alias("held_out"), "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
