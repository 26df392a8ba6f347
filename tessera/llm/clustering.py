"""Clustering around centroids in whole numbers, each vector's nearest found in an annulus of norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import run_starts, staged, tidy

#: Squared distances stay below this, so that they are exact in 64 bits.
MOST_DISTANCE = 1 << 62


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``v`` its nearest centroid, ties to the smaller number, and the squared distance (int64).

    Norms differ by no more than points do.  So with a bound on the distance, here that to
    the centroid of the most similar norm, only centroids whose norm lies in an annulus
    around the vector's can be nearest.  They are sorted by norm and cut out by binary
    search, wider by more than the rounding of the norms, and compared in whole numbers.
    """
    norm = np.sqrt((centroids * centroids).sum(1).astype(np.float64))
    order = np.argsort(norm, kind="stable")
    norm = norm[order]
    own = np.sqrt((v * v).sum(1).astype(np.float64))
    right = np.searchsorted(norm, own).clip(0, len(norm) - 1)
    left = (right - 1).clip(0)
    guess = np.where(np.abs(own - norm[left]) <= np.abs(own - norm[right]), left, right)
    best = order[guess]
    distance = ((v - centroids[best]) ** 2).sum(1)
    reach = np.sqrt(distance.astype(np.float64))
    slack = 1e-9 * (own + reach) + 1e-6
    low, high = np.searchsorted(norm, own - reach - slack, "left"), np.searchsorted(norm, own + reach + slack, "right")
    for j, c in enumerate(order):
        # What has been found so far narrows the annulus further.
        rows = np.flatnonzero((low <= j) & (j < high) & (np.abs(own - norm[j]) <= np.sqrt(distance.astype(np.float64)) + slack))
        d = ((v[rows] - centroids[c]) ** 2).sum(1)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[closer]], distance[rows[closer]] = c, d[closer]
    return best.astype(np.int64), distance


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per cluster and component (-1: the count) the sum over the vectors nearest to its centroid."""
    k, dims = centroids.shape

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            v = _matrix(batch, dims)
            best, _ = nearest(v, centroids)
            by = np.argsort(best, kind="stable")
            first = run_starts(best[by])
            if len(first):
                total[best[by][first]] += np.add.reduceat(v[by], first, axis=0)
                count += np.bincount(best, minlength=k)
        there = np.flatnonzero(count)
        values = np.concatenate([count[there, None], total[there]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, dims + 1)), pa.array(np.tile(np.arange(-1, dims), len(there))), pa.array(values.ravel())], ["cluster", "at", "part"])

    return rows.select("v").mapInArrow(run, "cluster bigint, at bigint, part bigint").groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))


def _assigned(rows: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    dims = centroids.shape[1]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_matrix(batch, dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {id_type}, cluster int, distance bigint")


def whole_vectors(vectors: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``: floor(scale * component), of the vectors with ``dims`` components, none null or non-finite."""
    bound = int(np.sqrt(MOST_DISTANCE / dims) / 2)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < bound, F.floor(y).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {bound / scale:g}: distances would not fit 64 bits")))

    kept = vectors.filter((F.size(vector_col) == dims) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).alias("id"), F.transform(vector_col, whole).alias("v"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: its id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``dims`` components, none null or non-finite (a null vector isn't),
    as whole numbers floor(scale * x).  A component so large that a squared distance might
    pass 64 bits raises an error.  The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``seed:id``; equal ids go by their vectors and null ids come last.
    Each round assigns all vectors and moves each centroid to its vectors' floored mean; one
    without vectors stays.  Ties go to the smaller number.  Repeated rows count as often as
    they stand; fewer than ``k`` vectors make as many centroids.  No vector kept gives an
    empty result.  Columns other than the two named are not read.

    The vectors are written once, as whole numbers, and read once a round.  A task folds
    its rows to sums of ``k * dims`` numbers before anything is shuffled, so a vector that
    a third of the rows share costs nothing extra; ``k * (dims + 1)`` sums reach the driver
    and ``k * dims`` numbers each task, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = staged(whole_vectors(vectors, dims, scale, id_col, vector_col), "whole-vectors")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(by_hash.asc_nulls_last(), "id", "v").limit(k).collect()
    columns = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        sums = {(r["cluster"], r["at"]): int(r["total"]) for r in _sums(rows, centroids).collect()}
        centroids = np.array([[sums[c, i] // sums[c, -1] for i in range(dims)] if (c, -1) in sums else centroids[c].tolist() for c in range(len(centroids))], dtype=np.int64)
    found = staged(_assigned(rows, centroids, id_type), "assigned-vectors")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *columns)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds written out one after the other."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {k})",
    ]
    nearest_of = (
        "a{r} AS MATERIALIZED (SELECT vec_id, x.v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := y.c)) AS n "
        "FROM (SELECT vec_id, v, row_number() OVER () AS i FROM kept) x, c{r} y GROUP BY i, vec_id, x.v)"
    )
    for r in range(rounds):
        parts += [
            nearest_of.format(r=r),
            f"s{r} AS (SELECT n.c AS c, i, sum(v[i]) AS s, count(*) AS m FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY n.c, i)",
            f"m{r} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) / m AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))",
        ]
    parts.append(nearest_of.format(r=rounds))
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f ON f.c = n.c
"""


SQL = _sql()
