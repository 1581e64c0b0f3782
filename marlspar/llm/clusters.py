"""Centroid clustering of integer vectors with Hamerly bounds.

Every vector keeps an upper bound of the distance to its own centroid and one lower bound of the distance to the
second nearest. When centroids move, the upper bound grows by the drift of its own centroid and the lower bound
shrinks by the largest drift of the others. A vector whose upper bound lies strictly below its lower bound, or below half the
distance from its centroid to the next one, keeps its centroid without a scan; otherwise the upper bound is made exact,
and if that is not enough, all centroids are compared in integers. Bounds are rounded outwards, so that a skipped scan
could not have changed anything, ties included.

Each round is one pass that writes the state (vector, centroid, bounds) to the shared folder and one partial sum
a component over it; the driver sees the centroids only.

Cases: rows with another number of components, with null or non-finite components or a null vector are left out; repeated rows are
vectors of their own; a null vec_id is clustered, but never starts a centroid; with fewer vectors than centroids there
are as many centroids as vectors with an id; no such vector gives no rows; columns beyond the id and the vector are not carried.
Components whose integer lies beyond 2**27 raise an error, as squared distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, prepare, stored

#: Integers beyond this could give squared distances beyond 64 bits for 64 components.
LIMIT = 1 << 27
#: Vectors of one vectorised step.
STEP = 4096
STATE = "vec_id long, q array<int>, cluster int, upper double, lower double"


def quantised(vectors: DataFrame, components: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q): the vectors that are kept, each component x as floor(scale * x)."""
    x = F.col("x")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = x.isNotNull() & (F.size(x) == components) & F.coalesce(whole, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(good)
    scaled = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    held = F.when(F.exists(x, lambda v: F.abs(v) * scale >= LIMIT), F.raise_error(F.lit(f"a component is beyond {LIMIT // scale}"))).otherwise(scaled)
    return rows.select("vec_id", held.cast("array<int>").alias("q"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of q to rows of c (one to one) or to one vector."""
    d = q - c
    return np.einsum("ij,ij->i", d, d)


def up(x):
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def down(x):
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def separation(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to its nearest other one, rounded down; 0 where two are equal."""
    out = np.full(len(centroids), np.inf)
    for j, c in enumerate(centroids):
        others = squared(np.delete(centroids, j, 0), c)
        if len(others):
            out[j] = down(np.sqrt(others.min().astype(float)) / 2)
    return out


def scan(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), its squared distance, and that of the second."""
    best = np.zeros(len(q), np.int32)
    near = squared(q, centroids[0])
    second = np.full(len(q), np.iinfo(np.int64).max)
    for j in range(1, len(centroids)):
        d = squared(q, centroids[j])
        closer = d < near
        second = np.where(closer, near, np.minimum(second, d))
        near = np.where(closer, d, near)
        best[closer] = j
    return best, near, second


def bounded(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> int:
    """Brings cluster and bounds up to date in place; the number of vectors that needed a scan."""
    limit = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero(~(upper < limit))
    if len(open_):
        exact = up(np.sqrt(squared(q[open_], centroids[cluster[open_]]).astype(float)))
        upper[open_] = exact
        open_ = open_[~(exact < limit[open_])]
    for lo in range(0, len(open_), STEP):
        at = open_[lo : lo + STEP]
        best, near, second = scan(q[at], centroids)
        cluster[at], upper[at] = best, up(np.sqrt(near.astype(float)))
        lower[at] = np.where(second == np.iinfo(np.int64).max, np.inf, down(np.sqrt(second.astype(float))))
    return len(open_)


def _column(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.array(batch.column(name).to_numpy(zero_copy_only=False), kind)


def _vectors(batch: pa.RecordBatch, components: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int64)


def assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The state after one assignment; without drift, of vectors that have no bounds yet."""
    half = separation(centroids)
    far = None if drift is None else np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(drift))])
    components = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _vectors(batch, components)
            if drift is None:
                cluster, upper, lower = np.zeros(len(q), np.int32), np.full(len(q), np.inf), np.zeros(len(q))
            else:
                cluster = _column(batch, "cluster", np.int32)
                upper, lower = up(_column(batch, "upper", float) + drift[cluster]), down(_column(batch, "lower", float) - far[cluster])
            bounded(q, cluster, upper, lower, centroids, half)
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(cluster), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "q", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors summed by component, floor of the exact mean; those without vectors stay."""
    n = centroids.shape[1]
    sums = [F.sum(F.get("q", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(n)]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(n)]
    return out


def _literal(values: list, kind: str) -> Column:
    """The value of a row's centroid, from a list with one entry for each centroid."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, components: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    import hashlib

    spark = vectors.sparkSession
    prepare(spark)
    rows = quantised(vectors, components, scale, id_col, vector_col)
    centroids, drift = starts(rows, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = rows
    for turn in range(rounds + 1):
        before, state = state, stored(assigned(state, centroids, drift), "clusters")
        if turn:
            dropped(before)
        if turn < rounds:
            after = moved(state, centroids)
            drift = np.where((after == centroids).all(1), 0.0, up(np.sqrt(squared(after, centroids).astype(float))))
            centroids = after
    near = F.array(*[F.array(*[F.lit(int(v)) for v in c]).cast("array<long>") for c in centroids])
    gap = F.zip_with(F.col("q"), F.get(near, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    measured = state.select("vec_id", "cluster", F.aggregate(gap, F.lit(0).cast("long"), lambda s, v: s + v).alias("distance"))
    inertia = [0] * len(centroids)
    for r in measured.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():
        inertia[r["cluster"]] = r["d"]
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return measured.select(
        "vec_id", "cluster", "distance", _literal(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), _literal(sha, "string").alias("centroid_sha256")
    )
