"""Centroid clustering of integer vectors with Elkan's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import drop_scratch, scratch_path

#: Components of a vector.
DIMENSIONS = 64
#: A component x becomes floor(SCALE * x).
SCALE = 64
#: Integer components up to this fit 64-bit arithmetic; batches with larger ones use Python's integers.
SMALL = 1 << 27
#: Beyond this a squared distance does not fit a long.
LARGEST = 1 << 32


def _exact(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in 64-bit integers, or in Python's where squares could overflow."""
    most = max(int(np.abs(vectors).max(initial=0)), max((abs(x) for c in centroids for x in c), default=0))
    kind = np.int64 if most <= SMALL else object
    return vectors.astype(kind), np.array(centroids, kind).reshape(len(centroids), vectors.shape[1])


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((v - c) ** 2).sum(axis=1)


def _below(x) -> np.ndarray:
    """A lower bound of the root of exact integers: float error stays far under the margin."""
    return np.sqrt(np.asarray(x, float)) * (1 - 1e-12)


def _above(x) -> np.ndarray:
    return np.sqrt(np.asarray(x, float)) * (1 + 1e-12)


def first_assignment(vectors: np.ndarray, centroids: list[list[int]]):
    """Nearest centroid (ties: the smaller number) by all distances: (cluster, upper bounds, lower bounds for each centroid, distances worked out)."""
    v, c = _exact(vectors, centroids)
    d = np.stack([_squared(v, x) for x in c], axis=1)
    at = d.argmin(axis=1)
    return at, _above(d[np.arange(len(v)), at]), _below(d), np.full(len(v), len(c), np.int64)


def next_assignment(vectors: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: list[list[int]], new: list[list[int]]):
    """Nearest of the centroids ``new`` from the bounds against ``old``, with as few distances as Elkan's two tests allow.

    Upper bounds grow and lower bounds shrink by how far each centroid moved. A centroid j is out for a vector where the upper
    bound is *strictly* below the lower bound of j, or strictly below half the distance from its centroid to j: then j is
    farther, never equally near. Bounds are rounded away from each other by more than floating point errs, and every comparison that
    decides is between exact integers, so ties go to the smaller number as in a comparison with all centroids.
    """
    v, c = _exact(vectors, new)
    _, c_old = _exact(vectors, old)
    if c.dtype != c_old.dtype:
        c, c_old, v = c.astype(object), c_old.astype(object), v.astype(object)
    k = len(c)
    moved = _above(_squared(c, c_old))
    upper = (upper + moved[at]) * (1 + 1e-12)
    lower = np.maximum(lower - moved, 0) * (1 - 1e-12)
    half = np.stack([_below(_squared(c, x)) for x in c], axis=1) / 2
    at, count = at.copy(), np.zeros(len(v), np.int64)
    out = lambda rows: (upper[rows, None] < lower[rows]) | (upper[rows, None] < half[at[rows]]) | (at[rows, None] == np.arange(k))
    open_rows = np.flatnonzero(~out(np.arange(len(v))).all(axis=1))
    best = np.zeros(len(v), v.dtype)
    best[open_rows] = _squared(v[open_rows], c[at[open_rows]])
    count[open_rows] += 1
    upper[open_rows] = _above(best[open_rows])
    lower[open_rows, at[open_rows]] = _below(best[open_rows])
    for j in range(k):
        rows = open_rows[(at[open_rows] != j) & ~((upper[open_rows] < lower[open_rows, j]) | (upper[open_rows] < half[at[open_rows], j]))]
        if not len(rows):
            continue
        d = _squared(v[rows], c[j])
        count[rows] += 1
        lower[rows, j] = _below(d)
        nearer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
        rows, d = rows[nearer], d[nearer]
        at[rows], best[rows], upper[rows] = j, d, _above(d)
    return at, upper, lower, count


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(len(column), width) if len(column) else np.zeros((0, width), np.int64)


def _means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids moved to the exact floor of their vectors' mean; those without vectors stay. Each task sends one sum a cluster."""
    k, width = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), object)
        for rows in batches:
            v, at = _matrix(rows["vector"], width), rows["cluster"].to_numpy()
            n += np.bincount(at, minlength=k)
            for j in np.unique(at):
                total[j] += v[at == j].sum(axis=0).astype(object)
        yield pd.DataFrame({"cluster": np.arange(k), "n": n, "total": [[str(x) for x in t] for t in total]})

    parts = state.select("cluster", "vector").mapInPandas(sums, "cluster int, n long, total array<string>")
    summed = parts.select("cluster", "n", F.posexplode("total").alias("dim", "part")).groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for r in summed.where("n > 0").collect():  # k * width rows
        out[r.cluster][r.dim] = int(r.total) // r.n
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, *, id_col: str = "vec_id", vector_col: str = "embedding",
    dimensions: int = DIMENSIONS, scale: int = SCALE,
) -> DataFrame:
    """Clusters of integer vectors by ``rounds`` of moving centroids and a last assignment, exact in every distance.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite (nor infinite once multiplied); a component x
    counts as floor(scale * x). The first centroids are the k kept vectors with the smallest SHA-256 of "1:<id>" (a null id
    as "1:null"; equal hashes by components), or all of them where there are fewer. Each vector keeps an upper bound
    to its centroid and a lower bound to each of the k others from round to round (``next_assignment``).
    Sums travel as one row a task and cluster; only k * dimensions of them reach the driver. The state of a round is
    written to the shared folder and the one before is dropped. A component beyond +-2^32 is an error: squared distances would not fit a long.

    Returns ``id_col``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_distances (distances that were worked
    out for the vector, of (rounds + 1) * k without bounds). One row per kept row; no kept vectors give no rows.
    """
    spark = vectors.sparkSession
    x = lambda e: F.floor(scale * e.cast("double"))
    whole = F.forall(F.col(vector_col), lambda e: F.coalesce(F.abs(scale * e.cast("double")) < float("inf"), F.lit(False)))
    kept = vectors.where(F.coalesce((F.size(vector_col) == dimensions) & whole, F.lit(False))).select(
        F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda e: F.when(x(e).between(-LARGEST, LARGEST), x(e).cast("long")).otherwise(
            F.raise_error(F.lit("a vector's component is beyond 2^32")).cast("long"))).alias("vector"))
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    centroids = [list(r.vector) for r in kept.orderBy(mark, "vector").limit(k).collect()]
    k = len(centroids)
    schema = f"id {dict(kept.dtypes)['id']}, vector array<bigint>, cluster int, upper double, lower array<double>, n_distances long"
    names = ["id", "vector", "cluster", "upper", "lower", "n_distances"]
    if not k:
        return vectors.limit(0).select(F.col(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("n_distances", "long"))))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                at, upper, lower, n = first_assignment(_matrix(rows["vector"], dimensions), centroids)
                yield pd.DataFrame(dict(zip(names, (rows["id"], rows["vector"], at, upper, list(lower), n), strict=True)))

    def moved(old: list[list[int]], new: list[list[int]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    at, upper, lower, n = next_assignment(
                        _matrix(rows["vector"], dimensions), rows["cluster"].to_numpy(), rows["upper"].to_numpy().copy(), _matrix(rows["lower"], k).copy(), old, new)
                    yield pd.DataFrame(dict(zip(names, (rows["id"], rows["vector"], at, upper, list(lower), n + rows["n_distances"].to_numpy()), strict=True)))

        return run

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, "clusters")
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, state = written(kept.mapInPandas(first, schema))
    for _ in range(rounds):
        new = _means(state, centroids)
        before = path
        path, state = written(state.mapInPandas(moved(centroids, new), schema))
        drop_scratch(spark, before)
        centroids = new

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                v, c = _exact(_matrix(rows["vector"], dimensions), centroids)
                yield pd.DataFrame({"id": rows["id"], "cluster": rows["cluster"], "distance": _squared(v, c[rows["cluster"].to_numpy()]).astype(np.int64), "n_distances": rows["n_distances"]})

    found = state.select("id", "vector", "cluster", "n_distances").mapInPandas(distances, f"id {dict(kept.dtypes)['id']}, cluster int, distance long, n_distances long")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(j, sums.get(j, 0), total, names[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")
