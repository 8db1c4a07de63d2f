"""Centroid clustering with Ptolemaic pivots.

Vectors become whole numbers. A few pivots, spread far apart among the first centroids, stay fixed;
every vector's distances to them are computed once and kept beside it. In a round, Ptolemy's
inequality over each pair of pivots p, s bounds the distance of a vector x and a centroid c from
below, |d(x,p) d(c,s) - d(x,s) d(c,p)| / d(p,s), from kept distances alone. Bounds are rounded down
by more than floating point can err; centroids whose bound does not exceed the best distance found
are checked exactly, so assignments are those of an exhaustive search.

Only sums and counts per centroid leave the tasks; centroids, as many as asked for, are all that
the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C

SCALE = 64
WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
PIVOTS = 5
LARGEST = 1 << 27       # whole numbers beyond it stop there, so that squared distances fit 64 bits
SLACK = 2.0 ** -45      # relative; far above what a dozen roundings of 2^-53 can add up to
ROWS_AT_ONCE = 4_096


def whole_numbers(embedding: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null, has not
    ``width`` components, or holds null or non-finite ones."""
    good = (F.size(embedding) == width) & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = F.lit(LARGEST).cast("bigint")
    return F.when(good, F.transform(embedding, lambda x: F.greatest(-edge, F.least(edge, F.floor(
        F.lit(float(scale)) * x.cast("double")).cast("bigint")))))


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, a bounded number."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", key.alias("key")).orderBy(
        F.asc_nulls_last("key"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one vector."""
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart)


def spread_pivots(centroids: np.ndarray, pivots: int) -> np.ndarray:
    """Up to ``pivots`` different centroids, each the farthest from those before it."""
    chosen = [0]
    nearest = squared(centroids, centroids[0])
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(centroids, centroids[chosen[-1]]))
    return centroids[chosen]


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(v, p) for p in pivots], 1).astype(np.float64))


def lower_bounds(d_rows: np.ndarray, d_centroids: np.ndarray, d_pivots: np.ndarray) -> np.ndarray:
    """(rows, centroids): squared distances are at least this, from distances to pivots."""
    out = np.zeros((len(d_rows), len(d_centroids)))
    for p in range(d_pivots.shape[0]):
        for s in range(p):
            one = d_rows[:, p, None] * d_centroids[None, :, s]
            two = d_rows[:, s, None] * d_centroids[None, :, p]
            apart = np.abs(one - two) - SLACK * (one + two)
            np.maximum(out, apart / (d_pivots[p, s] * (1 + SLACK)), out=out)
    return out * out * (1 - SLACK)


def nearest(v: np.ndarray, d_rows: np.ndarray, centroids: np.ndarray,
            pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, exact checks made) per row; ties go to the smaller number."""
    bounds = lower_bounds(d_rows, to_pivots(centroids, pivots), to_pivots(pivots, pivots))
    cluster = bounds.argmin(1)
    apart = v - centroids[cluster]
    best = np.einsum("ij,ij->i", apart, apart)
    checks = np.ones(len(v), np.int64)
    guess = cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bounds[:, c] <= best) & (guess != c))
        exact = squared(v[rows], centroids[c])
        checks[rows] += 1
        won = (exact < best[rows]) | ((exact == best[rows]) & (c < cluster[rows]))
        best[rows[won]], cluster[rows[won]] = exact[won], c
    return cluster, best, checks


def _unpacked(batch: pd.DataFrame, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for lo in range(0, len(batch), ROWS_AT_ONCE):
        part = slice(lo, min(lo + ROWS_AT_ONCE, len(batch)))
        v = np.frombuffer(b"".join(batch["v"].iloc[part]), "<i4").astype(np.int64).reshape(-1, width)
        d = np.frombuffer(b"".join(batch["d"].iloc[part]), "<f8").reshape(len(v), -1)
        yield part, v, d


def with_pivot_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v and d: the vector and its distances to the pivots, as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["vec_id"].astype("Int64")
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                v = np.array(batch["v"].iloc[lo:lo + ROWS_AT_ONCE].tolist(), np.int64)
                d = to_pivots(v, pivots).astype("<f8")
                yield pd.DataFrame({"vec_id": ids.iloc[lo:lo + ROWS_AT_ONCE].array,
                                    "v": [x.tobytes() for x in v.astype("<i4")],
                                    "d": [x.tobytes() for x in d]})

    return rows.select("vec_id", "v").mapInPandas(run, "vec_id bigint, v binary, d binary")


def moved(kept: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids as the exact floors of their vectors' means; empty ones stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, v, d in _unpacked(batch, width):
                cluster, _, _ = nearest(v, d, centroids, pivots)
                np.add.at(total, cluster, v)
                count += np.bincount(cluster, minlength=k)
        filled = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": np.repeat(filled, width),
                            "dim": np.tile(np.arange(width), len(filled)),
                            "total": total[filled].ravel(), "n": np.repeat(count[filled], width)})

    sums = kept.select("v", "d").mapInPandas(
        run, "cluster int, dim int, total bigint, n bigint").groupBy("cluster", "dim").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, and how many exact distances it took."""
    width = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [nearest(v, d, centroids, pivots) for _, v, d in _unpacked(batch, width)]
            if found:
                cluster, distance, checks = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64").array,
                                    "cluster": cluster.astype("int32"), "distance": distance,
                                    "checks": checks})

    return kept.mapInPandas(run, "vec_id bigint, cluster int, distance bigint, checks bigint")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            scale: int = SCALE, width: int = WIDTH, seed: str = SEED,
            pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, checks, cluster_inertia, inertia, centroid_sha256 per vector.

    Vectors that are null, have another number of components, or hold null or non-finite ones take
    no part. Rows without a vec_id do, but start a cluster only if too few others can. Repeated rows
    count one by one; rows of one vec_id rank by their vectors. Fewer vectors than clusters start
    one cluster each. Whole numbers stop at +-2^27. No vectors give no rows."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", whole_numbers(F.col("embedding"), scale, width).alias("v")
                          ).filter("v IS NOT NULL")
    centroids = first_centroids(rows, clusters, seed)
    schema = ("vec_id bigint, cluster int, distance bigint, checks bigint, cluster_inertia bigint, "
              "inertia bigint, centroid_sha256 string")
    if not len(centroids):
        return spark.createDataFrame([], schema)
    fixed = spread_pivots(centroids, pivots)
    kept = C.written(with_pivot_distances(rows, fixed))
    for _ in range(rounds):
        centroids = moved(kept, centroids, fixed)
    found = C.written(assigned(kept, centroids, fixed))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(
        F.sum("distance").alias("d")).collect()}
    return found.join(F.broadcast(_summary(spark, centroids, inertia)), "cluster").select(
        "vec_id", "cluster", "distance", "checks", "cluster_inertia", "inertia", "centroid_sha256")


def _summary(spark: SparkSession, centroids: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """One row per filled cluster."""
    total = sum(inertia.values())
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    return spark.createDataFrame(
        [(c, d, total, sha(c)) for c, d in sorted(inertia.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
