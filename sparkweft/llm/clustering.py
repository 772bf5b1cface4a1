"""Centroid clustering of integer vectors by Hamerly's bounds, exact to the last unit.

Each vector keeps its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of the distance to the
second nearest. When centroids have moved, the upper bound grows by the own centroid's drift and the lower one falls by the
largest drift of the others; while the upper one is below the lower one (or below half the way to the next centroid) nothing
can have changed. Vectors of which that can't be said get their own distance first, and if that is not enough a scan over all
centroids in whole numbers. Bounds are rounded outwards, so they never decide what whole numbers would decide otherwise.

Vectors never move: the state of each round is one table in the shared folder, made from the one before by a narrow pass;
what meets is one partial sum for each task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import forget, shared_table

#: Components below this are exact in doubles, with all sums over DIMS of their squares; below LARGEST in 64-bit integers.
EXACT_DOUBLE, LARGEST = 1 << 22, 1 << 27
#: By which bounds are rounded outwards: far more than a few operations on doubles lose.
SLACK = 1e-12

STATE = "vec_id long, vec array<int>, cluster int, upper double, lower double, scanned boolean"


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<int>): floor(scale * x) of the vectors with dims components, none null or non-finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component is {LARGEST} or more after scaling: squared distances would not fit 64 bits")
            flat = pa.array(x.astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dims), pa.int32()), flat)], names=["vec_id", "vec"])

    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size(v) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    return kept.mapInArrow(run, "vec_id long, vec array<int>")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where every result stays exact, else as 64-bit integers."""
    small = all(not a.size or max(int(a.max()), -int(a.min())) < EXACT_DOUBLE for a in arrays)
    return [a.astype(np.float64 if small else np.int64) for a in arrays]


def reassign(x: np.ndarray, c: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray | None):
    """(cluster, upper, lower, scanned) after the centroids moved by drift; without drift every vector is scanned."""
    x, c = exact(x, c)
    todo = np.arange(len(x))
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    if drift is not None:
        between = np.sqrt(squared(c, c).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        most = np.argmax(drift)
        others = np.where(np.arange(len(c)) == most, np.delete(drift, most).max(initial=0.0), drift[most])[cluster]
        upper = (upper + drift[cluster]) * (1 + SLACK)
        lower = np.where(np.isinf(lower), lower, lower - others - SLACK * (lower + others))
        safe = np.maximum(lower, 0.5 * between.min(1)[cluster] * (1 - SLACK))
        todo = np.flatnonzero(~(upper < safe))
        own = x[todo] - c[cluster[todo]]
        upper[todo] = np.sqrt((own * own).sum(1).astype(np.float64)) * (1 + SLACK)
        todo = todo[~(upper[todo] < safe[todo])]
    scanned = np.zeros(len(x), bool)
    scanned[todo] = True
    for at in range(0, len(todo), 4096):
        some = todo[at : at + 4096]
        d = squared(x[some], c)
        best = d.argmin(1)  # the first of equal ones
        cluster[some], upper[some] = best, np.sqrt(d[np.arange(len(some)), best].astype(np.float64)) * (1 + SLACK)
        lower[some] = np.sqrt(np.partition(d, 1, 1)[:, 1].astype(np.float64)) * (1 - SLACK) if len(c) > 1 else np.inf
    return cluster, upper, lower, scanned


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assign(centroids: np.ndarray, drift: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, centroids.shape[1])
            n = len(x)
            old = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("cluster", "upper", "lower")] if drift is not None else [np.zeros(n, np.int32), np.zeros(n), np.zeros(n)]
            cluster, upper, lower, scanned = reassign(x, centroids, *old, drift)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned)],
                names=["vec_id", "vec", "cluster", "upper", "lower", "scanned"],
            )

    return run


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}  # one entry for each cluster
        for batch in batches:
            x, cluster = _matrix(batch, dims), batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, at, count = np.unique(cluster[order], return_index=True, return_counts=True)
            if len(found):
                for k, n, s in zip(found.tolist(), count.tolist(), np.add.reduceat(x[order], at), strict=True):
                    old = total.setdefault(k, [0, np.zeros(dims, np.int64)])
                    old[0] += n
                    old[1] += s
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s for _, s in total.values()], pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return run


def move_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty cluster's componentwise floor of sum over count; empty ones keep their centroid."""
    dims = centroids.shape[1]
    partial = state.select("vec", "cluster").mapInArrow(_sums(dims), "cluster int, n long, sums array<long>")
    whole = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for row in whole.collect():  # one row for each cluster
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return out


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            own = _matrix(batch, centroids.shape[1]) - centroids[cluster]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array((own * own).sum(1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest lower-case hex sha256 of seed:vec_id; of one id, the smaller vector first; null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["vec"] for r in vectors.orderBy(digest.asc_nulls_last(), "vec").limit(k).collect()], np.int64)


def cluster_rounds(vectors: DataFrame, k: int, rounds: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(state after the last assignment, final centroids)."""
    centroids = first_centroids(vectors, k, seed)
    state, drift = vectors, None
    for _ in range(rounds):
        after = shared_table(state.mapInArrow(_assign(centroids, drift), STATE), "state")
        moved = move_centroids(after, centroids)
        way = (moved - centroids).astype(np.float64)
        drift, centroids = np.sqrt((way * way).sum(1)) * (1 + SLACK), moved
        if state is not vectors:
            forget(state)
        state = after
    return shared_table(state.mapInArrow(_assign(centroids, drift), STATE), "state"), centroids


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that has dims components, none
    null or non-finite, after the given rounds and one more assignment.

    Other vectors, and null ones, are not in the result. Ties go to the smaller cluster number. Vectors that repeat, with
    one id or several, are each a row; a null id stays null and starts no centroid while others are there. With fewer than k vectors there are
    fewer clusters, and an empty table gives an empty one. Other columns are ignored. A component of 2^27 or more after
    scaling raises, as distances would not fit a long.
    """
    whole = shared_table(whole_vectors(vectors, dims, scale, id_col, vec_col), "vectors")
    if whole.isEmpty():
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    state, centroids = cluster_rounds(whole, k, rounds, seed)
    near = shared_table(state.select("vec_id", "vec", "cluster").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), "distances")
    forget(state)
    forget(whole)
    inertia = {r["cluster"]: int(r["s"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row for each cluster
    about = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in inertia]
    names = near.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
