"""Centroid clustering by Yinyang grouping: exact rounds that compute few distances.

Centroids are gathered into groups once. A vector carries an upper bound on the distance to its own centroid and a lower bound for each
group on the distance to the group's other centroids. When centroids move, the bounds move by as much at most; a vector whose upper bound
is below all lower bounds stays (global filter), else only groups whose bound is not above it are looked at (group filter), and in them
only the centroids that their own move leaves in reach (local filter) are compared, exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Components are whole numbers up to this size, so that a squared distance of SIZE components is a long.
MOST, SIZE = 1 << 27, 64
#: Bounds are floats of exact squares: they are widened by this share, so that rounding never hides a tie.
SLACK = 1e-9
STATE = "vec_id long, f array<int>, was int, cluster int, distance long, low array<double>"


def whole(vectors: DataFrame, size: int = SIZE, steps: int = 64) -> DataFrame:
    """vec_id and f, the components as whole numbers floor(steps * x), of the vectors that have size finite components."""
    x = F.col("embedding").cast("array<double>")
    fit = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    part = lambda v: F.when(F.abs(v * steps) <= MOST, F.floor(v * steps).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances in a long")).cast("int"))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, part).alias("f"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows with the smallest SHA-256 of seed:vec_id (then by components), in that order; null vec_ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "f").orderBy(F.asc_nulls_last("key"), "f").limit(k).collect()
    return np.array([r["f"] for r in first], np.int64)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of plain clustering of the centroids themselves, from evenly spread ones."""
    groups = max(1, min(groups, len(centroids)))
    mid = centroids[np.linspace(0, len(centroids) - 1, groups).astype(int)].astype(float)
    for _ in range(rounds):
        of = ((centroids[:, None, :] - mid[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            mid[g] = centroids[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_assignment(x: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, squared distance and each group's lower bound, of every row of x, by all centroids."""
    d = np.stack([squares(x, c) for c in centroids], 1)
    cluster = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, cluster]
    d[rows, cluster] = np.iinfo(np.int64).max
    low = np.stack([np.sqrt(d[:, of == g].min(1)) * (1 - SLACK) for g in range(of.max() + 1)], 1)
    return cluster, best, low


def next_assignment(x: np.ndarray, cluster: np.ndarray, low: np.ndarray, centroids: np.ndarray, before: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved from before, and how many distances it took. cluster and low are of before.

    The distance to the own centroid is always computed, as it is a result; it is the upper bound, and as tight as can be.
    """
    n, groups = len(x), of.max() + 1
    moved = np.sqrt(squares(centroids, before).astype(float)) * (1 + SLACK)
    drift = np.array([moved[of == g].max() for g in range(groups)])
    best, cluster, took = np.empty(n, np.int64), cluster.copy(), n
    for c in np.unique(cluster):
        best[cluster == c] = squares(x[cluster == c], centroids[c])
    old, low = low, np.maximum(low - drift, 0)
    up = np.sqrt(best.astype(float)) * (1 + SLACK)
    rows = np.flatnonzero(low.min(1) <= up)  # what the global filter leaves
    own = cluster[rows].copy()
    kept, value, seen = own.copy(), best[rows].copy(), []
    for g in range(groups):
        at = np.flatnonzero(low[rows, g] <= np.sqrt(value.astype(float)) * (1 + SLACK))  # what the group filter leaves
        if not len(at):
            continue
        members, r = np.flatnonzero(of == g), rows[at]
        d = np.full((len(at), len(members)), np.iinfo(np.int64).max)
        reach = np.maximum(old[r, g][:, None] - moved[members][None], 0)  # local filter: by the centroid's own move
        d_low = reach.copy()  # what is not compared keeps this bound
        for j, c in enumerate(members):
            near = np.flatnonzero((reach[:, j] <= np.sqrt(value[at].astype(float)) * (1 + SLACK)) & (own[at] != c))
            d[near, j] = squares(x[r[near]], centroids[c])
            took += len(near)
            d_low[near, j] = np.sqrt(d[near, j].astype(float)) * (1 - SLACK)
            better = near[(d[near, j] < value[at[near]]) | ((d[near, j] == value[at[near]]) & (c < kept[at[near]]))]
            value[at[better]], kept[at[better]] = d[better, j], c
        d_low[own[at][:, None] == members[None]] = np.inf
        seen.append((g, at, members, d_low))
    for g, at, members, d_low in seen:  # a group's bound leaves out only the centroid that was chosen in the end
        d_low[kept[at][:, None] == members[None]] = np.inf
        low[rows[at], g] = d_low.min(1)
    changed = kept != own
    # the centroid that was left is another one of its group now
    r = rows[changed]
    low[r, of[own[changed]]] = np.minimum(low[r, of[own[changed]]], np.sqrt(best[r].astype(float)) * (1 - SLACK))
    cluster[rows], best[rows] = kept, value
    return cluster, best, low, took


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, of: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            if before is None:
                was = np.full(b.num_rows, -1)
                cluster, best, low = first_assignment(x, centroids, of)
            else:
                was = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                low = b.column("low").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                cluster, best, low, _ = next_assignment(x, was, low, centroids, before, of)
            low = pa.ListArray.from_arrays(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32), pa.array(low.ravel()))
            yield pa.record_batch([b.column("vec_id"), b.column("f"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(best, pa.int64()), low], ["vec_id", "f", "was", "cluster", "distance", "low"])

    return rows.mapInArrow(run, STATE)


def _changes(rows: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What joined each centroid's vectors less what left them: sums of components and numbers, as exact Python integers. Only rows
    that changed are read; a task sends a row a centroid, and k * size sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for b in batches:
            x = np.ones((b.num_rows, size + 1), np.int64)
            x[:, :size] = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            was, now = (b.column(c).to_numpy(zero_copy_only=False) for c in ("was", "cluster"))
            for c in range(k):
                sums[c] += x[now == c].sum(0) - x[was == c].sum(0)
        yield pa.record_batch([pa.array(np.repeat(np.arange(k), size + 1), pa.int32()), pa.array(np.tile(np.arange(size + 1), k), pa.int32()), pa.array(sums.ravel(), pa.int64())], ["c", "i", "x"])

    parts = rows.where("was <> cluster").select("f", "was", "cluster").mapInArrow(run, "c int, i int, x long")
    out = np.zeros((k, size + 1), object)
    for r in parts.groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r["c"], r["i"]] = int(r["x"])
    return out[:, :size], out[:, size]


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, groups: int = 4, size: int = SIZE, steps: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia and centroid (whole numbers) of every vector
    of vectors (vec_id, embedding) that has size finite components.

    Centroids start as k vectors chosen by hash, fewer if there are fewer; rounds times, vectors are assigned and centroids that have any
    become the floor of their mean; then vectors are assigned once more. All of it is exact, and ties go to the smaller number. Vectors of
    another length, or with a null, NaN or infinite component, have no row; one with a component past MOST / steps stops the job, as its
    distances would not fit. Repeated rows and null vec_ids are vectors like any other; an empty table gives no rows. Other columns are
    not read. k times size numbers are on the driver and in each task.
    """
    spark = vectors.sparkSession
    rows = stored(whole(vectors, size, steps), "vectors")
    centroids = starts(rows, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    of, before = grouped(centroids, groups), None
    sums, sizes = np.zeros((k, size), object), np.zeros(k, object)
    for step in range(rounds + 1):
        now = stored(_assigned(rows, centroids, before, of), "assigned")
        dropped(rows)
        rows = now
        if step < rounds:
            more, joined = _changes(rows, k, size)
            sums, sizes, before = sums + more, sizes + joined, centroids
            centroids = np.array([[s // sizes[c] for s in sums[c]] if sizes[c] else centroids[c] for c in range(k)], np.int64)
    of_cluster = {r["cluster"]: int(r["x"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    total = sum(of_cluster.values())
    told = spark.createDataFrame([(c, of_cluster.get(c, 0), total, [int(x) for x in centroids[c]]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def report(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """clustered, with each centroid as the SHA-256 of its components, comma-joined."""
    found = clustered(vectors, k, rounds, seed)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
