"""K-means: size heuristics, seeding, full-batch and mini-batch fitting on bounded samples, distributed assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.kernels import distances, matrix, nearest
from orrery.schema import InvalidInput
from orrery.session import ship

#: Rows that fitting and seeding look at, or so many per centroid where that is more; larger data are sampled.
SEED_ROWS, ROWS_PER_CENTROID = 50_000, 32
#: Centroids beyond which assignment goes through super-centroids.
BRUTE_CENTROIDS = 100


def suggest_nlist(n: int) -> int:
    """Number of clusters for n vectors."""
    root = math.sqrt(n)
    if n < 10_000:
        return max(1, math.floor(root))
    return (2 if n < 100_000 else 4) * math.ceil(root)


def suggest_iterations(n: int) -> int:
    """Most iterations for n vectors."""
    for below, most in ((10_000, 300), (100_000, 100), (1_000_000, 50)):
        if n < below:
            return most
    return 20


def batch_size(n: int) -> int:
    """Rows of a mini-batch: between 10 and 256, the square root in between, never more than n."""
    return min(n, 256, max(10, math.isqrt(n)))


def movement(old: np.ndarray, new: np.ndarray) -> float:
    """Root mean square movement of the centroids' components."""
    return float(np.sqrt(((old - new) ** 2).mean()))


def seed_centroids(x: np.ndarray, k: int, rng: np.random.Generator, weighting: str = "d2") -> np.ndarray:
    """K-means++ seeds of a bounded sample of the rows: the first uniform, each next by its distance to the nearest so far.

    ``weighting`` "d2" draws in proportion to the squared distance, "d4" to its square. Where no distance is left, or
    k exceeds the rows, seeds are duplicates of drawn ones, so that k always come out.
    """
    if not len(x):
        raise InvalidInput("cannot cluster no vectors")
    most = max(SEED_ROWS, ROWS_PER_CENTROID * k)
    rows = x if len(x) <= most else x[rng.choice(len(x), most, replace=False)]
    chosen = [rows[rng.integers(len(rows))]]
    least = ((rows - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        weight = least if weighting == "d2" else least**2
        total = weight.sum()
        if len(chosen) >= len(rows) or total <= 0:
            chosen.append(chosen[rng.integers(len(chosen))])
            continue
        new = rows[rng.choice(len(rows), p=weight / total)]
        chosen.append(new)
        least = nearer(least, rows, new)
    return np.array(chosen, dtype=np.float64)


def nearer(least: np.ndarray, rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The squared distances to the nearest seed after one more."""
    return np.minimum(least, ((rows - new) ** 2).sum(1))


def means(x: np.ndarray, label: np.ndarray, k: int, fallback: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and size of each cluster; an empty cluster keeps its centroid."""
    n = np.bincount(label, minlength=k)
    total = np.stack([np.bincount(label, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], fallback), n


def full_batch(x: np.ndarray, k: int, iterations: int, tolerance: float | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm on rows in memory: centroids and final labels. Stops when movement is below the tolerance."""
    rng = np.random.default_rng(seed)
    c = seed_centroids(x, k, rng)
    for _ in range(iterations):
        new, n = means(x, nearest(x, c), k, c)
        for empty in np.flatnonzero(n == 0):
            new[empty] = x[rng.integers(len(x))]
        moved = movement(c, new)
        c = new
        if moved < (1e-4 if tolerance is None else tolerance):
            break
    return c, nearest(x, c)


@dataclass
class MiniBatch:
    """Running state of mini-batch fitting: centroids and the batches that hit each."""

    centroids: np.ndarray
    hits: np.ndarray

    def update(self, batch: np.ndarray) -> None:
        """Move each hit centroid to (1 - eta) c + eta mean, eta one over the number of batches that hit it."""
        mean, n = means(batch, nearest(batch, self.centroids), len(self.centroids), self.centroids)
        hit = n > 0
        self.hits[hit] += 1
        eta = 1 / np.maximum(self.hits, 1)[:, None]
        self.centroids = np.where(hit[:, None], (1 - eta) * self.centroids + eta * mean, self.centroids)


def mini_batch(x: np.ndarray, k: int, iterations: int, tolerance: float | None = None, seed: int = 42, reseed_rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Mini-batch k-means on rows in memory: centroids and final labels.

    Centroids no batch has hit are replaced by random rows during the first ``reseed_rounds`` iterations only, so
    that movement can fall below the tolerance.
    """
    rng = np.random.default_rng(seed)
    state = MiniBatch(seed_centroids(x, k, rng), np.zeros(k, dtype=np.int64))
    b = batch_size(len(x))
    for i in range(iterations):
        before = state.centroids
        state.update(x[rng.choice(len(x), b, replace=False)])
        unhit = np.flatnonzero(state.hits == 0)
        if i < reseed_rounds and len(unhit):
            state.centroids[unhit] = x[rng.integers(len(x), size=len(unhit))]
        elif movement(before, state.centroids) < (1e-4 if tolerance is None else tolerance):
            break
    return state.centroids, nearest(x, state.centroids)


@dataclass(frozen=True)
class Hierarchy:
    """Super-centroids over many centroids: a row is compared only with the centroids of its nearest three."""

    centroids: np.ndarray
    metas: np.ndarray
    owner: np.ndarray

    @classmethod
    def fit(cls, centroids: np.ndarray, seed: int = 42, rounds: int = 5) -> Hierarchy:
        k = len(centroids)
        m = max(1, min(max(math.isqrt(k), 2), k // 2))
        metas = centroids[np.sort(np.random.default_rng(seed).choice(k, m, replace=False))].copy()
        return cls.refined(centroids, metas, rounds)

    @classmethod
    def refined(cls, centroids: np.ndarray, metas: np.ndarray, rounds: int = 5) -> Hierarchy:
        for _ in range(rounds):
            metas, _ = means(centroids, nearest(centroids, metas), len(metas), metas)
        owner = nearest(centroids, metas)
        used = np.unique(owner)  # metas that own no centroid are never looked in
        return cls(centroids, metas[used], np.searchsorted(used, owner))

    def assign(self, x: np.ndarray, looked_in: int = 3) -> np.ndarray:
        d = distances(x, self.metas)
        near = np.argsort(d, axis=1, kind="stable")[:, :looked_in]
        best, label = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
        for m in range(len(self.metas)):
            own = np.flatnonzero(self.owner == m)
            rows = np.flatnonzero((near == m).any(axis=1))
            if len(own) and len(rows):
                part = distances(x[rows], self.centroids[own])
                at = part.argmin(axis=1)
                value = part[np.arange(len(rows)), at]
                better = (value < best[rows]) | ((value == best[rows]) & (own[at] < label[rows]))
                best[rows[better]], label[rows[better]] = value[better], own[at[better]]
        return label


def assign(df: DataFrame, centroids: np.ndarray, vector_col: str = "values", name: str = "centroid_id", hierarchy: bool | Hierarchy | None = None) -> DataFrame:
    """``df`` with the nearest centroid of each vector, in one pass without a shuffle.

    The centroids are broadcast: at most a few thousand, as many as were fitted on the driver. Beyond
    BRUTE_CENTROIDS the assignment is hierarchical unless told otherwise (``hierarchy`` False for the exact one, or a
    hierarchy of one's own).
    """
    spark = df.sparkSession
    ship(spark)
    c = np.ascontiguousarray(centroids, dtype=np.float64)
    layered = hierarchy if isinstance(hierarchy, Hierarchy) else Hierarchy.fit(c) if (len(c) > BRUTE_CENTROIDS if hierarchy is None else hierarchy) and len(c) > 3 else None
    shared = spark.sparkContext.broadcast((c, layered))
    kept = [f for f in df.columns if f != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, layered = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(vector_col), c.shape[1])
                label = layered.assign(x) if layered else nearest(x, c)
                yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(label, pa.int32())], names=[*kept, name])

    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[f] for f in kept), T.StructField(name, T.IntegerType())])
    return df.select(*kept).mapInArrow(run, schema)


def bounded_sample(df: DataFrame, rows: int, total: int, id_col: str = "external_id", vector_col: str = "values", seed: int = 42) -> np.ndarray:
    """At most about ``rows`` vectors on the driver, the same whatever the partitioning: those of smallest hash."""
    share = min(1.0, rows / max(total, 1))
    h = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30))
    part = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"), h.alias("h")).where(F.col("h") < int(share * (1 << 30)) + (share >= 1)).orderBy("h", "id", F.xxhash64("v")).limit(2 * rows)
    got = part.select("v").toArrow()["v"].combine_chunks()
    return np.asarray(got.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(got), -1)


def vectors(df: DataFrame, id_col: str = "external_id", vector_col: str = "values") -> np.ndarray:
    """The vectors of a small frame, such as a mini-batch, in the order of their ids."""
    got = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("id").toArrow()["v"].combine_chunks()
    return matrix(got, len(got[0])) if len(got) else np.zeros((0, 0))


def lloyd_round(df: DataFrame, centroids: np.ndarray, vector_col: str = "values") -> tuple[np.ndarray, np.ndarray]:
    """Means and sizes of the clusters of all rows: one pass of per-task sums, added by centroid and component.

    The driver gets one row per centroid and component, whatever the number of rows. An empty cluster has size 0.
    """
    spark = df.sparkSession
    ship(spark)
    k, dim = centroids.shape
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(centroids, dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), dim)
                label = nearest(x, shared.value)
                total[:, dim] += np.bincount(label, minlength=k)
                for j in range(dim):
                    total[:, j] += np.bincount(label, weights=x[:, j], minlength=k)
        cid, pos = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cid.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(total[cid, pos])], names=["cid", "pos", "x"])

    got = df.select(F.col(vector_col).cast("array<float>").alias("v")).mapInArrow(run, "cid int, pos int, x double").groupBy("cid", "pos").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros((k, dim + 1))
    total[got["cid"].to_numpy(), got["pos"].to_numpy()] = got["x"].to_numpy()
    n = total[:, dim].astype(np.int64)
    return total[:, :dim] / np.maximum(n, 1)[:, None], n
