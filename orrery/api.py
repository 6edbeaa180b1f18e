"""Façades: build, load and search an index from records, arrays or SQL."""

from __future__ import annotations

import asyncio
import tempfile
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import index as ivf
from orrery.operators import search as searching
from orrery.operators.kmeans import suggest_nlist
from orrery.schema import RECORDS, IndexConfig, InvalidInput, SearchRequest
from orrery.session import ship
from orrery.sources import files

__all__ = ["SearchResult", "ArrayIndex", "Indexer", "build", "load", "register_sql", "suggest_nlist"]


@dataclass(frozen=True)
class SearchResult:
    external_id: int
    distance: float
    vector: list[float] | None = None


@dataclass
class Indexer:
    """An index by its configuration: build it from records or a vector file, or load it, then search."""

    config: IndexConfig
    spark: SparkSession
    index: ivf.IvfIndex | None = None

    def build_from_records(self, records: DataFrame | list[tuple], seed: int = 42) -> Indexer:
        """``records``: a DataFrame or (external_id, values, timestamp) tuples; null or zero timestamps mean now."""
        if isinstance(records, list):
            if not records:
                raise InvalidInput("no vectors provided")
            if any(not -(1 << 63) <= r[0] < 1 << 63 for r in records):
                raise InvalidInput("external ids must be 64-bit signed integers")
            records = self.spark.createDataFrame(records, RECORDS)
        self.index = ivf.fit(records, self.config, seed)
        return self

    def build_from_vector_file(self, path: str, seed: int = 42, strict: bool = False) -> Indexer:
        return self.build_from_records(files.read(self.spark, "vecbin", path, strict=str(strict).lower()), seed)

    def load(self) -> Indexer:
        self.index = ivf.load(self.spark, self.config)
        return self

    def search_request(self, query) -> SearchRequest:
        """A request with the configured defaults."""
        return SearchRequest(tuple(map(float, query)), self.config.default_k, self.config.default_n_probe)

    def search(self, request: SearchRequest) -> list[SearchResult]:
        if self.index is None:
            raise InvalidInput("build or load the index first")
        rows = searching.search_one(self.index, request).collect()  # at most k
        return [SearchResult(r["external_id"], r["distance"], list(r["vector"]) if request.include_vectors else None) for r in rows]

    def search_batch(self, queries: DataFrame, k: int | None = None, n_probe: int | None = None, include_vectors: bool = False) -> DataFrame:
        if self.index is None:
            raise InvalidInput("build or load the index first")
        return searching.search(self.index, queries, k, n_probe, include_vectors)


class ArrayIndex:
    """Array-shaped access to an index: ``D, I = search_sync(xq, k, n_probe)``; also ``search(xq, k)`` with ``nprobe``."""

    def __init__(self, indexer: Indexer):
        self._indexer, self.nprobe = indexer, indexer.config.default_n_probe

    @property
    def dimension(self) -> int:
        return self._indexer.config.dimension

    d = dimension

    def search_sync(self, xq: np.ndarray, k: int, n_probe: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(float32 distances, int64 ids) of shape (queries, k), padded with infinity and -1."""
        xq = np.atleast_2d(np.asarray(xq, dtype=np.float32))
        if xq.shape[1] != self.dimension:
            raise InvalidInput(f"query dimension mismatch: expected {self.dimension}, got {xq.shape[1]}")
        q = self._indexer.spark.createDataFrame(list(zip(range(len(xq)), xq.tolist())), "query_id long, query array<float>")
        return searching.to_arrays(self._indexer.search_batch(q, k, n_probe or self.nprobe), list(range(len(xq))), k)

    async def search_async(self, xq: np.ndarray, k: int, n_probe: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return await asyncio.get_running_loop().run_in_executor(None, partial(self.search_sync, xq, k, n_probe))

    def search(self, xq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search_sync(xq, k, self.nprobe)


def build(xb: np.ndarray, spark: SparkSession, work_dir: str | None = None, seed: int = 42) -> ArrayIndex:
    """An index of the rows of an array, their numbers being the ids."""
    xb = np.asarray(xb, dtype=np.float32)
    root = work_dir or tempfile.mkdtemp(prefix="orrery-index-")
    config = IndexConfig(xb.shape[1], f"{root}/index", f"{root}/shards")
    rows = [(i, v, None) for i, v in enumerate(xb.tolist())]
    return ArrayIndex(Indexer(config, spark).build_from_records(rows, seed))


def load(index_dir: str, shards_dir: str, dimension: int, spark: SparkSession) -> ArrayIndex:
    return ArrayIndex(Indexer(IndexConfig(dimension, index_dir, shards_dir), spark).load())


def register_sql(spark: SparkSession, indexer: Indexer | None = None) -> None:
    """SQL functions: scalar ``l2_squared(a, b)`` and, with an index, the table function ``ann_search(query, k, n_probe)``
    (``rank``, ``external_id``, ``distance``), which reads the probed lists where it runs."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION l2_squared(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x) END""")
    if indexer is None:
        return
    if indexer.index is None:
        raise InvalidInput("build or load the index first")
    ship(spark)
    rows = indexer.index.centroids.orderBy("centroid_id").collect()
    table = [(r["centroid_id"], r["shard_id"], list(r["centroid"])) for r in rows]
    lists, config = f"{indexer.config.shards_dir.rstrip('/')}/lists", indexer.config

    class AnnSearch:
        def eval(self, query, k: int, n_probe: int):
            import pyarrow.dataset as ds

            k, n_probe = config.clamp(k, n_probe)
            q = np.asarray(query, dtype=np.float64)
            if len(q) != config.dimension:
                raise InvalidInput(f"query dimension mismatch: expected {config.dimension}, got {len(q)}")
            near = sorted(table, key=lambda c: (float(((np.asarray(c[2]) - q) ** 2).sum()), c[0]))[:n_probe]
            from pyarrow.fs import FileSystem

            if "://" in lists or lists.startswith("file:"):  # the file system that the location names
                system, path = FileSystem.from_uri(lists if "://" in lists else lists.replace("file:", "file://", 1))
                data = ds.dataset(path, filesystem=system, partitioning="hive")
            else:
                data = ds.dataset(lists, partitioning="hive")
            wanted = ds.field("shard_id").isin(sorted({c[1] for c in near})) & ds.field("centroid_id").isin([c[0] for c in near])
            got = data.to_table(columns=["external_id", "values"], filter=wanted)
            x = np.asarray(got["values"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, config.dimension)
            d, ids = ((x - q) ** 2).sum(axis=1), got["external_id"].to_numpy()
            for rank, at in enumerate(np.lexsort((ids, d))[:k], 1):
                yield rank, int(ids[at]), float(d[at])

    from pyspark.sql.functions import udtf

    spark.udtf.register("ann_search", udtf(AnnSearch, returnType="rank int, external_id bigint, distance double"))


def register_views(spark: SparkSession, indexer: Indexer, prefix: str = "ivf") -> None:
    """Views of an index's centroids and posting lists for SQL."""
    if indexer.index is None:
        raise InvalidInput("build or load the index first")
    indexer.index.centroids.createOrReplaceTempView(f"{prefix}_centroids")
    indexer.index.postings.withColumn("values", F.col("values")).createOrReplaceTempView(f"{prefix}_postings")
