"""Search in an inverted-file index: probe the nearest centroids, score their lists, keep the k nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.kernels import best, matrix
from orrery.functions.vectors import l2_squared
from orrery.operators.index import IvfIndex, _exists
from orrery.operators.knn import block_count, probes, ranked, width
from orrery.schema import InvalidInput, NotFound, SearchRequest, checked_query, dimension_violations
from orrery.session import ship

#: Lists up to which their numbers are literals of the scan, so that row groups are skipped by them.
LITERAL_LISTS = 2_000


def search_lists(queries: DataFrame, centroids: DataFrame, postings: DataFrame, k: int, n_probe: int, include_vectors: bool = False, id_col: str = "external_id", vector_col: str = "values") -> DataFrame:
    """(``query_id``, ``rank``, ``external_id``, ``distance``[, ``vector``]) over lists given as DataFrames.

    ``queries`` (query_id, query), ``centroids`` (centroid_id, shard_id, centroid), ``postings`` (shard_id,
    centroid_id, id, vector). Of equal distances the smaller id comes first.

    Queries and their probes are collected in blocks of bounded bytes and broadcast to the lists, which stay where they
    are: each Arrow batch is scored list by list, one product per list, and hands on k rows per query and list at most. So
    a list with many rows or many probes is shared out like the scan itself. Only the probed shards' partitions are opened.
    """
    spark = queries.sparkSession
    ship(spark)
    dimension = width(queries, "query")
    blocks = block_count(queries.count(), dimension + n_probe)
    shard_of = {r["centroid_id"]: r["shard_id"] for r in centroids.select("centroid_id", "shard_id").collect()}  # a row per list
    parts = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = block.select(F.col("query_id").cast("long").alias("i"), F.col("query").cast("array<double>").alias("q")).toArrow()
        if not rows.num_rows:
            continue
        ids, q = rows["i"].to_numpy(), matrix(rows["q"].combine_chunks(), dimension)
        probed = probes(block, centroids, n_probe).select("query_id", "centroid_id").toArrow()
        order = np.argsort(ids, kind="stable")
        asked = order[np.searchsorted(ids[order], probed["query_id"].to_numpy())]
        lists = probed["centroid_id"].to_numpy()
        by = np.argsort(lists, kind="stable")
        numbers, starts = np.unique(lists[by], return_index=True)
        per_list = dict(zip(numbers.tolist(), np.split(asked[by], starts[1:])))
        shared = spark.sparkContext.broadcast((ids, q, per_list))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, per_list = shared.value
            for batch in batches:
                own, lists = batch.column("id").to_numpy(), batch.column("list").to_numpy()
                for number in np.unique(lists).tolist():
                    if number in per_list:
                        at, asks = np.flatnonzero(lists == number), per_list[number]
                        part = batch.column("v").take(pa.array(at))
                        qi, xi, d = best(matrix(part, q.shape[1]), own[at], q[asks], k)
                        out = [pa.array(ids[asks[qi]]), pa.array(own[at][xi]), pa.array(d)]
                        yield pa.RecordBatch.from_arrays([*out, *([part.take(pa.array(xi))] if include_vectors else [])], names=names)

        names = ["query_id", "external_id", "distance", *(["vector"] if include_vectors else [])]
        scanned = postings.where(F.col("shard_id").isin(sorted({int(shard_of[c]) for c in per_list})))
        if len(per_list) <= LITERAL_LISTS:
            scanned = scanned.where(F.col("centroid_id").isin(sorted(per_list)))
        slim = scanned.select(F.col(id_col).cast("long").alias("id"), F.col("centroid_id").cast("long").alias("list"), F.col(vector_col).cast("array<float>").alias("v"))
        found = slim.mapInArrow(run, "query_id long, external_id long, distance double" + (", vector array<float>" if include_vectors else ""))
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = spark.createDataFrame([], "query_id long, external_id long, distance double, vector array<float>")
    return ranked(parts, k).select("query_id", "rank", "external_id", "distance", *(["vector"] if include_vectors else []))


def search(index: IvfIndex, queries: DataFrame, k: int | None = None, n_probe: int | None = None, include_vectors: bool = False, on_missing_shard: str = "error") -> DataFrame:
    """Batch search of (``query_id``, ``query``) in an index, as one plan.

    k and n_probe are cut to the configured limits and must be positive; every query must have the index's
    dimension. A shard that is missing on disk is an error, or skipped with ``on_missing_shard="skip"``.
    """
    k, n_probe = index.config.clamp(k if k is not None else index.config.default_k, n_probe if n_probe is not None else index.config.default_n_probe)
    if bad := dimension_violations(queries, index.dimension, "query_id", "query").limit(1).collect():
        raise InvalidInput(f"query {bad[0]['id']}: expected dimension {index.dimension}, got {bad[0]['actual']}")
    if on_missing_shard not in ("error", "skip"):
        raise InvalidInput("on_missing_shard is 'error' or 'skip'")
    if on_missing_shard == "error":
        shards = [r["shard_id"] for r in index.centroids.select("shard_id").distinct().collect()]
        base = f"{index.config.shards_dir.rstrip('/')}/lists"
        if missing := [s for s in shards if not _exists(queries.sparkSession, f"{base}/shard_id={s}")]:
            raise NotFound(f"shards {sorted(missing)}")
    return search_lists(queries, index.centroids, index.postings, k, n_probe, include_vectors)


def search_one(index: IvfIndex, request: SearchRequest) -> DataFrame:
    """One query; the lists to read are literals in the plan, so only their partitions and row groups are scanned."""
    k, n_probe = index.config.clamp(request.k, request.n_probe)
    query = checked_query(request.query, index.dimension)
    spark = index.centroids.sparkSession
    one = spark.createDataFrame([(0, query)], "query_id long, query array<double>")
    lists = probes(one, index.centroids, n_probe).join(F.broadcast(index.centroids.select("centroid_id", "shard_id")), "centroid_id").collect()
    rows = index.postings.where(F.col("shard_id").isin([r["shard_id"] for r in lists]) & F.col("centroid_id").isin([r["centroid_id"] for r in lists]))
    distance = l2_squared(F.col("values"), F.array(*[F.lit(x) for x in query]))
    best = ranked(rows.select(F.lit(0).cast("long").alias("query_id"), "external_id", distance.alias("distance"), *([F.col("values").alias("vector")] if request.include_vectors else [])), k)
    return best.orderBy("rank").select("rank", "external_id", "distance", *(["vector"] if request.include_vectors else []))


def padded(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows per query: missing places have ``external_id`` -1 and an infinite distance."""
    places = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    full = places.join(found.select("query_id", "rank", "external_id", "distance"), ["query_id", "rank"], "left")
    return full.select("query_id", "rank", F.coalesce("external_id", F.lit(-1).cast("long")).alias("external_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def to_arrays(found: DataFrame, query_ids: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances float32, ids int64) of shape (queries, k), padded with infinity and -1."""
    d, i = np.full((len(query_ids), k), np.inf, np.float32), np.full((len(query_ids), k), -1, np.int64)
    row = {q: n for n, q in enumerate(query_ids)}
    for r in found.collect():
        d[row[r["query_id"]], r["rank"] - 1], i[row[r["query_id"]], r["rank"] - 1] = r["distance"], r["external_id"]
    return d, i
