"""Exact nearest neighbours and top-n selection as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.kernels import best, matrix, nearest
from orrery.functions.vectors import l2_squared
from orrery.session import ship

#: Bytes of vectors that are broadcast at once; more are taken in several blocks.
BLOCK_BYTES = 64 << 20


def block_count(rows: int, dimension: int) -> int:
    return max(1, -(-rows * dimension * 8 // BLOCK_BYTES))


def width(df: DataFrame, column: str) -> int:
    """Components of the first vector that isn't null, 1 without any."""
    row = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    return max(1, row[0]) if row else 1


def ranked(scored: DataFrame, k: int, by: str = "query_id", distance: str = "distance", tie: str = "external_id") -> DataFrame:
    """The k rows of smallest (distance, tie) per ``by`` with their ``rank`` from 1; partial top-k precedes the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(distance), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_single(df: DataFrame, query: list[float], k: int, id_col: str = "external_id", vector_col: str = "values") -> DataFrame:
    """(``rank``, ``external_id``, ``distance``) of the k nearest to one query, without a shuffle of the data."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(F.col(id_col).alias("external_id"), l2_squared(F.col(vector_col), q).alias("distance")).where("distance is not null")
    best = scored.orderBy("distance", "external_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy("distance", "external_id")).alias("rank"), "external_id", "distance")


def exact_batch(df: DataFrame, queries: DataFrame, k: int, id_col: str = "external_id", vector_col: str = "values", query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """(``query_id``, ``rank``, ``external_id``, ``distance``) by comparing a stated query set with all rows, in blocks.

    Queries are collected in blocks of BLOCK_BYTES and broadcast; each Arrow batch is one product with them and keeps its k
    best per query, so at most k rows per query and batch are shuffled. Rows and queries must have valid vectors of one dimension.
    """
    spark = df.sparkSession
    ship(spark)
    parts = None
    total = queries.count()
    blocks = block_count(total, width(queries, query_col))
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = block.select(F.col(query_id).cast("long").alias("i"), F.col(query_col).cast("array<double>").alias("q")).toArrow()
        if not rows.num_rows:
            continue
        ids = rows["i"].to_numpy()
        q = rows["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, own = matrix(batch.column("values"), q.shape[1]), batch.column("external_id").to_numpy()
                qi, at, d = best(x, own, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(own[at]), pa.array(d)], names=["query_id", "external_id", "distance"])

        found = df.select(F.col(id_col).cast("long").alias("external_id"), F.col(vector_col).cast("array<float>").alias("values")).mapInArrow(run, "query_id long, external_id long, distance double")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = spark.createDataFrame([], "query_id long, external_id long, distance double")
    return ranked(parts, k).select("query_id", "rank", "external_id", "distance")


def probes(queries: DataFrame, centroids: DataFrame, n_probe: int) -> DataFrame:
    """The n_probe nearest centroids of each query: ``query_id``, ``rank``, ``centroid_id``, ``distance``; ties go to
    the smaller centroid, and with fewer centroids all come out. Centroids are broadcast in blocks of BLOCK_BYTES."""
    spark = queries.sparkSession
    ship(spark)
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("q")).where(F.col("q").isNotNull())
    parts = None
    for ids, c in centroid_blocks(centroids):
        shared = spark.sparkContext.broadcast((ids, c))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, c = shared.value
            for batch in batches:
                if batch.num_rows:
                    qi, at, d = best(c, ids, matrix(batch.column("q"), c.shape[1]), n_probe)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(qi)), pa.array(ids[at]), pa.array(d)], names=["query_id", "centroid_id", "distance"])

        found = rows.mapInArrow(run, "query_id long, centroid_id long, distance double")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = spark.createDataFrame([], "query_id long, centroid_id long, distance double")
    return ranked(parts, n_probe, tie="centroid_id").select("query_id", "rank", "centroid_id", "distance")


def centroid_blocks(centroids: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of (``centroid_id``, ``centroid``), by id within blocks of bounded size."""
    blocks = block_count(centroids.count(), width(centroids, "centroid"))
    for b in range(blocks):
        part = centroids.where(F.pmod(F.xxhash64("centroid_id"), F.lit(blocks)) == b).select(F.col("centroid_id").cast("long").alias("c"), F.col("centroid").cast("array<double>").alias("v")).orderBy("c").toArrow()
        if part.num_rows:
            yield part["c"].to_numpy(), matrix(part["v"].combine_chunks(), len(part["v"][0]))


def nearest_centroid(points: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``centroid_id``, ``distance`` of the nearest centroid of each point, ties to the smaller.

    ``centroids`` are (``centroid_id``, ``centroid``). They are broadcast in blocks of BLOCK_BYTES, and each block
    is compared with the points where they are; only with several blocks is a row per point and block shuffled.
    """
    spark = points.sparkSession
    ship(spark)
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("v").isNotNull())
    parts, blocks = None, 0
    for ids, c in centroid_blocks(centroids):
        blocks += 1
        shared = spark.sparkContext.broadcast((ids, c))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, c = shared.value
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("v"), c.shape[1])
                    at = nearest(x, c)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[at]), pa.array(((x - c[at]) ** 2).sum(1))], names=["id", "centroid_id", "distance"])

        found = rows.mapInArrow(run, "id long, centroid_id long, distance double")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = spark.createDataFrame([], "id long, centroid_id long, distance double")
    if blocks > 1:
        parts = parts.groupBy("id").agg(F.min(F.struct("distance", "centroid_id")).alias("m")).select("id", F.col("m.centroid_id").alias("centroid_id"), F.col("m.distance").alias("distance"))
    return parts.withColumnRenamed("id", id_col)


def centroid_means(labelled: DataFrame, vector_col: str = "embedding", label_col: str = "centroid_id") -> DataFrame:
    """``label_col`` and ``centroid``, the componentwise mean of each group: sums are combined before the shuffle."""
    long = labelled.select(label_col, F.posexplode(vector_col).alias("pos", "x")).groupBy(label_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    parts = long.groupBy(label_col).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("parts"))
    return parts.select(F.col(label_col).alias("centroid_id"), F.transform("parts", lambda p: p["x"]).alias("centroid"))
