"""Seeded synthetic vectors, and data sets with exact ground truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.knn import exact_batch
from orrery.schema import InvalidInput


def uniform(spark: SparkSession, count: int, dimension: int, seed: int = 42) -> DataFrame:
    """``count`` records of components in [-1, 1), the same in any layout: each is a hash of seed, row and place."""
    component = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1).cast("float")
    values = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), component)
    stamp = F.lit(1_600_000_000) + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(100_000_000))
    return spark.range(count).select(F.col("id").alias("external_id"), values.alias("values"), stamp.cast("long").alias("timestamp"))


def normal(spark: SparkSession, n: int, d: int, nq: int, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, queries and exact ground truth of standard normal vectors, drawn on the driver (for benchmarks)."""
    r = np.random.default_rng(seed)
    base, queries = r.standard_normal((n, d)).astype(np.float32), r.standard_normal((nq, d)).astype(np.float32)
    b = spark.createDataFrame(list(zip(range(n), base.tolist())), "external_id long, values array<float>")
    q = spark.createDataFrame(list(zip(range(nq), queries.tolist())), "query_id long, query array<float>")
    return b, q, exact_batch(b, q, k)


def assemble(base: DataFrame, queries: DataFrame, truth: DataFrame | None, n: int | None, nq: int | None, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n base rows and nq queries (``id``, ``values``) with a ground truth of k columns.

    A given truth (``id``, ``values`` of ids) is used if all its first k ids are among the rows, else computed again;
    it is an error if it has fewer than k columns, or if dimensions differ.
    """
    b = (base if n is None else base.where(F.col("id") < n)).select(F.col("id").alias("external_id"), "values")
    q = (queries if nq is None else queries.where(F.col("id") < nq)).select(F.col("id").alias("query_id"), F.col("values").alias("query"))
    sizes = b.agg(F.min(F.size("values")), F.max(F.size("values")), F.count("*")).first(), q.agg(F.min(F.size("query")), F.max(F.size("query"))).first()
    if len({*sizes[0][:2], *sizes[1]}) != 1:
        raise InvalidInput("base and queries have different dimensions")
    if truth is not None:
        t = truth if nq is None else truth.where(F.col("id") < nq)
        width, top = t.agg(F.min(F.size("values")), F.max(F.array_max(F.slice("values", 1, k)))).first()
        if width is not None and width < k:
            raise InvalidInput(f"the ground truth has {width} columns, not {k}")
        if top is not None and top < sizes[0][2]:
            placed = t.select(F.col("id").alias("query_id"), F.posexplode(F.slice("values", 1, k)).alias("rank", "external_id"))
            return b, q, placed.withColumn("rank", F.col("rank") + 1)
    return b, q, exact_batch(b, q, k)
