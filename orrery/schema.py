"""Logical schemas, configuration, requests and their validation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.vectors import is_finite

RECORDS = T.StructType([T.StructField("external_id", T.LongType(), False), T.StructField("values", T.ArrayType(T.FloatType()), False), T.StructField("timestamp", T.LongType(), True)])
RESULTS = "query_id long, rank int, external_id long, distance double"


class InvalidInput(ValueError):
    """Input that an operation can't accept."""


class NotFound(LookupError):
    """A shard or centroid that isn't stored."""


@dataclass(frozen=True)
class SearchRequest:
    """One query: k nearest among the lists of the n_probe nearest centroids."""

    query: tuple[float, ...]
    k: int = 10
    n_probe: int = 20
    include_vectors: bool = False

    def with_k(self, k: int) -> SearchRequest:
        return replace(self, k=k)

    def with_n_probe(self, n_probe: int) -> SearchRequest:
        return replace(self, n_probe=n_probe)

    def with_include_vectors(self, include: bool) -> SearchRequest:
        return replace(self, include_vectors=include)


@dataclass(frozen=True)
class IndexConfig:
    """Where an index lies and the defaults and limits of its searches."""

    dimension: int
    index_dir: str = "index"
    shards_dir: str = "shards"
    default_k: int = 10
    default_n_probe: int = 20
    max_k: int = 10_000
    max_n_probe: int = 10_000

    def with_index_dir(self, path: str) -> IndexConfig:
        return replace(self, index_dir=path)

    def with_shards_dir(self, path: str) -> IndexConfig:
        return replace(self, shards_dir=path)

    def clamp(self, k: int, n_probe: int) -> tuple[int, int]:
        """k and n_probe cut to the limits, then required to be positive."""
        k, n_probe = min(k, self.max_k), min(n_probe, self.max_n_probe)
        if k <= 0 or n_probe <= 0:
            raise InvalidInput("k and n_probe must be greater than 0")
        return k, n_probe


def checked_query(query, dimension: int) -> list[float]:
    """A single query as floats, if it has the dimension."""
    values = [float(x) for x in query]
    if len(values) != dimension:
        raise InvalidInput(f"query dimension mismatch: expected {dimension}, got {len(values)}")
    return values


def dimension_violations(df: DataFrame, dimension: int, id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """(``id``, ``expected``, ``actual``) of rows whose vector is null or of another length."""
    actual = F.coalesce(F.size(vector_col), F.lit(-1))
    return df.where(F.col(vector_col).isNull() | (actual != dimension)).select(F.col(id_col).alias("id"), F.lit(dimension).alias("expected"), F.greatest(actual, F.lit(0)).alias("actual"))


def check_records(df: DataFrame, dimension: int, vector_col: str = "values", id_col: str = "external_id") -> int:
    """The number of records; raises for none, for a first bad dimension, non-finite components and null ids."""
    bad_size = F.col(vector_col).isNull() | (F.size(vector_col) != dimension)
    bad_value = ~F.coalesce(F.forall(vector_col, is_finite), F.lit(False))
    row = df.agg(
        F.count("*").alias("n"),
        F.min_by(F.struct(F.col(id_col).alias("id"), F.coalesce(F.size(vector_col), F.lit(0)).alias("size")), F.when(bad_size, F.col(id_col))).alias("size"),
        F.count_if(bad_size).alias("sizes"), F.count_if(~bad_size & bad_value).alias("values"), F.count_if(F.col(id_col).isNull()).alias("ids"),
    ).first()
    if not row["n"]:
        raise InvalidInput("no vectors provided")
    if row["sizes"]:
        at = row["size"]
        raise InvalidInput(f"vector {at['id'] if at else None} has dimension {at['size'] if at else None}, expected {dimension}")
    if row["values"]:
        raise InvalidInput(f"{row['values']} vectors have null, NaN or infinite components")
    if row["ids"]:
        raise InvalidInput("external ids must be 64-bit signed integers and not null")
    return row["n"]


def with_timestamps(df: DataFrame, now: int, column: str = "timestamp") -> DataFrame:
    """Null and zero timestamps become ``now``, the same second for all rows of a build."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(now)).cast("long"))


def with_ordinals(df: DataFrame, order_col: str = "external_id") -> DataFrame:
    """``id``: the 0-based position in the order of ``order_col`` (of equal ones, of the values), without a global sort
    in one task: positions within range partitions are shifted by the sizes of those before."""
    spark = df.sparkSession
    from orrery.session import cut

    placed = cut(df.repartitionByRange(F.col(order_col), F.xxhash64("values")).sortWithinPartitions(order_col, F.xxhash64("values")).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row per partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    shift = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return placed.join(F.broadcast(shift), "_part").withColumn("id", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
