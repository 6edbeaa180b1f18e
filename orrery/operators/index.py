"""The inverted-file index: fit, write, load."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import kmeans
from orrery.schema import IndexConfig, InvalidInput, NotFound, check_records, with_ordinals, with_timestamps

VERSION = 1
CENTROIDS = "centroid_id int, shard_id int, n_vectors long, centroid array<double>"


@dataclass(frozen=True)
class IvfIndex:
    """A written index: small metadata on the driver, posting lists as Parquet partitioned by shard."""

    config: IndexConfig
    centroids: DataFrame
    postings: DataFrame
    n: int

    @property
    def dimension(self) -> int:
        return self.config.dimension

    def posting_scan(self, shard_id: int, centroid_ids: list[int] | None = None) -> DataFrame:
        """The lists of a shard, or some of them in the order of request: ``place``, ``centroid_id``, columns of rows.

        Shard and centroids are literals, so the scan opens one partition and skips row groups by their bounds.
        """
        own = {r["centroid_id"] for r in self.centroids.where(F.col("shard_id") == shard_id).select("centroid_id").collect()}
        if not own:
            raise NotFound(f"shard {shard_id}")
        if missing := [c for c in centroid_ids or [] if c not in own]:
            raise NotFound(f"centroids {missing} in shard {shard_id}")
        rows = self.postings.where(F.col("shard_id") == shard_id)
        if centroid_ids is None:
            return rows.withColumn("place", F.col("centroid_id"))
        order = F.array_position(F.array(*[F.lit(c) for c in centroid_ids]), F.col("centroid_id"))
        return rows.where(F.col("centroid_id").isin(centroid_ids)).withColumn("place", order.cast("int"))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, system = _path(spark, path)
    system.delete(p, True)


def fit(records: DataFrame, config: IndexConfig, seed: int = 42, k: int | None = None, now: int | None = None, sample_rows: int | None = None, ordinals: bool = True, hierarchy: bool | None = None) -> IvfIndex:
    """Build and write an index over (``external_id``, ``values``[, ``timestamp``]).

    Cluster centres are fitted on the driver on a sample of about ``sample_rows`` rows (by default 50,000, or 32 per
    centre where that is more), the same whatever the layout of the data; every row is then assigned in one pass, exactly
    with ``hierarchy`` False, through super-centroids where there are over a hundred centres otherwise. Centres are clustered again into shards. Lists that
    got no row are dropped and the others renumbered from 0. The metadata is written last, as the commit.

    ``id`` is a row's 0-based position in the order of external ids; without ``ordinals``, which saves sorting the
    data, it is a hash. Metadata of an earlier build in the same place is removed first, so that a build that fails
    leaves no index behind.
    """
    spark = records.sparkSession
    n = check_records(records, config.dimension)
    if "timestamp" not in records.columns:
        records = records.withColumn("timestamp", F.lit(None).cast("long"))
    stamped = with_timestamps(records, int(time.time()) if now is None else now)
    k = k or kmeans.suggest_nlist(n)
    sample = kmeans.bounded_sample(records, sample_rows or max(kmeans.SEED_ROWS, kmeans.ROWS_PER_CENTROID * k), n, seed=seed)
    centres, _ = kmeans.mini_batch(sample, k, kmeans.suggest_iterations(n), seed=seed)
    shards_wanted = math.ceil(math.sqrt(k))
    _, shard_of = kmeans.mini_batch(centres, shards_wanted, 100, seed=seed * 31 + 7)
    typed = stamped.select(F.col("external_id").cast("long").alias("external_id"), "timestamp", F.col("values").cast("array<float>").alias("values"))
    typed = with_ordinals(typed) if ordinals else typed.withColumn("id", F.xxhash64("external_id", "values"))
    assigned = kmeans.assign(typed.select("id", "external_id", "timestamp", "values"), centres, name="old", hierarchy=hierarchy)
    return write(assigned, centres, shard_of, config, seed)


def write(assigned: DataFrame, centres: np.ndarray, shard_of: np.ndarray, config: IndexConfig, seed: int = 42) -> IvfIndex:
    """Write an index of rows (``id``, ``external_id``, ``timestamp``, ``values``, ``old``), old being the place of
    their centre; ``shard_of`` has the shard of each centre. Lists without rows are dropped, the others renumbered."""
    spark = assigned.sparkSession
    _delete(spark, f"{config.index_dir.rstrip('/')}/meta")
    staged = f"{config.shards_dir.rstrip('/')}/_staged"
    assigned.write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    sizes = {r["old"]: r["count"] for r in rows.groupBy("old").count().collect()}  # one row per centroid
    kept, n = sorted(sizes), sum(sizes.values())
    number = {old: new for new, old in enumerate(kept)}
    table = spark.createDataFrame([(number[o], int(shard_of[o]), int(sizes[o]), [float(x) for x in centres[o]]) for o in kept], CENTROIDS)
    lookup = spark.createDataFrame([(int(o), number[o], int(shard_of[o])) for o in kept], "old int, centroid_id int, shard_id int")
    posted = rows.join(F.broadcast(lookup), "old").drop("old")
    pieces = max(1, n // 1_000_000)
    spread = posted.repartition("shard_id", F.pmod("id", F.lit(pieces))).sortWithinPartitions("shard_id", "centroid_id", "id")
    target = f"{config.shards_dir.rstrip('/')}/lists"
    spread.write.mode("overwrite").partitionBy("shard_id").parquet(target)
    _delete(spark, staged)
    table.coalesce(1).write.mode("overwrite").parquet(f"{config.index_dir.rstrip('/')}/centroids")
    meta = {"version": VERSION, "dimension": config.dimension, "k": len(kept), "seed": seed, "n": n}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{config.index_dir.rstrip('/')}/meta")
    return load(spark, config)


def load(spark: SparkSession, config: IndexConfig) -> IvfIndex:
    """Open a written index; raises if there is none, or if it has another dimension."""
    meta_path = f"{config.index_dir.rstrip('/')}/meta"
    if not _exists(spark, f"{meta_path}/_SUCCESS"):
        raise FileNotFoundError(f"no index in {config.index_dir}")
    meta = json.loads(spark.read.text(meta_path).first()[0])
    if meta["dimension"] != config.dimension:
        raise InvalidInput(f"the index has dimension {meta['dimension']}, not {config.dimension}")
    schema = "id long, external_id long, timestamp long, values array<float>, centroid_id int, shard_id int"
    return IvfIndex(config, spark.read.schema(CENTROIDS).parquet(f"{config.index_dir.rstrip('/')}/centroids"), spark.read.schema(schema).parquet(f"{config.shards_dir.rstrip('/')}/lists"), meta["n"])


def centroid_matrix(index: IvfIndex) -> np.ndarray:
    """Centroids in the order of their ids; a few thousand rows."""
    return np.array([r["centroid"] for r in index.centroids.orderBy("centroid_id").collect()])
