"""A deterministic inverted-file index over the embeddings, in Spark and as SQL common table expressions.

Centroids start at the rows with ``vec_id`` below k, k following from the number of rows; after a fixed number of
rounds empty clusters are dropped and the others renumbered; centroids are clustered likewise into shards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import index, kmeans
from orrery.schema import IndexConfig
from orrery.session import kept_folder

ROUNDS = 3


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def seeds(e: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the first k rows, k from the number of rows."""
    k = kmeans.suggest_nlist(e.count())
    rows = e.where(F.col("vec_id") < k).orderBy("vec_id").collect()  # k rows
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)


def lloyd(e: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and centroids after so many rounds; a cluster that gets empty drops out."""
    ids, c = seeds(e)
    for _ in range(rounds):
        c, n = kmeans.lloyd_round(e, c, "embedding")
        ids, c = ids[n > 0], c[n > 0]
    return ids, c


def centroid_frame(spark: SparkSession, ids: np.ndarray, c: np.ndarray, shard: np.ndarray | None = None) -> DataFrame:
    rows = [(int(i), [float(x) for x in v], int(s)) for i, v, s in zip(ids, c, shard if shard is not None else ids)]
    return spark.createDataFrame(rows, "centroid_id long, centroid array<double>, shard_id long").select("centroid_id", "centroid", *(["shard_id"] if shard is not None else []))


def assigned(e: DataFrame, ids: np.ndarray, c: np.ndarray) -> DataFrame:
    """``vec_id``, ``embedding``, ``centroid_id``."""
    at = F.array(*[F.lit(int(i)) for i in ids])
    placed = kmeans.assign(e, c, "embedding", "at", hierarchy=False)
    return placed.select("vec_id", "embedding", F.element_at(at, F.col("at") + 1).cast("long").alias("centroid_id"))


@dataclass(frozen=True)
class Built:
    """centroids (centroid_id, centroid, shard_id), postings (vec_id, embedding, centroid_id, shard_id), old ids."""

    centroids: DataFrame
    postings: DataFrame
    old: np.ndarray
    sizes: np.ndarray
    shard: np.ndarray


def shards(c: np.ndarray) -> np.ndarray:
    """The shard of each centroid: the nearest of as many super-centroids as the root of their number."""
    s = c[: math.ceil(math.sqrt(len(c)))]
    for _ in range(ROUNDS):
        mean, m = kmeans.means(c, kmeans.nearest(c, s), len(s), s)
        s = mean[m > 0]
    return kmeans.nearest(c, s)


def build(spark: SparkSession, sf_dir: str) -> Built:
    e = embeddings(spark, sf_dir)
    ids, c = lloyd(e)
    _, n = kmeans.lloyd_round(e, c, "embedding")
    old, c, sizes = ids[n > 0], c[n > 0], n[n > 0]
    shard = shards(c)
    number = np.arange(len(c))
    centroids = centroid_frame(spark, number, c, shard)
    own = F.array(*[F.lit(int(x)) for x in shard])
    postings = assigned(e, number, c).withColumn("shard_id", F.element_at(own, (F.col("centroid_id") + 1).cast("int")).cast("long"))
    return Built(centroids, postings, old, sizes, shard)


_written: dict[tuple[str, str], index.IvfIndex] = {}


def written(spark: SparkSession, sf_dir: str) -> index.IvfIndex:
    """The same as an index on disk, written once per application: search opens only the shards it needs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        e = embeddings(spark, sf_dir)
        ids, c = lloyd(e)
        placed = kmeans.assign(e, c, "embedding", "old", hierarchy=False)
        rows = placed.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("external_id"), F.lit(0).cast("long").alias("timestamp"), F.col("embedding").alias("values"), "old")
        shard = np.zeros(len(c), dtype=int)
        used = np.array(sorted(r["old"] for r in placed.select("old").distinct().collect()), dtype=int)
        shard[used] = shards(c[used])
        root = kept_folder(spark, "index")
        _written[key] = index.write(rows, c, shard, IndexConfig(c.shape[1], f"{root}/index", f"{root}/shards"))
    return _written[key]


# ---- the same as SQL


def distance_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def nearest_sql(points: str, point_id: str, vector: str, centroids: str) -> str:
    return f"""SELECT {point_id}, cid, d FROM (SELECT p.{point_id}, c.cid, {distance_sql(f'p.{vector}', 'c.c')} AS d FROM {points} p, {centroids} c)
      QUALIFY row_number() OVER (PARTITION BY {point_id} ORDER BY d, cid) = 1"""


def means_sql(points: str, point_id: str, vector: str, labels: str) -> str:
    return f"""SELECT cid, list(x ORDER BY pos) AS c FROM (
        SELECT cid, pos, avg(x) AS x FROM (
          SELECT a.cid, unnest(p.{vector})::DOUBLE AS x, generate_subscripts(p.{vector}, 1) AS pos FROM {points} p JOIN {labels} a USING ({point_id})
        ) GROUP BY cid, pos) GROUP BY cid"""


def chain_sql(rounds: int = ROUNDS, full: bool = True) -> str:
    """Expressions e, kk, c0, (a1, c1), ...; with ``full`` also assigned, kept, cen, posting, shard."""
    parts = [
        "e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings)",
        "kk AS (SELECT CASE WHEN count(*) < 10000 THEN greatest(1, floor(sqrt(count(*)))) WHEN count(*) < 100000 THEN 2 * ceil(sqrt(count(*))) ELSE 4 * ceil(sqrt(count(*))) END AS k FROM e)",
        "c0 AS MATERIALIZED (SELECT vec_id AS cid, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM e, kk WHERE vec_id < k)",
    ]
    for r in range(1, rounds + 1):
        parts += [f"a{r} AS MATERIALIZED ({nearest_sql('e', 'vec_id', 'embedding', f'c{r - 1}')})", f"c{r} AS MATERIALIZED ({means_sql('e', 'vec_id', 'embedding', f'a{r}')})"]
    if full:
        last = f"c{rounds}"
        parts += [
            f"assigned AS MATERIALIZED ({nearest_sql('e', 'vec_id', 'embedding', last)})",
            "kept AS MATERIALIZED (SELECT cid, row_number() OVER (ORDER BY cid) - 1 AS centroid_id, n_vectors FROM (SELECT cid, count(*) AS n_vectors FROM assigned GROUP BY cid))",
            f"cen AS MATERIALIZED (SELECT centroid_id, n_vectors, cid AS old_id, c AS centroid FROM kept JOIN {last} USING (cid))",
            "s0 AS MATERIALIZED (SELECT centroid_id AS cid, centroid AS c FROM cen WHERE centroid_id < (SELECT ceil(sqrt(count(*))) FROM cen))",
        ]
        for r in range(1, ROUNDS + 1):
            parts += [f"t{r} AS MATERIALIZED ({nearest_sql('cen', 'centroid_id', 'centroid', f's{r - 1}')})", f"s{r} AS MATERIALIZED ({means_sql('cen', 'centroid_id', 'centroid', f't{r}')})"]
        parts += [
            f"named AS (SELECT cid, c, row_number() OVER (ORDER BY cid) - 1 AS shard_id FROM s{ROUNDS})",
            f"t AS MATERIALIZED ({nearest_sql('cen', 'centroid_id', 'centroid', f's{ROUNDS}')})",
            "shard AS MATERIALIZED (SELECT centroid_id, shard_id FROM t JOIN named USING (cid))",
            "posting AS MATERIALIZED (SELECT a.vec_id, e.embedding, k.centroid_id, s.shard_id FROM assigned a JOIN e USING (vec_id) JOIN kept k USING (cid) JOIN shard s USING (centroid_id))",
        ]
    return "WITH " + ",\n".join(parts)


def search_sql(nq: int | str, n_probe: str, k: int, name: str = "found") -> str:
    """Expressions probe and ``name`` (query_id, rank, external_id, distance) after the chain."""
    return f""", probe_{name} AS MATERIALIZED (
      SELECT query_id, centroid_id, rank FROM (
        SELECT q.vec_id AS query_id, c.centroid_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance_sql('q.embedding', 'c.centroid')}, c.centroid_id) AS rank
        FROM e q, cen c WHERE q.vec_id < {nq}) WHERE rank <= {n_probe}
    ), {name} AS MATERIALIZED (
      SELECT query_id, rank, external_id, distance, embedding FROM (
        SELECT p.query_id, x.vec_id AS external_id, x.embedding, {distance_sql('q.embedding', 'x.embedding')} AS distance,
               row_number() OVER (PARTITION BY p.query_id ORDER BY {distance_sql('q.embedding', 'x.embedding')}, x.vec_id) AS rank
        FROM probe_{name} p JOIN e q ON q.vec_id = p.query_id JOIN posting x USING (centroid_id)) WHERE rank <= {k})"""


def exact_sql(nq: int, k: int, name: str = "truth") -> str:
    return f""", {name} AS MATERIALIZED (
      SELECT query_id, rank, external_id, distance FROM (
        SELECT q.vec_id AS query_id, x.vec_id AS external_id, {distance_sql('q.embedding', 'x.embedding')} AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance_sql('q.embedding', 'x.embedding')}, x.vec_id) AS rank
        FROM e q, e x WHERE q.vec_id < {nq}) WHERE rank <= {k})"""
