"""Named queries over posting lists with hot keys, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import hot_keys

#: A centroid with more than this share of a load's vectors is hot.
HOT_SHARE = 0.04


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col("load_no").cast("long").alias("load_no"), F.col("centroid_id").cast("long").alias("centroid_id"), "id"]
    return spark.read.parquet(f"{sf_dir}/postings.parquet").select(*columns)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = hot_keys.heavy_values(_postings(spark, sf_dir), ["load_no"], "centroid_id", "id", HOT_SHARE)
    return heavy.select("load_no", F.col("value").alias("centroid_id"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.distinct_per_key(_postings(spark, sf_dir), ["load_no", "centroid_id"], "id", "n_ids")


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = spark.read.parquet(f"{sf_dir}/centroid_index.parquet").groupBy(F.col("load_no").cast("long").alias("load_no"), F.col("centroid_id").cast("long").alias("centroid_id"))
    return recorded.agg(F.min("num_vectors").alias("least_recorded"), F.max("num_vectors").alias("most_recorded"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct vectors per load and centroid beside the least and greatest recorded number."""
    return _counted(spark, sf_dir).join(_recorded(spark, sf_dir), ["load_no", "centroid_id"], "left")


def p2_counts_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_counts, with every recorded load and centroid: without postings ``n_ids`` is 0."""
    a, b = _counted(spark, sf_dir).alias("a"), _recorded(spark, sf_dir).alias("b")
    keys = ["load_no", "centroid_id"]
    both = a.join(b, F.col("a.load_no").eqNullSafe(F.col("b.load_no")) & F.col("a.centroid_id").eqNullSafe(F.col("b.centroid_id")), "full")
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.coalesce("n_ids", F.lit(0).cast("long")).alias("n_ids"), "least_recorded", "most_recorded")


def p2_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the vectors' ids per load and centroid."""
    entries = hot_keys.distinct_members(_postings(spark, sf_dir), ["load_no", "centroid_id"], "id")
    return hot_keys.quantiles_per_key(entries, ["load_no", "centroid_id"], "id", [0.25, 0.5, 0.75])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_counts, p2_counts_recorded, p2_quantiles)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH entries AS (SELECT DISTINCT load_no, centroid_id, id FROM postings WHERE id IS NOT NULL),
            loads AS (SELECT load_no, count(DISTINCT id) AS n FROM entries GROUP BY load_no),
            lists AS (SELECT load_no, centroid_id, count(*) AS n FROM entries WHERE centroid_id IS NOT NULL GROUP BY load_no, centroid_id)
            SELECT CAST(a.load_no AS BIGINT) AS load_no, CAST(a.centroid_id AS BIGINT) AS centroid_id
            FROM lists a JOIN loads b ON a.load_no IS NOT DISTINCT FROM b.load_no WHERE a.n * 100 > b.n * 4""",
        "p2_counts": """
            WITH counted AS (
              SELECT CAST(load_no AS BIGINT) AS load_no, CAST(centroid_id AS BIGINT) AS centroid_id, count(DISTINCT id) AS n_ids
              FROM postings WHERE id IS NOT NULL GROUP BY 1, 2
            ), recorded AS (
              SELECT CAST(load_no AS BIGINT) AS load_no, CAST(centroid_id AS BIGINT) AS centroid_id,
                     min(num_vectors) AS least_recorded, max(num_vectors) AS most_recorded
              FROM centroid_index GROUP BY 1, 2
            )
            SELECT a.load_no, a.centroid_id, n_ids, least_recorded, most_recorded
            FROM counted a LEFT JOIN recorded b ON a.load_no = b.load_no AND a.centroid_id = b.centroid_id""",
        "p2_quantiles": """
            WITH entries AS (SELECT DISTINCT load_no, centroid_id, id FROM postings WHERE id IS NOT NULL),
            placed AS (
              SELECT load_no, centroid_id, id, row_number() OVER (PARTITION BY load_no, centroid_id ORDER BY id) AS place,
                     count(*) OVER (PARTITION BY load_no, centroid_id) AS n
              FROM entries
            ), shares AS (SELECT unnest([0.25, 0.5, 0.75]) AS share)
            SELECT CAST(load_no AS BIGINT) AS load_no, CAST(centroid_id AS BIGINT) AS centroid_id, CAST(share AS DOUBLE) AS share, id AS value
            FROM placed JOIN shares ON place = greatest(1, CAST(ceil(round(share * n, 6)) AS BIGINT))""",
    }
