"""Recall, clustering quality, structure checks and timing."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import l2_squared


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(``query_id``, ``recall``): the share of each query's true (query_id, external_id) that was found."""
    hit = found.select("query_id", "external_id").distinct().withColumn("hit", F.lit(1.0))
    return truth.select("query_id", "external_id").distinct().join(hit, ["query_id", "external_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def first_recall(truth: DataFrame, found: DataFrame, ranks: Iterable[int], k: int) -> DataFrame:
    """(``rank``, ``recall``): the share of queries whose true nearest is among the first so many found; ranks beyond
    k are left out."""
    spark = truth.sparkSession
    first = truth.where("rank = 1").select("query_id", "external_id")
    at = first.join(found.select("query_id", "external_id", F.col("rank").alias("at")), ["query_id", "external_id"], "left")
    wanted = spark.createDataFrame([(r,) for r in ranks if r <= k], "rank int")
    return at.crossJoin(F.broadcast(wanted)).groupBy("rank").agg(F.avg(F.when(F.col("at") <= F.col("rank"), 1.0).otherwise(0.0)).alias("recall"))


def intersection(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row, ``measure``: the pairs in both first k over queries times k."""
    t = truth.where(F.col("rank") <= k).select("query_id", "external_id")
    both = t.join(found.where(F.col("rank") <= k).select("query_id", "external_id"), ["query_id", "external_id"])
    asked = t.agg(F.count_distinct("query_id").alias("q"))
    return both.agg(F.count("*").alias("n")).crossJoin(asked).select((F.col("n") / (F.col("q") * k)).alias("measure"))


def inertia(labelled: DataFrame, centroids: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row, ``inertia``: the sum of squared distances of rows to their centroids, broadcast."""
    joined = labelled.join(F.broadcast(centroids), "centroid_id")
    return joined.agg(F.sum(l2_squared(F.col(vector_col), F.col("centroid"))).alias("inertia"))


def assignment_violations(best: DataFrame, mine: DataFrame, slack: float = 1e-5) -> DataFrame:
    """One row, ``violations``: rows whose nearest centroid (``id``, ``distance``) is nearer, in distance, than their own
    (``id``, ``mine``) less ``slack``."""
    return best.join(mine, "id").agg(F.count_if(F.sqrt("distance") < F.sqrt("mine") - slack).alias("violations"))


def structure_violations(index) -> DataFrame:
    """One row counting what would break an index: rows of another dimension or in a wrong shard, repeated rows,
    lists whose recorded size differs."""
    rows = index.postings.join(F.broadcast(index.centroids.select("centroid_id", F.col("shard_id").alias("right_shard"), "n_vectors")), "centroid_id", "left")
    counts = rows.agg(F.count_if(F.size("values") != index.dimension).alias("dimensions"), F.count_if(F.col("right_shard").isNull() | (F.col("right_shard") != F.col("shard_id"))).alias("shards"), F.count("*").alias("rows"))
    sizes = index.postings.groupBy("centroid_id").count().join(F.broadcast(index.centroids), "centroid_id", "full").agg(F.count_if(F.coalesce("count", F.lit(0)) != F.coalesce("n_vectors", F.lit(0))).alias("sizes"))
    return counts.crossJoin(sizes)


def timed(run: Callable[[], DataFrame], queries: int, least_s: float = 3.0) -> dict:
    """Repeat a search until ``least_s`` has passed: ms per query, queries per second, runs."""
    runs, began = 0, time.perf_counter()
    while True:
        run().write.format("noop").mode("overwrite").save()
        runs += 1
        if (took := time.perf_counter() - began) >= least_s:
            return {"ms_per_query": took * 1000 / (runs * queries), "qps": runs * queries / took, "nrun": runs}


def sweep(search: Callable[[int], DataFrame], truth: DataFrame, queries: int, k: int, n_probes: Iterable[int], least_s: float = 3.0) -> list[dict]:
    """For each n_probe the timing, the recall of the true nearest at 1, 10 and 100, and the intersection."""
    out = []
    for n in n_probes:
        found = search(n)
        firsts = {f"R@{r['rank']}": r["recall"] for r in first_recall(truth, found, (1, 10, 100), k).collect()}
        out.append({"nprobe": n, "recalls": firsts, "intersection": intersection(truth, found, k).first()[0], **timed(lambda n=n: search(n), queries, least_s)})
    return out


def save_results(results: list[dict], folder: str) -> None:
    """results.json and results.md in a local folder."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / "results.json").write_text(json.dumps(results, indent=2))
    names = list(dict.fromkeys(k for r in results for k in r))
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r.get(n, "")) for n in names) + " |" for r in results)]
    (path / "results.md").write_text("\n".join(lines) + "\n")
