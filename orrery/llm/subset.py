"""A varied subset of vectors by distributed farthest-first selection (k-center)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import neighbours as nn
from orrery.llm.cells import Cells, fit
from orrery.session import cut, ship

CANDIDATES = "id long, v binary, radius double, place int, rows long"
#: Bins per doubling of the radius, and hash bins within one, by which the cut-off is found.
RADIUS_BINS, HASH_BINS = 32, 4_096


@dataclass(frozen=True)
class Varied:
    """share: of the distinct valid vectors to select. oversample: times its share that a partition hands on.
    partition_rows, pool_rows: distinct vectors of a partition of the table and of the pool, as estimated from the sample."""

    share: float = 0.02
    oversample: float = 6.0
    partition_rows: int = 4_096
    pool_rows: int = 8_192


def farthest_first(x: np.ndarray, tie: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in farthest-first order and the distance of each to those before it; infinite for the first.

    The first is the row farthest from the mean; of equally far rows the one with the smaller ``tie``.
    """
    order = np.argsort(tie, kind="stable")
    x = x[order]
    d = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen, radii = [int(d.argmax())], [np.inf]
    left = np.full(len(x), np.inf)
    for _ in range(min(count, len(x)) - 1):
        diff = x - x[chosen[-1]]
        np.minimum(left, np.einsum("ij,ij->i", diff, diff), out=left)
        far = int(left.argmax())
        if left[far] <= 0:
            break
        chosen.append(far)
        radii.append(float(np.sqrt(left[far])))
    return order[np.array(chosen)], np.array(radii)


def _send(batches: Iterator[pa.RecordBatch], router: Cells, dimension: int) -> Iterator[pa.RecordBatch]:
    """The partition of each distinct valid vector of a batch, with its smallest id."""
    for batch in batches:
        ok, x = nn._vectors(batch.column("data"), dimension)
        if not len(ok):
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)[ok].astype(np.int64)
        first, label = nn._same(x)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        x = x[first]
        home = router.homes(x)
        salt = (np.einsum("ij,j->i", x.view(np.uint32).astype(np.uint64), nn._ODD[:dimension]) >> np.uint64(34)).astype(np.int64)
        block = (router.block[home].astype(np.int64) << 24) + salt % router.stored_parts[home]
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(least), nn._pack(x)], names=["block", "id", "v"])


def _choose(table: pa.Table, share: float, dimension: int) -> pa.Table:
    x, ids = nn._unpack(table["v"], dimension), table["id"].to_numpy()
    first, label = nn._same(x)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    x = np.ascontiguousarray(x[first])
    at, radii = farthest_first(x, least, int(np.ceil(share * len(x))))
    if len(radii) > 1:
        radii[0] = radii[1]  # the first is as far from the second as that from it, so it isn't taken for its place alone
    rows = np.r_[len(x), np.zeros(len(at) - 1, dtype=int)]
    return pa.table([pa.array(least[at]), nn._pack(x[at]), pa.array(radii), pa.array(np.arange(len(at)), pa.int32()), pa.array(rows, pa.int64())], names=["id", "v", "radius", "place", "rows"])


def varied_subset(stored: DataFrame, p: Varied = Varied(), s: nn.Similar = nn.Similar(), *, id_col: str = "id", vector_col: str = "data") -> DataFrame:
    """(``id``, ``radius``) of round(share * n) of the n distinct valid vectors, at least one if there is any.

    Copies count once, under their smallest id; rows with a null id or an invalid vector are left out; empty
    tables give an empty result; other columns are ignored.

    Vectors near each other share a partition of bounded size, which selects ``oversample`` times its share in
    farthest-first order. The selections are pooled, again by nearness into partitions of bounded size that span
    many of the first, and put in farthest-first order once more; ``radius`` is a vector's distance to those
    before it there. Partitions are merged by taking the greatest radii of all: what lies close to a selected
    vector comes late however large its group. The cut-off is found from counts of radius bins, within the last
    bin by hash, so nothing unbounded is gathered.
    """
    spark = stored.sparkSession
    ship(spark)
    router = fit(stored, vector_col, s.shape(), s.k)
    first = spark.sparkContext.broadcast(router.regrouped(router.rows, p.partition_rows))
    second = spark.sparkContext.broadcast(router.regrouped(router.rows * min(1.0, p.share * p.oversample), p.pool_rows))
    handed = min(1.0, p.share * p.oversample)
    raw = stored.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("data")).where(F.col("id").isNotNull() & F.col("data").isNotNull())
    sent = raw.mapInArrow(lambda b: _send(b, first.value, s.dimension), "block long, id long, v binary")
    pool = cut(sent.groupBy("block").applyInArrow(lambda t: _choose(t, handed, s.dimension), CANDIDATES))
    n = pool.agg(F.sum("rows")).first()[0] or 0
    wanted = max(1, round(p.share * n)) if n else 0

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = nn._unpack(batch.column("v"), s.dimension)
                home = second.value.homes(x)
                part = batch.column("id").to_numpy() % second.value.stored_parts[home]
                yield pa.RecordBatch.from_arrays([pa.array((second.value.block[home].astype(np.int64) << 24) + part), batch.column("id"), batch.column("v")], names=["block", "id", "v"])

    again = pool.select("id", "v").mapInArrow(pooled, "block long, id long, v binary")
    ranked = cut(again.groupBy("block").applyInArrow(lambda t: _choose(t, 1.0, s.dimension), CANDIDATES).select("id", "radius"))
    return greatest(ranked, wanted)


def greatest(ranked: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` rows (``id``, ``radius``) of greatest radius, by hash within the last bin of radii."""
    level = F.when(F.col("radius") == float("inf"), F.lit(1 << 20)).otherwise(F.floor(F.log2(F.greatest("radius", F.lit(1e-30))) * RADIUS_BINS)).cast("int")
    keyed = ranked.withColumn("level", level).withColumn("hash", F.xxhash64("id")).withColumn("bin", F.pmod("hash", F.lit(HASH_BINS)))
    levels = keyed.groupBy("level").agg(F.count("*").alias("n"))  # a few thousand rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(wanted) - before)))
    whole = keyed.join(levels.where("quota = n").select("level"), "level", "left_semi").select("id", "radius")
    last = keyed.join(levels.where("quota > 0 and quota < n").select("level", "quota"), "level")
    bins = last.groupBy("bin").agg(F.count("*").alias("n"), F.first("quota").alias("quota"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("bin", (F.col("quota") - before).alias("room"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("hash", "id"))
    some = last.join(bins, "bin").withColumn("place", place).where("place <= room").select("id", "radius")
    return whole.unionByName(some)
