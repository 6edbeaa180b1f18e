"""A reproducible sample that only grows: frozen bottom-k per arrival batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_records(df: DataFrame, rate: float, salt: str = "orrery", *, record: str = "external_id", batch: str = "load_no", version: str = "id") -> DataFrame:
    """Every record with its arrival batch and whether the sample holds it.

    A record is a value of ``record`` however many rows and versions it has; it arrives in its smallest
    ``batch``. Of each batch exactly ceil(rate * records arriving) are selected, those with the smallest salted
    hashes (ties: smaller record). As later batches change neither who arrived earlier nor their hashes, a
    selected record stays selected for as long as batches only get appended, in any layout or order.

    Result: ``record``, ``batch``, ``versions`` (distinct non-null values of ``version``), ``selected``.
    Rows without a record are left out. A record of which no row has a batch hasn't arrived: its batch is null
    and it isn't selected. Empty input gives an empty result; other columns are ignored.

    A batch may hold a third of all rows: its cut-off is found from counts of hash bins, and only rows of the
    bin that the cut-off falls in are ranked, so no batch is ever gathered.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    rows = df.select(F.col(record).alias("record"), F.col(batch).cast("long").alias("batch"), F.col(version).alias("version")).where(F.col("record").isNotNull())
    records = rows.groupBy("record").agg(F.min("batch").alias("batch"), F.count_distinct("version").alias("versions"))
    hashed = records.withColumn("hash", salted(F.col("record"), salt)).withColumn("bin", F.substring("hash", 1, 4))
    bins = hashed.groupBy("batch", "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("batch").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.ceil(F.round(F.lit(float(rate)) * F.sum("n").over(Window.partitionBy("batch")), 6))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), need - F.sum("n").over(so_far) + F.col("n")))
    marks = bins.where(F.col("batch").isNotNull()).select("batch", "bin", "n", quota.alias("quota"))
    marked = hashed.join(marks, ["batch", "bin"], "left")
    all_or_none = marked.where(F.coalesce(F.col("quota") == F.col("n"), F.lit(True)) | (F.col("quota") == 0)).withColumn("selected", F.coalesce(F.col("quota") > 0, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("batch", "bin").orderBy("hash", "record"))
    some = marked.where((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).withColumn("selected", place <= F.col("quota"))
    return all_or_none.unionByName(some).select("record", "batch", "versions", "selected")


def salted(record: Column, salt: str) -> Column:
    """A uniform salted hash as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{salt}:"), record.cast("string")))


def frozen_sample(df: DataFrame, rate: float, salt: str = "orrery", **names: str) -> DataFrame:
    """(``record``, ``batch``) of the selected records; see :func:`batch_records`."""
    return batch_records(df, rate, salt, **names).where("selected").select("record", "batch")
