"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a session without that setting and without a
    folder set on its context gets one of its own, which is right for a single machine (tests) only.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    folder = named or tempfile.mkdtemp(prefix="orrery-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table beside the checkpoints and return it without lineage.

    Unlike a checkpoint the table is columnar and compressed, and carries no constraints of the plan that made it, which in
    iterative operators would grow from round to round. The shuffle files that it took are deleted at once, not when the
    driver collects its garbage.
    """
    folder, conf = kept_folder(df.sparkSession, "cut"), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    kept = df.sparkSession.read.schema(df.schema).parquet(folder)
    kept._orrery_folder = folder
    return kept


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete the table that :func:`cut` wrote for ``df``; neither it nor what is derived from it may be used any more."""
    if folder := getattr(df, "_orrery_folder", None):
        _delete(df.sparkSession, folder)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that a plan writes and reads again, one parent per application."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/orrery-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="orrery-ship-")) / "orrery_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def tidy(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage.

    Spark deletes shuffle files and checkpoints once the driver has collected the objects that stand for them, and
    its heap, grown by many short queries, shrinks. Iterative operators call this between rounds, so that neither
    disk nor driver memory grows with the number of rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
