"""Search of a stream of queries against a written index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.index import IvfIndex
from orrery.operators.search import search


def search_stream(queries: DataFrame, index: IvfIndex, output: str, checkpoint: str, k: int | None = None, n_probe: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write (``batch_id``, ``query_id``, ``rank``, ``external_id``, ``distance``) of streamed (``query_id``, ``query``).

    Each micro-batch is one batch search; it overwrites its own partition of ``output``, so a repeated batch leaves
    no second copy. ``trigger`` holds the arguments of the stream's trigger, such as ``{"processingTime": "10 seconds"}``;
    without it what is there is searched and the stream ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            search(index, held, k, n_probe).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch_id={batch_id}")
        finally:
            held.unpersist()

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
