"""The engine's streaming queries: the batch operators inside foreachBatch, with versions for exactly-once effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import TableDedup
from ..operators.items import new_rows, result_rows
from ..operators.results import forward, task_messages
from ..sources.versions import ChangedTable, VersionedTable


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs step on each micro-batch; without an interval, on all there is now. Offsets are committed after the
    step whatever it found, so an interrupted batch runs again with the same id."""
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def discover_batch(pointers: DataFrame, items: DataFrame, key: str = "id", time: str = "timestamp", arrival: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(new, rows): the batch's new pointers, the last of each key, and the rows that they add to the items, each
    found at the time of that pointer."""
    new = TableDedup(items).filter(pointers, key, arrival)
    return new, new_rows(items, new, key, time, arrival)


def discovery(pointers: DataFrame, items: ChangedTable, tasks: VersionedTable, collection: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """New pointers of a stream (dst, timestamp, seq) enter the items, and their tasks the tasks' version of the
    batch. Tasks are written before the items, so a batch that stops in between is repeated whole. A batch reads the
    items' keys and writes its new ones."""

    def step(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(F.col("dst.id").alias("id"), "dst", "timestamp", "seq")
        new, rows = discover_batch(flat.persist(), items.changes(before=batch_id))
        try:
            tasks.write(task_messages(new, collection), batch_id)
            items.write(rows, batch_id)
        finally:
            flat.unpersist()
        items.compact(batch_id)

    return start(pointers, step, checkpoint, every)


def reporter(results: DataFrame, items: ChangedTable, checkpoint: str, every: str | None = None, key_type: str = "string") -> StreamingQuery:
    """Results of a stream (item_id, finish_time, seq) are added up in the items. A batch writes its own sums and reads
    no items."""

    def step(batch: DataFrame, batch_id: int) -> None:
        items.write(result_rows(batch, key_type=key_type), batch_id)
        items.compact(batch_id)

    return start(results, step, checkpoint, every)


def forwarder(results: DataFrame, out: VersionedTable, topic: str, finish_time, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Results leave, projected; the offset moves on after the write, so each leaves once at least."""

    def step(batch: DataFrame, batch_id: int) -> None:
        out.write(forward(batch, topic, finish_time), batch_id)

    return start(results, step, checkpoint, every)
