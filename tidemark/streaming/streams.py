"""Streams into a table and lookup joins over streams, by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidemark.config import retried
from tidemark.operators.lookup import lookup_join
from tidemark.operators.table import Table


def upsert_stream(
    table: Table, stream: DataFrame, checkpoint: str, kind_col: str | None = None, order_by: Iterable[str] = (), name: str = "upserts", maintain: bool = True,
    interval: str = "50 milliseconds",
) -> DataStreamWriter:
    """A writer (call ``start()``) that appends each micro-batch to ``table``.
    A batch that was written before a failure is recognised by its number and
    skipped. In a batch, ``order_by`` says which change of a key is later."""

    def write(batch: DataFrame, number: int) -> None:
        if maintain:  # makes room, should an earlier batch have left too many runs
            table.maintain()
        retried(lambda: table.append(batch, kind_col, order_by, stream=name, batch_id=number), retries=10)
        if maintain:
            table.maintain()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def lookup_stream(
    stream: DataFrame, table: Table, on: Mapping[str, str], then: Callable[[DataFrame, int], None], checkpoint: str, how: str = "left", **options,
) -> DataStreamWriter:
    """A writer that joins each micro-batch with the table as it is when the
    batch runs (its manifest is loaded each time; only the cells of the batch's keys
    are opened) and hands the result to ``then``. A base that cannot be read is tried again."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            retried(lambda: then(lookup_join(kept, table.refresh(), on, how, prune=True, **options), number))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
