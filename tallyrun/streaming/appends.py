"""A stream of rows into an append table: each micro-batch is a chunk of its own run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..store import Store


def append_stream(store: Store, rows: DataFrame, name: str, checkpoint: str, label: str | None = None) -> DataStreamWriter:
    """A writer that appends every micro-batch of ``rows`` to a name; start() runs it.

    The number of a batch is kept in its label, so a batch that Spark repeats after a
    failure is not appended twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        mark = f"{label or name}#{number}"
        store.log.replay()
        if not any(c["variant_label"] == mark for c in store.log.chunks_of(name)):
            store.stow(batch, name, label=mark)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
