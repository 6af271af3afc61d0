"""Structured Streaming into the store: each micro-batch is a run, and repeats of a batch are passed over.

Records are ordered by lsn, so late data needs no watermark: it is newer, whatever its event time. Range deletes act on keys that were
emitted before, so that results are read from the store and never kept as stream state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.db import Db


def ingest(stream: DataFrame, db: Db, order: list[str], checkpoint: str, name: str = "ingest", maintain_every: int = 8, after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that writes a stream (op, key, end, value and order's columns) to db. trigger: arguments of DataStreamWriter.trigger."""

    def sink(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            db.write(batch, order, (name, number))
        if maintain_every and number % maintain_every == maintain_every - 1:
            db.maintain()
        if after:
            after(number)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()
