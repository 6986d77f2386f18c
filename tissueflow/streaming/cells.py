"""Cells that arrive as a stream go to the same store as batches do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tissueflow.sources import cell_store


def append_stream(cells: DataFrame, path: str, checkpoint: str, name: str = "stream", once: bool = True) -> StreamingQuery:
    """Add the micro-batches of a stream of cells to the store at path, each as one load; with once, what there is now.

    A micro-batch that is run again after a failure has the number, and so the load, of the first attempt: if that took effect it is passed over, so every
    row is in the store once.
    """

    def put(batch: DataFrame, number: int) -> None:
        cell_store.append(batch.sparkSession, path, f"{name}-{number}", {"cells": batch})

    writer = cells.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
