"""Runs an incremental subset whenever a stream brings source rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..config import Config, Mode
from ..engine import run_subset


def grow_on(stream: DataFrame, config: Config, catalog: Callable[[], Catalog], *, checkpoint: str, mode: Mode = Mode.GROW, available_now: bool = False) -> StreamingQuery:
    """Starts a query that runs ``config`` in ``mode`` once per micro-batch with rows.

    ``catalog`` is called anew for each batch, so that the run sees the source as it then is. A batch
    that is delivered again changes nothing, as merges are idempotent.
    """
    config = replace(config, mode=mode)

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            run_subset(config, batch.sparkSession, catalog=catalog(), with_report=False)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
