"""Incremental triggers: debounced change events and exactly-once refresh batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, quiet: str, key: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """One row per burst of events of a key that ends after `quiet` without one; works on batches and on streams.

    On a stream give `late`, the watermark: a burst is put out when the watermark passes its end.
    """
    source = events.withWatermark(at, late) if late else events
    return source.groupBy(key, F.session_window(at, quiet).alias("burst")).agg(F.count("*").alias("n_events")).select(key, F.col("burst.start").alias("started"), F.col("burst.end").alias("flushed"), "n_events")


def on_change(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run `refresh` for each batch of changes. The batch is only the trigger; a refresh that recomputes what changed
    may run twice for a batch without harm, so the sink is exactly-once in effect."""
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
