"""Bursts of changed files, kept as state until they have been quiet for long enough."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# What Spark asks of operators with timers and state of their own.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watched(path: Column, endings: list[str], dropped_dirs: list[str]) -> Column:
    """Whether a change of this path counts: its ending is one of these, and no folder on its way is a dropped one. A null
    path does not."""
    ends = F.lit(False)
    for e in endings:
        ends = ends | path.endswith(e)
    return F.coalesce(ends & ~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*[F.lit(d) for d in dropped_dirs]).cast("array<string>")), F.lit(False))


class Bursts(StatefulProcessor):
    """Events of a key wait in a list; a timer at the end of the earliest burst looks which bursts are over.

    Bursts are told apart by the times of the events, so it does not matter how they were dealt into batches.
    """

    def __init__(self, key: str, quiet_seconds: float) -> None:
        self.key, self.quiet = key, round(quiet_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, path string")
        self.first = handle.getValueState("first", "at long")

    def wake(self, last: int) -> None:
        self.handle.registerTimer(math.ceil((last + self.quiet) / 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = self.first.get()[0] if self.first.exists() else None
        for frame in rows:
            if len(frame):
                self.pending.appendList(list(frame[["at_us", "path"]].itertuples(index=False, name=None)))
                least = int(frame["at_us"].min())
                if first is None or least < first:
                    first = least
                    self.first.update((first,))
                    self.wake(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.DataFrame([tuple(r) for r in self.pending.get()], columns=["at", "path"]).sort_values(["at", "path"])
        if waiting.empty:  # a timer of a burst that an earlier event has made part of another
            return
        burst = (waiting["at"].diff() >= self.quiet).cumsum()
        spans = waiting["at"].groupby(burst).transform
        over = spans("max") + self.quiet <= now
        rest = waiting[~over]
        if len(rest):
            self.pending.put(list(rest.itertuples(index=False, name=None)))
            self.first.update((int(rest["at"].iloc[0]),))
            self.wake(int(rest["at"][burst[~over] == burst[~over].iloc[0]].max()))
        else:
            self.pending.clear()
            self.first.clear()
        if over.any():
            done = waiting.assign(started_us=spans("min"), flushed_us=spans("max") + self.quiet)[over]
            out = done.groupby(["started_us", "flushed_us", "path"], as_index=False).agg(n_events=("at", "size"))
            out.insert(0, self.key, key[0])
            yield out

    def close(self) -> None:
        pass


def changed_files(events: DataFrame, quiet_seconds: float, late: str, *, key: str, path: str = "path", at: str = "ts") -> DataFrame:
    """A row per file and burst, (key, started_us, flushed_us, path, n_events), once no event of the key has come for quiet_seconds.

    events is a stream; `late` is how much later than others events may come (the watermark's delay), later ones are
    dropped by Spark. A burst is put out when the watermark has passed its end, as many rows as it has files. Events of
    null key, path or time count for nothing. What waits is state in the checkpoint: a batch whose flush fails is run
    again from the state before it, so after a restart no file is lost and none comes twice. A key's waiting events are
    read together when its timer fires; keys are split over tasks. The session must have the state store STATE_STORE.
    """
    kind = events.schema[key].dataType.simpleString()
    seen = events.filter(F.col(key).isNotNull() & F.col(path).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = seen.select(F.col(key), F.col(path).alias("path"), F.unix_micros(at).alias("at_us"), at)
    return rows.groupBy(key).transformWithStateInPandas(Bursts(key, quiet_seconds), f"`{key}` {kind}, started_us long, flushed_us long, path string, n_events long", "Append", "EventTime")


def flushed(bursts: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Give each batch of finished bursts to `flush`, batches without one to nobody; with `every` for ever, else what is there."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            if not rows.isEmpty():
                flush(rows, number)
        finally:
            rows.unpersist()

    writer = bursts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
