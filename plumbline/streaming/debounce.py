"""Debounced saving: a project's state is saved once no change has come for a while.

As a stream, each project keeps its pending change and a timer; a newer change within the delay takes its place and cancels
the timer, a later one lets the pending change out first. As a batch, the same rows by a look at the next change.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Milliseconds without a change after which a state is saved.
DELAY_MS = 1200


def settled(changes: DataFrame, *, key: str, time: str, order: str, delay_ms: int = DELAY_MS) -> DataFrame:
    """The rows of ``changes`` that no other change of their key follows within the delay; equal times stand by ``order``."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, order))
    wait = F.expr(f"make_dt_interval(0, 0, 0, {delay_ms / 1000})")
    return changes.withColumn("__next", following).where(F.col("__next").isNull() | (F.col("__next") - F.col(time) >= wait)).drop("__next")


class _Pending(StatefulProcessor):
    def __init__(self, schema: StructType, time: str, order: str, delay_ms: int):
        self.schema, self.time, self.order, self.delay = schema, time, order, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", self.schema)

    def _place(self, row: Row) -> tuple[int, Any]:
        """A change's milliseconds and its order; times come with a zone or in the worker's own."""
        return round(row[self.time].timestamp() * 1000), row[self.order]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = Row(**dict(zip(self.schema.fieldNames(), self.pending.get(), strict=True))) if self.pending.exists() else None
        for row in sorted(rows, key=self._place):
            if last is not None and self._place(row)[0] - self._place(last)[0] >= self.delay:
                yield last
            if last is None or self._place(row) >= self._place(last):
                last = row
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = self._place(last)[0] + self.delay
        self.pending.update(tuple(last[c] for c in self.schema.fieldNames()))
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.pending.exists():
            yield Row(**dict(zip(self.schema.fieldNames(), self.pending.get(), strict=True)))
            self.pending.clear()

    def close(self) -> None:
        pass


def settled_stream(changes: DataFrame, *, key: str, time: str, order: str, delay_ms: int = DELAY_MS, late: str = "1 seconds") -> DataFrame:
    """The stream of the states to save, each once the watermark has passed the delay after it.

    ``time`` is a timestamp; changes later than ``late`` may come after their state is saved, and then save it anew if they
    are the newest. A change older than the pending one of its key is dropped, as it is not the state any more. Sessions
    need the RocksDB state store.
    """
    marked = changes.withWatermark(time, late)
    processor = _Pending(changes.schema, time, order, delay_ms)
    return marked.groupBy(key).transformWithState(processor, changes.schema, outputMode="Append", timeMode="EventTime")
