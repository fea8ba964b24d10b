"""Whole passages of a stream: a row once no later detection can belong to it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

OUT = "recording_id string, first_ms long, last_ms long, n_chirps long"
#: Event times lie this much after the rows' own: Spark's watermark begins at 0 and drops what isn't after it, as a log's first row may be.
SHIFT_MS = 10**12
#: What a session needs for this state and its timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Open(StatefulProcessor):
    """Open passages of a recording, and a timer at the end of each one's silence."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first_ms long, last_ms long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(t), int(n)) for frame in rows for t, n in frame["time_ms"].value_counts().items()]
        joined: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*map(tuple, self.open.get()), *new]):
            if joined and first - joined[-1][1] < self.gap_ms:
                start, end, count = joined[-1]
                joined[-1] = (start, max(end, last), count + n)
            else:
                joined.append((first, last, n))
        self.open.put(joined)
        for _, last, _ in joined:
            self.handle.registerTimer(last + self.gap_ms + SHIFT_MS)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Passages whose silence lies before the watermark end; a timer of a passage that went on finds nothing to end."""
        now, spans = timerValues.getCurrentWatermarkInMs() - SHIFT_MS, [tuple(s) for s in self.open.get()]
        ended = [s for s in spans if s[1] + self.gap_ms <= now]
        left = [s for s in spans if s[1] + self.gap_ms > now]
        if ended:
            self.open.put(left) if left else self.open.clear()
            yield pd.DataFrame([(key[0], *s) for s in ended], columns=["recording_id", "first_ms", "last_ms", "n_chirps"])

    def close(self) -> None:
        pass


def closed_passages(rows: DataFrame, gap_ms: int, delay: str = "10 seconds") -> DataFrame:
    """(recording_id, first_ms, last_ms, n_chirps) of each passage, once the watermark reaches its last time and the gap.

    Rows may come in any order within the delay; later ones are dropped by Spark. A gap of gap_ms or more ends a passage. State is
    the passages still open, of which a delay holds a bounded number; ended ones and their recording's state are removed. Rows
    without a recording or a time take no part. The session needs PROVIDER.
    """
    ship(rows.sparkSession)
    timed = rows.filter("recording_id IS NOT NULL AND time_ms IS NOT NULL").select("recording_id", "time_ms", F.timestamp_millis(F.col("time_ms") + SHIFT_MS).alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("recording_id").transformWithStateInPandas(_Open(gap_ms), OUT, "Append", "EventTime")
