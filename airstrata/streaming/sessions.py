"""Exceedance sessions in update mode, with a state of their own that falls behind the watermark.

For each station the open sessions are kept: begin, end, readings, peak. Readings may come in any order within the
watermark: one between two sessions joins them. A batch returns the sessions that it changed, and those that went into an
earlier one as `gone`. A timer at the end of a session and the gap drops it, since whatever could still join it would be
later than the watermark and is not let in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "station long, begins timestamp, ends timestamp, readings long, peak double, gone boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(open_: list[tuple], new: list[tuple], gap: int) -> list[tuple]:
    """Sessions (begin, end, readings, peak) of both, joined where no more than the gap lies between them."""
    out: list[list] = []
    for begin, end, n, peak in sorted([*open_, *new]):
        if out and begin - out[-1][1] <= gap:
            out[-1] = [out[-1][0], max(out[-1][1], end), out[-1][2] + n, max(out[-1][3], peak)]
        else:
            out.append([begin, end, n, peak])
    return [tuple(x) for x in out]


class Sessions(StatefulProcessor):
    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begins long, ends long, readings long, peak double")

    def _keep(self, sessions: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer((min(s[1] for s in sessions) + self.gap) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(s) for s in self.open.get()]
        now = before
        for batch in rows:
            at = batch["ts"].dt.as_unit("us").astype("int64")
            now = joined(now, [(t, t, 1, v) for t, v in zip(at.tolist(), batch["pm25"].tolist())], self.gap)
        self._keep(now)
        begins = {s[0] for s in now}
        out = [(*s, False) for s in now if s not in before] + [(*s, True) for s in before if s[0] not in begins]
        yield pd.DataFrame({
            "station": [key[0]] * len(out), "begins": pd.to_datetime([s[0] for s in out], unit="us"), "ends": pd.to_datetime([s[1] for s in out], unit="us"),
            "readings": [s[2] for s in out], "peak": [s[3] for s in out], "gone": [s[4] for s in out],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([tuple(s) for s in self.open.get() if s[1] + self.gap >= late])
        return iter([])

    def close(self) -> None:
        pass


def open_sessions(stream: DataFrame, above: float = 250.0, gap_hours: float = 6.0) -> DataFrame:
    """Sessions of readings above a level, by station; times in the session's time zone. The state needs the RocksDB
    store, which the session must name before the query starts; `drained` with `keys` station and begins reads it."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.where(F.col("pm25") > above).select(F.col("station").cast("long").alias("station"), "ts", "pm25")
    return rows.groupBy("station").transformWithStateInPandas(Sessions(int(gap_hours * 3600)), OUT, "Update", "EventTime")
