"""App sessions whose changes may come in any order within the lateness: a stateful processor with timers.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which holds state on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark.functions.columns import seconds_of
from mnemospark.operators.sessions import LEAST_SESSION

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "device_id bigint, package string, started_s bigint, ended_s bigint"


class SessionProcessor(StatefulProcessor):
    """Waiting changes by (time, event) until the watermark has passed them, then the open session.

    A change that comes again replaces itself; one older than what has been applied comes too late. So a device's state
    has its open session and the changes of at most the lateness, whatever the stream's length.
    """

    def __init__(self, least_seconds: int, idle_ms: int):
        self.least, self.idle = least_seconds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms bigint, event_id bigint", "package string")
        self.open = handle.getValueState("open", "package string, started_s bigint, last_s bigint, last_ms bigint, last_id bigint, timer_ms bigint")

    def _held(self) -> list:
        return list(self.open.get()) if self.open.exists() else [None, None, None, None, None, None]

    def _timer(self, held: list, at: int) -> None:
        """One timer a device: an earlier one replaces it."""
        if held[5] is None or at < held[5]:
            if held[5] is not None:
                self.handle.deleteTimer(held[5])
            self.handle.registerTimer(at)
            held[5] = at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for frame in rows:
            for event, package, ms in zip(frame["event_id"], frame["package"], frame["at_ms"], strict=True):
                at = (int(ms), int(event))
                if held[3] is None or at > (held[3], held[4]):
                    self.waiting.updateValue(at, (None if pd.isna(package) else package,))
                    self._timer(held, at[0])
        self.open.update(tuple(held))
        yield pd.DataFrame(columns=["device_id", "package", "started_s", "ended_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        package, started, last, last_ms, last_id, timer = self._held()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = None
        out: list[tuple] = []

        def close(ended: int) -> None:
            if package is not None and ended - started >= self.least:
                out.append((key[0], package, started, ended))

        for at, value in sorted((tuple(k), v[0]) for k, v in self.waiting.iterator()):
            if at[0] > now:
                break
            self.waiting.removeKey(at)
            seconds = at[0] // 1000
            if value != package:
                if package is not None:
                    close(seconds)
                package, started = value, seconds
            last, last_ms, last_id = seconds, *at
        left = min((k[0] for k in self.waiting.keys()), default=None)
        if left is None and package is not None and last_ms + self.idle <= now:
            close(last)
            package = None
        held = [package, started, last, last_ms, last_id, timer]
        if left is not None:
            self._timer(held, left)
        elif package is not None:
            self._timer(held, last_ms + self.idle)
        self.open.update(tuple(held))
        yield pd.DataFrame(out, columns=["device_id", "package", "started_s", "ended_s"])

    def close(self) -> None:
        pass


def ordered_app_sessions(changes: DataFrame, lateness: str = "1 hour", least_seconds: int = LEAST_SESSION) -> DataFrame:
    """(device_id, package, started_s, ended_s) of changes (device_id, event_id, package, occurred_at), as sessions.app_sessions has them.

    Changes may be late by up to ``lateness`` and come more than once, in any order and split over micro-batches in
    any way: the sessions are the same. A session without further changes closes at its last one when the watermark
    has gone ``lateness`` past it.
    """
    spark = changes.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    idle = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {lateness}) AS ms").first().ms
    timed = changes.withColumn("event_ts", F.col("occurred_at").cast("timestamp")).withWatermark("event_ts", lateness)
    timed = timed.select("device_id", "event_id", "package", "event_ts", (seconds_of(F.col("occurred_at")) * 1000).alias("at_ms"))
    return timed.groupBy("device_id").transformWithStateInPandas(SessionProcessor(least_seconds, idle), SCHEMA, "append", "EventTime")
