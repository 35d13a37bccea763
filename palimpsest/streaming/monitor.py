"""Live monitoring of sessions by stateful streaming: failures, retries, refills and idle time.

Events: session_id, ts, kind (turn, step, success, failure, overflow), series, tokens, batches.
Decisions: session_id, ts, action (compact, retry, refuse, clear), reason, failures, attempts, refills.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "session_id long, ts timestamp, kind string, series string, tokens long, batches long"
DECISIONS = "session_id long, ts timestamp, action string, reason string, failures long, attempts long, refills long"


class SessionMonitor(StatefulProcessor):
    """One small state row for each session; ``idle_ms`` after its last event a timer asks to clear tool output."""

    def __init__(self, trigger: int, max_failures: int = 3, max_retries: int = 3, max_refills: int = 3, idle_ms: int = 3_600_000):
        self.trigger, self.max_failures, self.max_retries, self.max_refills, self.idle_ms = trigger, max_failures, max_retries, max_refills, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "failures long, series string, attempts long, turn string, refills long, compacted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, series, attempts, turn, refills, compacted = self.state.get() if self.state.exists() else (0, None, 0, None, 0, False)
        out = []
        events = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for e in events.itertuples():
            action = reason = None
            if e.kind == "turn":
                turn, refills, compacted = e.series, 0, False
            elif e.kind == "success":
                failures = 0
            elif e.kind == "failure":
                failures += 1
            elif e.kind == "overflow":
                attempts = attempts + 1 if series == e.series else 1
                series = e.series
                action, reason = ("retry", "overflow") if attempts <= self.max_retries and failures < self.max_failures else ("refuse", "attempts")
            elif e.kind == "step" and e.tokens >= self.trigger:
                quick = compacted and e.batches < 3
                refills = refills + 1 if quick else 0
                if failures >= self.max_failures:
                    action, reason = "refuse", "failures"
                elif refills >= self.max_refills:
                    action, reason = "refuse", "refills"
                else:
                    action, reason, compacted = "compact", "pressure", True
            if action:
                out.append((key[0], e.ts, action, reason, failures, attempts, refills))
        self.state.update((failures, series, attempts, turn, refills, compacted))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "ts", "action", "reason", "failures", "attempts", "refills"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, _, attempts, _, refills, _ = self.state.get() if self.state.exists() else (0, None, 0, None, 0, False)
        at = pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, "clear", "idle", failures, attempts, refills)], columns=["session_id", "ts", "action", "reason", "failures", "attempts", "refills"])


def monitor(events: DataFrame, **limits: int) -> DataFrame:
    """Decisions about a stream of events. The RocksDB state store must be set in the session."""
    return events.groupBy("session_id").transformWithStateInPandas(statefulProcessor=SessionMonitor(**limits), outputStructType=DECISIONS, outputMode="Append", timeMode="ProcessingTime")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def pressure_by_window(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Tokens of each session by event-time window; state of windows past the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy("session_id", F.window("ts", size)).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("events"))
