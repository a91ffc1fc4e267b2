"""Which projects are due, kept over a stream of checks: a state and a timer a project, a log of changes as the output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.streaming.polling import CHECK_MINUTES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "project string, last_checked timestamp, due boolean, seq long"
_STATE = "last long, set_at long, minutes long, enabled boolean, due boolean, seq long, timer long"
_MINUTE = 60_000_000


class DueProcessor(StatefulProcessor):  # A25
    """State of a project: its last check, its settings, whether it is due, and the timer that will make it so. Times are microseconds, timers milliseconds."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("project", _STATE)

    def _settle(self, key: tuple, old: tuple, new: tuple, now: int) -> Iterator[pd.DataFrame]:
        """Store what is new, move the timer, and log a change of what a reader of the log would see."""
        last, set_at, minutes, enabled, was_due, seq, timer = new
        due_at = None if last is None else last + minutes * _MINUTE
        due = enabled and (due_at is None or due_at <= now * 1000)
        wanted = -(-due_at // 1000) if enabled and not due else None
        if timer != wanted:
            if timer is not None and timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        changed = due != was_due or due and last != old[0]
        self.state.update((last, set_at, minutes, enabled, due, seq + changed, wanted))
        if changed:
            yield pd.DataFrame({"project": [key[0]], "last_checked": pd.to_datetime(pd.Series([last], dtype="Int64"), unit="us"), "due": [due], "seq": [seq + 1]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else (None, None, self.minutes, True, False, 0, None)
        last, set_at, minutes, enabled, *rest = old
        for pdf in rows:
            checks = pdf.loc[pdf["minutes"].isna() & pdf["enabled"].isna(), "us"]
            if len(checks):
                last = max(int(checks.max()), last if last is not None else int(checks.max()))
            for us, m, e in pdf.loc[pdf["minutes"].notna() | pdf["enabled"].notna(), ["us", "minutes", "enabled"]].sort_values("us", kind="stable").itertuples(index=False):
                if set_at is None or us >= set_at:
                    set_at, minutes, enabled = int(us), minutes if pd.isna(m) else int(m), enabled if pd.isna(e) else bool(e)
        yield from self._settle(key, old, (last, set_at, minutes, enabled, *rest), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        yield from self._settle(key, old, (*old[:6], None), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _newest(batches):
    """Of each batch the newest check of every project, and all settings: what a hot project sends through the shuffle does not grow with its checks."""
    for pdf in batches:
        is_check = pdf["minutes"].isna() & pdf["enabled"].isna()
        checks = pdf[is_check]
        yield pd.concat([pdf[~is_check], checks.loc[checks.groupby("project")["us"].idxmax()]])


def due_log(checks: DataFrame, minutes: int = CHECK_MINUTES, late: str = "2 hours") -> DataFrame:
    """The log of a stream (project, at, minutes, enabled): rows (project, last_checked, due, seq) whenever a project becomes due or stops being due.

    A row with neither minutes nor enabled is a check; one with either is a change of settings from `at` on, and of two the later holds.
    Now is the watermark, `late` behind the newest row: a project is due once its last check is its interval behind that, or if it is
    enabled and was never checked. A row not after the watermark is dropped, so `late` is the longest that a check may be on its way. Rows
    without project or time are left out. State grows with projects, not with checks.
    """
    rows = checks.where("project is not null and at is not null").select(F.col("project").cast("string").alias("project"), F.unix_micros("at").alias("us"), F.col("minutes").cast("long").alias("minutes"), F.col("enabled").cast("boolean").alias("enabled"))
    rows = rows.mapInPandas(_newest, "project string, us long, minutes long, enabled boolean").withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return rows.groupBy("project").transformWithStateInPandas(DueProcessor(minutes), LOG, "Append", "EventTime")


def due_now(log: DataFrame) -> DataFrame:
    """(project, last_checked) of the projects whose newest row of the log says due."""
    newest = log.groupBy("project").agg(F.max_by(F.struct("last_checked", "due"), "seq").alias("x"))
    return newest.where("x.due").select("project", "x.last_checked")


def start_log(log: DataFrame, path: str, checkpoint: str):
    """Write all that the stream has now to Parquet under path and stop; a restart goes on from the checkpoint. Timers need the RocksDB state store, set here for this query alone."""
    conf = log.sparkSession.conf
    key = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, PROVIDER)
    try:
        return log.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before) if before else conf.unset(key)
