"""Regressions of probes in a stream whose runs come late and out of order.

A run is held until the watermark has passed it, as an earlier one may still come before; then it is
compared with the run before it in event time. So what comes out is what a batch over all runs
gives, for every run that isn't later than the watermark allows. A probe without runs for ``keep`` of
event time is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "probe string, ts timestamp"
#: transformWithState keeps its state in this store only.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def batch_regressions(runs: DataFrame, keep_days: int = 90) -> DataFrame:
    """probe and ts of every run (probe, ts, triggered) that triggers after one that didn't, or as a probe's first.

    After more than ``keep_days`` days without a run a probe begins anew. Runs of one time are in the order of ``triggered``. Runs without a probe, time or status are left out.
    """
    rows = runs.where("probe is not null and ts is not null and triggered is not null")
    order = Window.partitionBy("probe").orderBy("ts", "triggered")
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(order))
    before = F.when(gap <= keep_days * 86_400_000, F.lag("triggered").over(order)).otherwise(0)
    return rows.withColumn("before", before).where("triggered = 1 and before = 0").select("probe", "ts")


def _milliseconds(ts) -> int:
    import datetime as dt

    at = ts.replace(tzinfo=dt.timezone.utc) if ts.tzinfo is None else ts
    return int(at.timestamp() * 1000)


class Regressions(StatefulProcessor):
    """State of a probe: its runs that the watermark hasn't passed, and the last one that it has."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, us bigint, triggered int")
        self.last = handle.getValueState("last", "ms bigint, triggered int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = set(self.handle.listTimers())
        for r in rows:
            ms = r["us"] // 1000
            self.waiting.appendValue((ms, r["us"], r["triggered"]))
            if ms not in known:
                self.handle.registerTimer(ms)
                known.add(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import datetime as dt

        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ripe = sorted((r for r in held if r[0] <= now), key=lambda r: (r[1], r[2]))
        at, before = tuple(self.last.get()) if self.last.exists() else (None, 0)
        if not ripe:
            if at is not None and at + self.keep_ms <= now:
                self.last.clear()
            return
        left = [tuple(r) for r in held if r[0] > now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        for ms, us, triggered in ripe:
            if triggered == 1 and (before == 0 or ms - at > self.keep_ms):
                yield Row(probe=key[0], ts=dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us))
            at, before = ms, triggered
        self.last.update((at, before))
        self.handle.registerTimer(max(at + self.keep_ms, now + 1))

    def close(self) -> None:
        pass


def late_regressions(runs: DataFrame, late: str = "2 days", keep_days: int = 90) -> DataFrame:
    """The rows of ``batch_regressions`` for a stream of runs (probe, ts, triggered), each once the watermark has passed it.

    Runs that come more than ``late`` after later ones are dropped by the watermark.
    """
    rows = runs.where("probe is not null and ts is not null and triggered is not null")
    rows = rows.select("probe", "ts", F.unix_micros("ts").alias("us"), F.col("triggered").cast("int").alias("triggered")).withWatermark("ts", late)
    return rows.groupBy("probe").transformWithState(Regressions(keep_days * 86_400_000), OUT, "Append", "EventTime")
