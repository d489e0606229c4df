"""Probe runs as a stream: totals of each day, and regressions as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_totals(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """day, probe, runs and triggered of runs (probe, ts, triggered), once no more can come for the day."""
    day = F.window("ts", "1 day")
    return runs.withWatermark("ts", late).groupBy(day, "probe").agg(F.count("*").alias("runs"), F.sum("triggered").alias("triggered")).select(F.col("window.start").alias("day"), "probe", "runs", "triggered")


def regressions(runs: DataFrame) -> DataFrame:
    """probe and ts of every run that triggers after one that didn't, or as a probe's first.

    The state of a probe is its last status. Runs of one batch are taken in the order of ts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        before = rows["triggered"].shift(1, fill_value=last)
        state.update((int(rows["triggered"].iloc[-1]),))
        hit = rows[(rows["triggered"] == 1) & (before == 0)]
        yield pd.DataFrame({"probe": [key[0]] * len(hit), "ts": hit["ts"]})

    return runs.groupBy("probe").applyInPandasWithState(step, "probe string, ts timestamp", "last int", "append", GroupStateTimeout.NoTimeout)
