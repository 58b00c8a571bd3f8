"""Streaming jobs over heartbeat events: windows with late data, silent tasks, and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind; events later than ``late`` behind the newest are let go."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def hung_tasks(events: DataFrame, key: str, time: str, minutes: int = 5, late: str = "0 seconds") -> DataFrame:
    """key, last_seen of each task that is silent for some minutes of event time; it is told once, and again after a new silence."""
    schema = events.schema
    kind = schema[key].dataType.simpleString()

    def watch(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame({key: [own[0]], "last_seen": [pd.Timestamp(seen, unit="ms")]})
            return
        seen = state.get[0] if state.exists else 0
        for batch in batches:
            seen = max(seen, int(batch[time].max().value // 1_000_000))
        state.update((seen,))
        state.setTimeoutTimestamp(max(seen + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return (
        events.select(key, time)
        .withWatermark(time, late)
        .groupBy(key)
        .applyInPandasWithState(watch, f"{key} {kind}, last_seen timestamp", "seen long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def unexpired(log: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """The rows of a log that are younger than some days."""
    return log.where(F.col(time) > now - F.make_dt_interval(F.lit(days)))
