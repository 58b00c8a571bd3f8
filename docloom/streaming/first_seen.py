"""Pages of a stream whose url or content is new, by keyed states of both kinds that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen_stream(stream: DataFrame, url: str, digest: str, order: str, days: float | None = None) -> DataFrame:
    """The rows of a stream whose ``url`` has not come before, and those whose ``digest`` has not, of a micro-batch the one of the smallest ``order``.

    Each row stands once for its url and once for its digest, whose states hold no more than when they go: ``days`` after the key was
    first told (none: never). A row that is new in both ways comes twice in one micro-batch: ``once`` makes it one. Null keys are
    not seen as new.
    """
    schema = stream.schema
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in (url, digest)])).alias("_key")
    rows = stream.select("*", keys).where("_key.key IS NOT NULL").select(*stream.columns, F.col("_key.kind").alias("_kind"), F.col("_key.key").alias("_own"))

    def watch(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        known, first = state.exists and (days is None or state.get[0] > now), None
        for part in parts:  # of each part at most one row is held
            if not known and len(part):
                one = part.loc[[part[order].idxmin()]]
                first = one if first is None or one[order].iloc[0] < first[order].iloc[0] else first
        if first is not None:
            # counted from the first time, so that a known key that goes on coming expires too
            until = 0 if days is None else now + int(days * 86_400_000)
            state.update((until,))
            yield first.drop(columns=["_kind", "_own"])
        if days is not None:
            state.setTimeoutDuration(max(state.get[0] - now, 1))

    timeout = GroupStateTimeout.NoTimeout if days is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("_kind", "_own").applyInPandasWithState(watch, schema, "until long", "append", timeout)


def once(batch: DataFrame, order: str) -> DataFrame:
    """The rows of a micro-batch of ``first_seen_stream`` once each, for ``foreachBatch``."""
    return batch.dropDuplicates([order])
