"""The valid-time star schema: as-of filters and joins, benefit facts, lives by controller, and slowly changing loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import tasks_for

OPEN_END = "2038-01-01"
#: Slots that an interval may touch to be filed under its first one alone.
REACH = 4


def as_of(df: DataFrame, when: Column, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """The rows that are valid at ``when``: from their start up to, not including, their end."""
    return df.where((F.col(start) <= when) & (when < F.col(end)))


def as_of_join(points: DataFrame, intervals: DataFrame, key: str, when: str, start: str, end: str, days: int = 32) -> DataFrame:
    """Each point with the intervals of its key that hold it, by equality of slots of ``days``.

    An interval over few slots is a row in its first one, and points look for it in that many slots back. Longer ones are cut at the
    slots, between the first and the last point of all, so one that is open to the far end of time has no more rows than the points span.
    Points of keys without an interval are let go before that.
    """
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    first, last = points.agg(F.min(number(F.col(when))), F.max(number(F.col(when)))).first()
    if first is None:
        first, last = 1, 0
    low, high = F.greatest(number(F.col(start)), F.lit(first)), F.least(number(F.col(end)), F.lit(last))
    # -1 is the slot's mark for cut intervals, 0 for whole ones
    own = F.when(number(F.col(end)) - number(F.col(start)) < REACH, F.array(F.struct(number(F.col(start)).alias("_slot"), F.lit(0).alias("_cut"))))
    own = F.when((low <= high) & (F.col(start) < F.col(end)), F.coalesce(own, F.transform(F.sequence(low, high), lambda s: F.struct(s.alias("_slot"), F.lit(-1).alias("_cut")))))
    cut = intervals.select("*", F.inline(own))
    at = number(F.col(when))
    looked = F.array(*[F.struct((at - n).alias("_slot"), F.lit(0).alias("_cut")) for n in range(REACH)], F.struct(at.alias("_slot"), F.lit(-1).alias("_cut")))
    held = points.join(intervals.select(key).distinct(), key, "left_semi").select("*", F.inline(looked))
    return held.join(cut, [key, "_slot", "_cut"]).where((F.col(start) <= F.col(when)) & (F.col(when) < F.col(end))).drop("_slot", "_cut")


def expand_benefits(plans: DataFrame, formularies: DataFrame, benefits: dict[str, str]) -> DataFrame:
    """A row for each plan and benefit whose administrator (a column of ``formularies``) and controller (of ``plans``) are set.

    ``benefits`` maps a benefit to "administrator column,controller column".
    """
    joined = plans.join(formularies, "formulary_id")
    rows = F.array(*[F.struct(F.lit(name).alias("benefit"), F.col(own.split(",")[0]).alias("ump_id"), F.col(own.split(",")[1]).alias("controller_id")) for name, own in benefits.items()])
    out = joined.withColumn("_b", F.explode(rows)).where("_b.ump_id IS NOT NULL AND _b.controller_id IS NOT NULL")
    gone = [c for own in benefits.values() for c in own.split(",")]
    return out.select(*[c for c in joined.columns if c not in gone], "_b.*")


def ids_of_level(facts: DataFrame, level: str) -> DataFrame:
    """The distinct ids of one level, without null and 0."""
    return facts.where(F.col(level).isNotNull() & (F.col(level) != 0)).select(level).distinct()


def lives_by_controller(facts: DataFrame, chosen: Column, names: DataFrame | None = None) -> DataFrame:
    """Sums of lives by controller and channel: medical and pharmacy among the chosen facts, and over all facts."""
    lives = lambda benefit, own: F.sum(F.when(own & (F.col("benefit") == benefit), F.col("lives")).otherwise(0))
    out = facts.where("controller_id <> -1").groupBy("controller_id", "channel").agg(
        lives("medical", chosen).alias("medical_lives"),
        lives("pharmacy", chosen).alias("pharmacy_lives"),
        lives("medical", F.lit(True)).alias("medical_total"),
        lives("pharmacy", F.lit(True)).alias("pharmacy_total"),
        F.max(chosen.cast("int")).alias("_any"),
    )
    out = out.where("_any = 1").drop("_any")
    return out if names is None else out.join(names, "controller_id", "left")


def priority_lookup(facts: DataFrame, key: str, first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """``facts`` with ``name`` from the first dimension that has the key; null where neither does."""
    one = first.select(F.col(key), F.col(name).alias("_one"))
    two = second.select(F.col(key), F.col(name).alias("_two"))
    return facts.join(one, key, "left").join(two, key, "left").withColumn(name, F.coalesce("_one", "_two")).drop("_one", "_two")


def scd2_load(current: DataFrame, delivered: DataFrame, key: str, fields: list[str], when: Column) -> DataFrame:
    """The dimension after a delivery: key, fields, start_date, end_date.

    ``current`` has open and closed rows. A key whose fields differ closes its open row at ``when`` and opens another; an
    equal one stays; one that is not delivered closes; a new one opens. Closed rows stay as they are.
    """
    opened = F.lit(OPEN_END).cast("timestamp_ntz")
    history = current.where(F.col("end_date") != opened)
    open_ = current.where(F.col("end_date") == opened)
    old = open_.select(F.col(key).alias("_key"), F.struct(*fields).alias("old"), F.col("start_date").alias("since"))
    new = delivered.select(F.col(key), F.struct(*fields).alias("new"))
    n = tasks_for(current.sparkSession, old.count() + new.count())
    both = old.repartition(n, "_key").join(new.repartition(n, key), F.col("_key") == F.col(key), "full")
    same = F.col("old").eqNullSafe(F.col("new"))
    row = lambda k, x, start, end: F.struct(F.col(k).alias(key), *[F.col(f"{x}.{f}").alias(f) for f in fields], start.alias("start_date"), end.alias("end_date"))
    kept = F.when(F.col("_key").isNotNull(), row("_key", "old", F.col("since"), F.when(same, opened).otherwise(when)))
    added = F.when(F.col(key).isNotNull() & ~(F.col("_key").isNotNull() & same), row(key, "new", when, opened))
    loaded = both.select(F.inline(F.filter(F.array(kept, added), lambda r: r.isNotNull())))
    return history.select(loaded.columns).unionByName(loaded)
