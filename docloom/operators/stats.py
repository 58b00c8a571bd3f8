"""Counts and statistics over collections, queues, change logs and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores that an area under a curve is summed in.
RANGES = 64


def daily_stats(runs: DataFrame, since: Column, site: str, started: str, found: str, new: str) -> DataFrame:
    """By day of each site's newest run since a time: new, updated (found - new) and all documents found."""
    newest = runs.where(F.col(started) >= since).groupBy(site).agg(F.max(F.struct(started, found, new)).alias("r"))
    day = F.date_format(F.col(f"r.{started}"), "yyyy-MM-dd").alias("day")
    return newest.groupBy(day).agg(F.sum(f"r.{new}").alias("created"), F.sum(F.col(f"r.{found}") - F.col(f"r.{new}")).alias("updated"), F.sum(f"r.{found}").alias("total"))


def fill_days(stats: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    """A row for every day from ``first`` to ``last``, with zeros where there is none."""
    days = stats.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("_d"))
    days = days.select(F.date_format("_d", "yyyy-MM-dd").alias(day))
    return days.join(stats, day, "left").select(day, *[F.coalesce(c, F.lit(0)).alias(c) for c in stats.columns if c != day])


def duplicates(df: DataFrame, key: Column, name: str = "checksum") -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def ids_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's distinct values, sorted, as an array."""
    return df.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("ids"))


def counts_in_one_pass(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """queue, n: how many rows each predicate holds for, in one pass over the rows."""
    counts = df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("queue"), F.col(n).alias("n")) for n in predicates])).alias("q")).select("q.queue", "q.n")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, path, op, value, prev for every field that differs between two versions of a table, as text."""
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    both = a.join(b, key)
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    op = lambda f: F.when(text("a", f).isNull(), "add").when(text("b", f).isNull(), "remove").otherwise("replace")
    deltas = F.array(*[F.when(~text("a", f).eqNullSafe(text("b", f)), F.struct(F.lit(f"/{f}").alias("path"), op(f).alias("op"), text("b", f).alias("value"), text("a", f).alias("prev"))) for f in fields])
    return both.select(key, F.inline(F.filter(deltas, lambda d: d.isNotNull())))


def part_stats(df: DataFrame, key: str, parts: Column) -> DataFrame:
    """Of the lengths of each row's parts: number, mean, median and most common (the least, if several are)."""
    lengths = df.select(key, F.explode(F.transform(parts, lambda p: F.length(p))).alias("size"))
    sizes = lengths.groupBy(key, "size").agg(F.count("*").alias("n"))
    most = sizes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "size")).alias("m"))
    rest = lengths.groupBy(key).agg(F.count("*").alias("parts"), F.avg("size").alias("mean"), F.median("size").alias("median"))
    return rest.join(most.select(key, F.col("m.size").alias("mode")), key)


def prefix_groups(df: DataFrame, value: Column, length: int) -> DataFrame:
    """prefix, n, first: values of at least ``length`` letters by their first ones, without regard to case."""
    rows = df.select(F.lower(value).alias("v")).where(F.length("v") >= length)
    return rows.groupBy(F.substring("v", 1, length).alias("prefix")).agg(F.count("*").alias("n"), F.min("v").alias("first"))


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """positives, negatives and the area under the curve, from the ranks of the distinct scores' counts.

    Scores are cut into ranges at ``RANGES`` quantiles. Negatives below a score are those of the ranges before its own, of
    which there are so many rows, and those of its range, over which a window goes. Null scores and labels take no part; without
    positives or negatives the area is null.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    cuts = rows.agg(F.percentile_approx(F.col(score).cast("double"), [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    counts = counts.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col(score).cast("double"))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_range").agg(F.sum("q").alias("_q")).select("_range", F.coalesce(F.sum("_q").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("q").over(inside), F.lit(0.0))).join(F.broadcast(ranges), "_range")
    wins = counts.select("p", "q", (F.col("p") * (F.col("_before") + F.col("_inside") + F.col("q") / 2)).alias("w"))
    return wins.agg(F.sum("p").cast("long").alias("positives"), F.sum("q").cast("long").alias("negatives"), F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("auc"))


def best_f1(scored: DataFrame, label: str, score: str, cuts: int = 100) -> DataFrame:
    """cut, f1: the best of ``cuts`` thresholds i / cuts; a row counts for every threshold at or below its score, in one pass."""
    step = F.least(F.greatest(F.floor(F.col(score) * cuts), F.lit(0)), F.lit(cuts)).cast("int")
    by_step = scored.groupBy(step.alias("step")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    cut = by_step.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("step"))))
    told = cut.groupBy("cut").agg(F.sum("p").alias("hits"), F.sum("n").alias("told"))
    all_ = scored.agg(F.sum(label).alias("positives"))
    f1 = told.join(F.broadcast(all_)).select("cut", (2 * F.col("hits") / (F.col("told") + F.col("positives"))).alias("f1"))
    return f1.agg(F.max(F.struct("f1", (-F.col("cut")).alias("c"))).alias("b")).select((-F.col("b.c") / cuts).alias("cut"), F.col("b.f1").alias("f1"))
