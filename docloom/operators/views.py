"""Document views: unwinding embedded records over their root, looking up names, and walking versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import checkpointed


def nest(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, order: str) -> DataFrame:
    """``parents`` with the array ``name`` of their children, in order; an empty array for none. A parent's children must fit one row."""
    fields = [c for c in children.columns if c != child_key]
    kept = F.sort_array(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in fields if c != order])))
    grouped = children.groupBy(F.col(child_key).alias(key)).agg(kept.alias(name))
    joined = parents.join(grouped, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def unwind_merge(docs: DataFrame, array: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each element of ``array``, whose fields stand over those of the root with the same name."""
    elements = F.col(array) if keep is None else F.filter(array, keep)
    rows = docs.withColumn("_element", F.explode(elements))
    fields = docs.schema[array].dataType.elementType.fieldNames()
    roots = [c for c in docs.columns if c != array and c not in fields]
    return rows.select(*roots, *[F.col(f"_element.{f}").alias(f) for f in fields])


def single_element_view(docs: DataFrame, array: str, match: Callable[[Column], Column]) -> DataFrame:
    """Each document merged with the first element that matches; documents without one are left out."""
    first = F.get(F.filter(array, match), F.lit(0))
    fields = docs.schema[array].dataType.elementType.fieldNames()
    rows = docs.withColumn("_element", first).where(F.col("_element").isNotNull())
    return rows.select(*[c for c in docs.columns if c != array and c not in fields], *[F.col(f"_element.{f}").alias(f) for f in fields])


def versions(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """``df`` with previous and next: the keys of the versions before and after in a group; and is_current, the last."""
    w = Window.partitionBy(*group).orderBy(*order)
    nxt = F.lead(key).over(w)
    return df.withColumn("previous", F.lag(key).over(w)).withColumn("next", nxt).withColumn("is_current", nxt.isNull())


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order, which should end with a unique key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, key: str, when: str, fields: list[str]) -> DataFrame:
    """The fields of each key's newest row, by an aggregate that needs no sort; ties go to the greatest fields."""
    best = F.max(F.struct(when, *fields))
    return df.groupBy(key).agg(best.alias("_best")).select(key, F.col(f"_best.{when}").alias(when), *[F.col(f"_best.{f}").alias(f) for f in fields])


def ancestors(chain: DataFrame, starts: DataFrame, key: str, previous: str) -> DataFrame:
    """Keys of ``starts`` and of everything before them, by following ``previous``, however long the chain.

    ``back`` leads twice as many steps back in each round, so rounds are about the logarithm of the chain's length; they end
    when a round finds nothing new, which holds for circles too.
    """
    back = checkpointed(chain.select(key, previous).where(F.col(key).isNotNull() & F.col(previous).isNotNull()).distinct())
    found = checkpointed(starts.select(key).distinct())
    while True:
        met = found.join(back, key).select(F.col(previous).alias(key))
        new = checkpointed(met.join(found, key, "left_anti").distinct())
        if new.isEmpty():
            return found
        found = checkpointed(found.unionByName(new))
        first = back.select(F.col(key).alias("_from"), F.col(previous).alias(key))
        back = checkpointed(first.join(back, key).select(F.col("_from").alias(key), previous).distinct())
