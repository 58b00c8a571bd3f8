"""Updates as functions from one table to the next: fields, elements of arrays, moves, backfills, merge rules, counts.

A condition that is null counts as false. Rows that it does not hold for pass unchanged. Nothing is written; the caller
does that, so a lost task leaves no half update.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Change = Callable[[Column], Column]


def set_to(value: Column) -> Change:
    return lambda old: value


def unset() -> Change:
    return lambda old: F.lit(None)


def increased(by: Column) -> Change:
    """A null counts as 0."""
    return lambda old: F.coalesce(old, F.lit(0)) + by


def greatest(value: Column) -> Change:
    """The greater of old and new; a null gives way."""
    return lambda old: F.greatest(old, value)


def least(value: Column) -> Change:
    return lambda old: F.least(old, value)


def pushed(value: Column) -> Change:
    """The array with one more element at its end; a null array is empty."""
    return lambda old: F.concat(F.coalesce(old, F.array()), F.array(value))


def added(value: Column) -> Change:
    """The array with the element, unless it holds it already. A null array is empty; null is an element like others."""
    return lambda old: F.when(F.exists(F.coalesce(old, F.array()), lambda x: x.eqNullSafe(value)), old).otherwise(F.concat(F.coalesce(old, F.array()), F.array(value)))


def pulled(match: Callable[[Column], Column]) -> Change:
    """The array without the elements that ``match`` holds for."""
    return lambda old: F.filter(old, lambda x: ~F.coalesce(match(x), F.lit(False)))


def update(df: DataFrame, where: Column, changes: Mapping[str, Change]) -> DataFrame:
    """``df`` with each field of ``changes`` changed in the rows that ``where`` holds for; all changes see the old values."""
    holds = F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({name: F.when(holds, change(F.col(f"`{name}`")).cast(kinds[name])).otherwise(F.col(f"`{name}`")) for name, change in changes.items()})


def update_elements(df: DataFrame, array: str, match: Callable[[Column], Column], changes: Mapping[str, Change], first_only: bool = False) -> DataFrame:
    """``df`` with fields of the matching structs of an array changed: of all of them, or of the first. A null array stays null."""
    kind = df.schema[array].dataType.elementType
    holds = lambda x: F.coalesce(match(x), F.lit(False))

    def changed(x: Column) -> Column:
        return F.struct(*[(changes[f.name](x[f.name]).cast(f.dataType) if f.name in changes else x[f.name]).alias(f.name) for f in kind])

    place = F.array_position(F.transform(array, holds), True) - 1
    if first_only:
        out = F.transform(array, lambda x, i: F.when(i == place, changed(x)).otherwise(x))
    else:
        out = F.transform(array, lambda x: F.when(holds(x), changed(x)).otherwise(x))
    return df.withColumn(array, out)


def moved_into(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    """The fields as one struct at the end; they leave the root."""
    return df.withColumn(name, F.struct(*fields)).drop(*[f for f in fields if f != name])


def moved_out(df: DataFrame, name: str, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """The fields of a struct at the root, under new names if there are any; the struct goes. A null struct gives nulls."""
    fields = df.schema[name].dataType.fieldNames()
    return df.withColumns({(renamed or {}).get(f, f): F.col(f"{name}.{f}") for f in fields}).drop(name)


def backfilled(df: DataFrame, field: str, *sources: Column) -> DataFrame:
    """A null field takes the first of ``sources`` that is not null."""
    return df.withColumn(field, F.coalesce(field, *sources))


def merged_tags(old: Column, new: Column, keep: Column) -> Column:
    """Where ``keep`` holds (approved or edited by hand), the old tags and those of the new that they lack; else the new."""
    empty = F.coalesce(old, F.array())
    return F.when(F.coalesce(keep, F.lit(False)), F.concat(empty, F.array_except(F.coalesce(new, F.array()), empty))).otherwise(new)


def without_references(children: DataFrame, field: str, gone: DataFrame, key: str) -> DataFrame:
    """``children`` with null where ``field`` refers to a key of ``gone`` (distinct or not); other references stay."""
    keys = gone.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct()
    found = children.join(keys, F.col(field) == F.col("_gone"), "left")
    return found.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == field else F.col(c) for c in children.columns])


def bulk_update(df: DataFrame, changes: DataFrame, key: str, field: str, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` after the changes (key, field), and each change's result: ``ok``, ``refused`` (the row does not allow it) or ``missing``.

    A key has one change at most. A change to null is one too.
    """
    marked = changes.select(F.col(key).alias("_key"), F.col(field).alias("_new"), F.lit(True).alias("_due"))
    may = F.coalesce(allowed, F.lit(False))
    out = df.join(marked, F.col(key) == F.col("_key"), "left").withColumn("_may", may)
    done = out.withColumn(field, F.when(F.col("_due") & F.col("_may"), F.col("_new")).otherwise(F.col(field))).select(*df.columns)
    target = df.withColumn("_may", may).select(F.col(key).alias("_target"), "_may")
    told = marked.join(target, F.col("_key") == F.col("_target"), "left")
    result = F.when(F.col("_target").isNull(), "missing").when(F.col("_may"), "ok").otherwise("refused")
    return done, told.select(F.col("_key").alias(key), result.alias("result"))


def relabelled(df: DataFrame, new: Column, approved: Column, overwrite: bool = False) -> Column:
    """The new lineage, but the old one where that is approved and not to be overwritten; null has nothing to keep."""
    keep = F.lit(not overwrite) & F.coalesce(approved, F.lit(False)) & F.col("lineage").isNotNull()
    return F.when(keep, F.col("lineage")).otherwise(new)


def reset_lineages(df: DataFrame, where: Column, key: str) -> DataFrame:
    """Each row that ``where`` holds for is a lineage of its own again: no previous version, and current."""
    return update(df, where, {"lineage": set_to(F.col(key)), "previous": unset(), "is_current": set_to(F.lit(True))})


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """``parents`` with the number of children that refer to them, counted anew; 0 for none."""
    counts = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_parent")).agg(F.count("*").alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_parent"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_parent", "_n")


def counts_after(parents: DataFrame, key: str, name: str, changes: DataFrame, old: str, new: str) -> DataFrame:
    """``parents`` with ``name`` kept up to date: one less for each change's old parent, one more for its new one."""
    steps = changes.where(~F.col(old).eqNullSafe(F.col(new))).select(F.explode(F.array(F.struct(F.col(old).alias("p"), F.lit(-1).alias("d")), F.struct(F.col(new).alias("p"), F.lit(1).alias("d")))).alias("s"))
    steps = steps.where("s.p IS NOT NULL").groupBy(F.col("s.p").alias("_parent")).agg(F.sum("s.d").alias("_d"))
    return parents.join(steps, F.col(key) == F.col("_parent"), "left").withColumn(name, F.col(name) + F.coalesce("_d", F.lit(0))).drop("_parent", "_d")
