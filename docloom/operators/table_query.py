"""The table-query language: filters over dotted paths, sorts and pages, compiled to columns.

A path that crosses an array means "any element"; a negated operator over it means "no element". Negations keep rows whose
field is null; ordered comparisons let them go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operators that stay active without a value (fixed values).
ACTIVE_WITHOUT_VALUE = frozenset({"empty", "notEmpty", "leq", "notinlist", "neq"})
#: Rows of a page if nothing else is asked for.
PAGE = 50


@dataclass(frozen=True)
class Filter:
    """One condition of a table query: a dotted path, an operator, the value's type and the value."""

    name: str
    operator: str
    type: str = "string"
    value: Any = None


def path_predicate(schema: T.StructType, path: str, test: Callable[[Column], Column]) -> Column:
    """``test`` on the field at ``path``; true for an array if it is true for any element. False where it is null."""

    def at(column: Column, kind: T.DataType, parts: list[str]) -> Column:
        if isinstance(kind, T.ArrayType) and parts:
            return F.exists(column, lambda x: F.coalesce(at(x, kind.elementType, parts), F.lit(False)))
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.exists(column, lambda x: F.coalesce(test(x), F.lit(False)))
        if parts:
            return at(column[parts[0]], kind[parts[0]].dataType, parts[1:])
        return test(column)

    first, *rest = path.split(".")
    return F.coalesce(at(F.col(f"`{first}`"), schema[first].dataType, rest), F.lit(False))


def leaf_type(schema: T.StructType, path: str) -> T.DataType:
    """The type of the values at ``path``, inside any arrays."""
    kind: T.DataType = schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[part].dataType
    return kind


def coerced(value: Any, kind: str) -> Column:
    """A literal of the filter's type: number, date, boolean or string."""
    if isinstance(value, (list, tuple)):
        return F.array(*[coerced(v, kind) for v in value])
    if kind == "number":
        return F.lit(float(value))
    if kind == "date":
        return F.lit(str(value)).cast("timestamp_ntz")
    if kind in ("boolean", "bool"):
        return F.lit(str(value).lower() == "true")
    return F.lit(value)


def is_active(f: Filter) -> bool:
    """Whether a filter counts: one without a value does so only for some operators."""
    return f.operator in ACTIVE_WITHOUT_VALUE or not (f.value is None or f.value == "" or f.value == [] or f.value is False)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _text_match(value: str) -> Callable[[Column], Column]:
    """Any word of the value, or all of its quoted phrases."""
    phrases, rest = value.split('"')[1::2], " ".join(value.split('"')[0::2])
    if phrases:
        return lambda c: reduce(lambda a, b: a & b, [F.contains(F.lower(c), F.lit(p.lower())) for p in phrases])
    return lambda c: F.arrays_overlap(_words(c), _words(F.lit(rest)))


def _whole_array(schema: T.StructType, f: Filter) -> Column | None:
    """Equality with a whole array, where the field is one and so is the value."""
    kind = schema[f.name].dataType if "." not in f.name else None
    if isinstance(kind, T.ArrayType) and isinstance(f.value, (list, tuple)):
        return F.col(f"`{f.name}`") == F.array(*[coerced(v, f.type) for v in f.value]).cast(kind)
    return None


def compile_filter(schema: T.StructType, f: Filter) -> Column | None:
    """The filter's condition, or None if it is not active."""
    if not is_active(f):
        return None
    value, any_, op = f.value, lambda test: path_predicate(schema, f.name, test), f.operator
    low = str(value).lower() if value is not None else ""
    is_list = isinstance(value, (list, tuple))
    within = (lambda c: c.isin(*[coerced(v, f.type) for v in value])) if is_list else (lambda c: c == coerced(value, f.type))
    text = {
        "contains": lambda c: F.contains(F.lower(c), F.lit(low)),
        "startsWith": lambda c: F.startswith(F.lower(c), F.lit(low)),
        "endsWith": lambda c: F.endswith(F.lower(c), F.lit(low)),
    }
    if op in text:
        return any_(text[op])
    if op == "notContains":
        return ~any_(text["contains"])
    if op == "textcontains":
        return any_(_text_match(str(value)))
    if op == "textnotContains":
        return ~any_(lambda c: F.contains(F.lower(c), F.lit(low.strip('"'))))
    if op == "eq":
        return any_(within) if not is_list or value else F.lit(False)
    if op in ("leq", "nleq"):
        whole = _whole_array(schema, f)
        same = F.coalesce(whole, F.lit(False)) if whole is not None else any_(lambda c: c == coerced("" if value is None else value, f.type))
        return same if op == "leq" else ~same
    if op == "neq":
        if value is None or value == "" or value == []:
            return any_(lambda c: c.isNotNull())
        return ~any_(within)
    if op == "notinlist":
        return ~any_(within) if value else F.lit(True)
    if op in ("empty", "notEmpty"):
        string = isinstance(leaf_type(schema, f.name), T.StringType)
        filled = any_(lambda c: (c.isNotNull() & (c != "")) if string else c.isNotNull())
        return filled if op == "notEmpty" else ~filled
    compare: dict[str, Callable[[Column, Column], Column]] = {
        "gt": lambda c, v: c > v, "after": lambda c, v: c > v, "gte": lambda c, v: c >= v, "afterOrOn": lambda c, v: c >= v,
        "lt": lambda c, v: c < v, "before": lambda c, v: c < v, "lte": lambda c, v: c <= v, "beforeOrOn": lambda c, v: c <= v,
    }
    if op in compare:
        return any_(lambda c: compare[op](c, coerced(value, f.type)))
    if op in ("inrange", "notinrange"):
        start, end = coerced(value["start"], f.type), coerced(value["end"], f.type)
        return any_(lambda c: c.between(start, end) if op == "inrange" else (c > end) | (c < start))
    raise ValueError(f"unknown operator {op}")


def where_all(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """The rows that all active filters hold for."""
    for condition in (compile_filter(df.schema, f) for f in filters):
        df = df if condition is None else df.where(condition)
    return df


def sort_keys(df: DataFrame, sorts: Iterable[tuple[str, int]], tiebreak: str | None = None) -> list[Column]:
    """Sort columns; direction 0 is dropped. An array sorts by its least (ascending) or greatest element."""
    keys = []
    for name, direction in sorts:
        if not direction:
            continue
        column = F.col(name)
        if isinstance(df.select(column).schema[0].dataType, T.ArrayType):
            column = F.array_min(column) if direction > 0 else F.array_max(column)
        keys.append(column.asc() if direction > 0 else column.desc())
    return [*keys, F.col(tiebreak).asc()] if tiebreak else keys


def sort_spec(spec: Iterable[str]) -> list[tuple[str, int]]:
    """Sorts from strings like ``-priority``."""
    return [(s.lstrip("+-"), -1 if s.startswith("-") else 1) for s in spec]


def page(df: DataFrame, sorts: Iterable[tuple[str, int]], tiebreak: str, skip: int = 0, limit: int | None = PAGE) -> DataFrame:
    """One page of the sorted rows; without a limit, all that follow ``skip``."""
    df = df.orderBy(*sort_keys(df, sorts, tiebreak))
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def total(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """The number of rows that the filters leave."""
    return where_all(df, filters).agg(F.count("*").alias("total"))
