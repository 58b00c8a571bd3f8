"""Predicates given as dictionaries over dotted paths, as saved queues and bulk selections hold them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.table_query import path_predicate


def _equals(value: Any) -> Callable[[Column], Column]:
    return (lambda c: c.isNull()) if value is None else (lambda c: c.eqNullSafe(F.lit(value)))


def _one_of(values: list) -> Callable[[Column], Column]:
    return lambda c: reduce(lambda a, b: a | b, [_equals(v)(c) for v in values], F.lit(False))


def _element(kind: T.DataType, condition: Mapping[str, Any], x: Column) -> Column:
    """A dictionary's conditions on one array element."""
    fields = {f.name: f.dataType for f in kind.fields}
    tests = []
    for name, test in condition.items():
        own = x[name]
        if isinstance(test, Mapping):
            tests += [_scalar(op, value)(own) for op, value in test.items()]
        elif isinstance(fields[name], T.ArrayType):
            tests.append(F.array_contains(own, test))
        else:
            tests.append(_equals(test)(own))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _scalar(op: str, value: Any) -> Callable[[Column], Column]:
    found = {
        "$eq": _equals(value),
        "$ne": lambda c: ~_equals(value)(c),
        "$gt": lambda c: c > F.lit(value),
        "$gte": lambda c: c >= F.lit(value),
        "$lt": lambda c: c < F.lit(value),
        "$lte": lambda c: c <= F.lit(value),
        "$in": lambda c: _one_of(value)(c),
        "$nin": lambda c: ~_one_of(value)(c),
        "$regex": lambda c: c.rlike(value),
    }
    if op not in found:
        raise ValueError(f"unknown operator {op}")
    return found[op]


def compile_predicate(schema: T.StructType, query: Mapping[str, Any]) -> Column:
    """The condition that a dictionary stands for; an empty one holds for every row."""
    parts = []
    for name, test in query.items():
        if name in ("$and", "$or"):
            inner = [compile_predicate(schema, q) for q in test]
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), inner))
            continue
        for op, value in test.items() if isinstance(test, Mapping) else (("$eq", test),):
            parts.append(_condition(schema, name, op, value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _condition(schema: T.StructType, name: str, op: str, value: Any) -> Column:
    top = schema[name].dataType if "." not in name else None
    if op == "$elemMatch":
        return F.coalesce(F.exists(F.col(name), lambda x: _element(top.elementType, value, x)), F.lit(False))
    if op == "$not":
        return ~reduce(lambda a, b: a & b, [_condition(schema, name, o, v) for o, v in value.items()])
    if op == "$exists":
        return F.col(name).isNotNull() if value else F.col(name).isNull()
    if op == "$size":
        return F.coalesce(F.size(name) == value, F.lit(False))
    if op == "$ne":
        return ~_condition(schema, name, "$eq", value)
    if op == "$nin":
        return ~_condition(schema, name, "$in", value)
    if op in ("$eq", "$in") and (None in value if op == "$in" else value is None):
        # a missing field counts as null, and so does an array without elements
        missing = ~path_predicate(schema, name, lambda c: c.isNotNull())
        rest = [v for v in value if v is not None] if op == "$in" else []
        return missing | path_predicate(schema, name, _one_of(rest)) if rest else missing
    return path_predicate(schema, name, _scalar(op, value))
