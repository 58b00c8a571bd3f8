"""Labelled dates of a text as rows: a table function for ``LATERAL``, whose columns follow its arguments."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DateType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docloom.functions.dates import LABELS, extract_dates


class LabelledDates:
    """``labelled_dates(text, as_of [, wide])``: a row (label, day) for each label that the text has, and for each date identified.

    With ``wide`` true there is one row a text, with a column for each label instead. ``as_of`` is a constant day; a null text has no
    rows, or in the wide form nulls.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, as_of: AnalyzeArgument, wide: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("labelled_dates reads texts")
        if not as_of.isConstantExpression or as_of.value is None:
            raise ValueError("the day that dates are resolved against is a constant")
        if wide is not None and not wide.isConstantExpression:
            raise ValueError("whether rows are wide is a constant")
        schema = StructType()
        if wide is not None and wide.value:
            for label in LABELS:
                schema = schema.add(label, DateType())
            return AnalyzeResult(schema)
        return AnalyzeResult(schema.add("label", StringType()).add("day", DateType()))

    def eval(self, text: str | None, as_of: str, wide: bool | None = False) -> Iterator[tuple]:
        found = extract_dates(text or "", date.fromisoformat(str(as_of)))
        if wide:
            yield tuple(found[label] for label in LABELS)
            return
        for label in LABELS:
            if found[label] is not None:
                yield label, found[label]
        for day in found["identified_dates"]:
            yield "identified", day


def register(spark: SparkSession, name: str = "labelled_dates") -> None:
    """Makes the table function known to SQL under ``name``."""
    spark.udtf.register(name, udtf(LabelledDates))
