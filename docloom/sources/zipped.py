"""Delimited files inside zip archives as a Spark data source: a task for each member, a schema from the header."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from glob import glob

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructType

#: Rows of a member that are handed on at once.
BATCH = 4096


@dataclass
class Member(InputPartition):
    """One file of one archive."""

    archive: str
    name: str


class ZippedTables(DataSource):
    """``spark.read.format("zipped_tables").load(path)``: the rows of all members, as texts, with ``archive`` and ``member`` behind them.

    ``path`` is an archive, or a pattern of several, in a folder that the driver and all executors see. Options: ``members`` (a pattern of
    names, all by default), ``sep`` (a comma), ``escape`` (none), ``encoding`` (utf-8). The columns are those of all members' headers, in
    order of their appearance, unless a schema is given; a member without a column has nulls there, and empty fields are nulls. A given
    schema names the columns that are read, and others are not kept. Members are told apart by name, and a condition on ``member`` leaves
    the others closed.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_tables"

    def _members(self) -> list[Member]:
        pattern = self.options.get("members", "*")
        found = []
        for path in sorted(glob(self.options["path"].removeprefix("file://"))):
            with zipfile.ZipFile(path) as archive:
                found += [Member(path, i.filename) for i in archive.infolist() if not i.is_dir() and fnmatch(i.filename, pattern)]
        if not found:
            raise FileNotFoundError(f"no member {pattern} in {self.options['path']}")
        return found

    def schema(self) -> StructType:
        names: dict[str, None] = {}
        for member in self._members():
            header, _ = _opened(member, self.options)
            names.update(dict.fromkeys(header))
        schema = StructType()
        for name in [*names, "archive", "member"]:
            schema = schema.add(name, StringType())
        return schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._members(), schema, self.options)


def _opened(member: Member, options: dict[str, str]) -> tuple[list[str], Iterator[list[str]]]:
    """The header of a member, and its rows as they are read."""
    stream = zipfile.ZipFile(member.archive).open(member.name)
    text = io.TextIOWrapper(stream, options.get("encoding", "utf-8"), newline="")
    rows = csv.reader(text, delimiter=options.get("sep", ","), escapechar=options.get("escape") or None)
    return next(rows, []), rows


class _Reader(DataSourceReader):
    def __init__(self, members: list[Member], schema: StructType, options: dict[str, str]):
        self.members, self.options = members, options
        self.names = schema.names

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("member",):
                self.members = [m for m in self.members if m.name == f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.members

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if member is None:
            return
        header, rows = _opened(member, self.options)
        places = [header.index(n) if n in header else None for n in self.names]
        fixed = {"archive": member.archive, "member": member.name}
        kept: list[list[str | None]] = []
        for row in rows:
            kept.append([fixed.get(n) if at is None else (row[at] or None) if at < len(row) else None for n, at in zip(self.names, places, strict=True)])
            if len(kept) == BATCH:
                yield _batch(kept, self.names)
                kept = []
        if kept:
            yield _batch(kept, self.names)


def _batch(rows: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


def register(spark: SparkSession) -> None:
    """Makes ``zipped_tables`` known to ``spark.read.format``."""
    spark.dataSource.register(ZippedTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
