"""Templates of documents, compiled from a nested description to one plan: lookups are joins, tables and groups nested aggregations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import tasks_for

MISSING = "N/A"


@dataclass(frozen=True)
class Value:
    """What stands in a cell: a column, in the form of a ``text``, a ``date`` (month/day/year) or a ``list`` (parts between ``|``), behind a ``prefix``."""

    column: str
    kind: str = "text"
    prefix: str = ""


@dataclass(frozen=True)
class Lookup:
    """Columns of another source, by equality of a column here and one there."""

    source: str
    here: str
    there: str


@dataclass(frozen=True)
class Part:
    """A part of a document, from one source: its rows in the order of ``order``.

    ``values`` is each row's value in paragraphs, ``list`` one list of the rows' values, ``table`` a table with a column for each value (their
    names are the headings), ``group`` such a table, under a heading, for each value of ``by``. ``single`` keeps the first row alone.
    """

    title: str
    source: str
    kind: str
    values: tuple[tuple[str, Value], ...]
    order: tuple[str, ...]
    lookups: tuple[Lookup, ...] = ()
    by: str = ""
    single: bool = False


@dataclass(frozen=True)
class Template:
    """The parts of a document in order."""

    parts: tuple[Part, ...] = field(default_factory=tuple)


def _safe(c: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), c)


def _shown(value: Value) -> Column:
    text = F.nullif(F.col(value.column).cast("string"), F.lit(""))
    if value.kind == "date":
        text = F.date_format(F.col(value.column).try_cast("timestamp"), "MM/dd/yyyy")
    shown = _safe(text)
    if value.kind == "list":
        items = F.array_join(F.transform(F.filter(F.split(shown, r"\|"), lambda x: x != ""), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
        shown = F.when(F.contains(shown, F.lit("|")), F.concat(F.lit("<ul>"), items, F.lit("</ul>"))).otherwise(shown)
    return F.concat(F.lit(value.prefix), F.coalesce(shown, F.lit(MISSING)))


def _within(tag: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))


def _joined(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The texts ``_row`` of each key, in order, as one."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "_row")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["_row"]), "").alias(name))


def _part(part: Part, sources: dict[str, DataFrame], key: str, tasks: int) -> DataFrame:
    """key and the inner text ``_html`` of the documents that have rows of this part."""
    rows = sources[part.source].where(F.col(key).isNotNull())
    for n, lookup in enumerate(part.lookups):
        other = sources[lookup.source]
        named = other.select(F.col(lookup.there).alias(f"_on{n}"), *[F.col(c) for c in other.columns if c not in (lookup.there, key, *rows.columns)])
        rows = rows.join(named, F.col(lookup.here) == F.col(f"_on{n}"), "left").drop(f"_on{n}")
    order = [f"_o{i}" for i in range(len(part.order))]
    rows = rows.withColumns(dict(zip(order, map(F.col, part.order), strict=True)))
    # every aggregate of the part is by the key, so its rows are dealt once
    rows = rows.repartition(tasks, key)
    if part.single:
        least = F.struct(*order, *[c for c in rows.columns if c != key and c not in order])
        rows = rows.groupBy(key).agg(F.min(least).alias("_r")).select(key, "_r.*")
    cells = [_shown(v) for _, v in part.values]
    if part.kind == "values":
        return _joined(rows.select(key, *order, F.concat(*[_within("p", c) for c in cells]).alias("_row")), [key], order, "_html")
    if part.kind == "list":
        found = _joined(rows.select(key, *order, _within("li", F.concat_ws(" - ", *cells)).alias("_row")), [key], order, "_html")
        return found.select(key, _within("ul", F.col("_html")).alias("_html"))
    head = F.lit("<thead><tr>" + "".join(f"<th>{name}</th>" for name, _ in part.values) + "</tr></thead>")
    by = [F.coalesce(F.col(part.by).cast("string"), F.lit(MISSING)).alias("_by")] if part.kind == "group" else []
    rows = rows.select(key, *by, *order, _within("tr", *[_within("td", c) for c in cells]).alias("_row"))
    found = _joined(rows, [key, "_by"] if by else [key], order, "_body")
    table = _within("table", head, _within("tbody", F.col("_body")))
    if not by:
        return found.select(key, table.alias("_html"))
    return _joined(found.select(key, "_by", F.concat(_within("h3", _safe(F.col("_by"))), table).alias("_row")), [key], ["_by"], "_html")


def rendered(docs: DataFrame, key: str, template: Template, sources: dict[str, DataFrame]) -> DataFrame:
    """key, html: every document of ``docs`` by ``template``; sources have the rows of all documents, with ``key``.

    Tasks are as many as the rows of the sources ask for. Each part is aggregated once over its whole source, and the parts of a document meet in one aggregate; there is no step for each
    document or row. A part without rows says ``N/A``, as a null or empty value does. Rows of
    equal order go by their text. Lookups do not multiply rows if their column is
    unique there. Repeated keys of ``docs`` are one document; null keys are none.
    """
    tasks = tasks_for(docs.sparkSession, sum(sources[name].count() for name in {p.source for p in template.parts}))
    parts = [_part(p, sources, key, tasks).select(key, F.lit(n).alias("_n"), "_html") for n, p in enumerate(template.parts)]
    all_ = docs.where(F.col(key).isNotNull()).select(key, F.lit(-1).alias("_n"), F.lit("").alias("_html")).distinct()
    for part in parts:
        all_ = all_.unionByName(part)
    own = [F.max(F.when(F.col("_n") == n, F.col("_html"))).alias(f"_{n}") for n in range(len(parts))]
    met = all_.repartition(tasks, key).groupBy(key).agg(F.max(F.col("_n") == -1).alias("_there"), *own).where("_there")
    body = [F.concat(F.lit(f"<h2>{p.title}</h2>"), F.coalesce(f"_{n}", F.lit(f"<p>{MISSING}</p>"))) for n, p in enumerate(template.parts)]
    return met.select(key, F.concat(F.lit("<html><body>"), *body, F.lit("</body></html>")).alias("html"))
