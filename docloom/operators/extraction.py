"""Extracted tables: windows of pages, cleanup of rows, and translation of rows to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import glob_match


def page_window(pages: DataFrame, key: str, page: str, text: str, start: str, end: str) -> DataFrame:
    """The pages from the first that holds ``start`` up to, not including, the next that holds ``end``."""
    w = Window.partitionBy(key)
    first = F.min(F.when(F.contains(text, F.lit(start)), F.col(page))).over(w)
    marked = pages.withColumn("_first", first)
    last = F.min(F.when((F.col(page) > F.col("_first")) & F.contains(text, F.lit(end)), F.col(page))).over(w)
    return marked.withColumn("_last", last).where((F.col(page) >= F.col("_first")) & (F.col("_last").isNull() | (F.col(page) < F.col("_last")))).drop("_first", "_last")


def clean_rows(rows: DataFrame, cells: str, skip: int, row: str, required: list[int], banned: list[str]) -> DataFrame:
    """Rows behind the first ``skip``, with all required cells filled and no banned word in any cell."""
    kept = rows.where(F.col(row) >= skip)
    for place in required:
        kept = kept.where(F.coalesce(F.trim(F.get(cells, F.lit(place))), F.lit("")) != "")
    for word in banned:
        kept = kept.where(~F.exists(cells, lambda c: F.contains(F.lower(c), F.lit(word.lower()))))
    return kept


def merge_continued(rows: DataFrame, table: list[str], row: str, text: str, starts: Column) -> DataFrame:
    """Rows merged up: a row for which ``starts`` is false goes, behind a space, to the last row before it for which it is true."""
    w = Window.partitionBy(*table).orderBy(row)
    numbered = rows.withColumn("_group", F.sum(starts.cast("int")).over(w)).where("_group > 0")
    merged = numbered.groupBy(*table, "_group").agg(F.sort_array(F.collect_list(F.struct(row, text))).alias("_r"))
    return merged.select(*table, F.get("_r", F.lit(0))[row].alias(row), F.array_join(F.transform("_r", lambda x: x[text]), " ").alias(text))


def translated(rows: DataFrame, column: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` with field and value by the first rule (pattern, field, value) that fits; ``*`` in a value is what the pattern's ``*`` stood for."""
    out = F.lit(None).cast("struct<field:string,value:string>")
    for pattern, field, value in reversed(rules):
        found = glob_match(F.col(column), pattern)
        told = F.replace(F.lit(value), F.lit("*"), found) if "*" in value else F.lit(value)
        out = F.when(found.isNotNull(), F.struct(F.lit(field).alias("field"), told.alias("value"))).otherwise(out)
    return rows.withColumn("_t", out).withColumn("field", F.col("_t.field")).withColumn("value", F.col("_t.value")).drop("_t")


def with_header(rows: DataFrame, table: list[str], row: str, cells: str, skip: int = 0) -> DataFrame:
    """Rows behind each table's header, the first row after ``skip``, with it as the array ``header``. A table is one group of its rows."""
    kept = rows.where(F.col(row) >= skip)
    head = kept.groupBy(*table).agg(F.min_by(cells, row).alias("header"), F.min(row).alias("_first"))
    return kept.join(head, table).where(F.col(row) > F.col("_first")).drop("_first")


def column_of(header: Column, name: str) -> Column:
    """The place, from 0, of the first header cell that holds ``name``, without regard to case; -1 if none does."""
    return F.coalesce(F.array_position(F.transform(header, lambda h: F.coalesce(F.contains(F.lower(h), F.lit(name.lower())), F.lit(False))), F.lit(True)) - 1, F.lit(-1)).cast("int")


def cell_of(cells: str, name: str) -> Column:
    """The trimmed cell of the column that ``name`` finds in ``header``; null if there is none, or it is empty."""
    place = column_of(F.col("header"), name)
    return F.when(place >= 0, F.nullif(F.trim(F.get(cells, place)), F.lit("")))


def wanted_tables(rows: DataFrame, required: str | None = None, excluded: str | None = None) -> DataFrame:
    """Rows of tables whose header holds the required text and not the excluded one."""
    if required:
        rows = rows.where(column_of(F.col("header"), required) >= 0)
    return rows.where(column_of(F.col("header"), excluded) < 0) if excluded else rows


def between_texts(rows: DataFrame, table: list[str], row: str, cells: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Each table's rows from the first with a cell ``start`` up to, not including, the next that holds ``end`` in any cell."""
    w = Window.partitionBy(*table)
    if start:
        begins = F.array_contains(cells, start)
        rows = rows.withColumn("_from", F.min(F.when(begins, F.col(row))).over(w)).where(F.col(row) >= F.col("_from")).drop("_from")
    if end:
        ends = F.contains(F.lower(F.array_join(cells, "")), F.lit(end.lower()))
        rows = rows.withColumn("_to", F.min(F.when(ends, F.col(row))).over(w)).where(F.col("_to").isNull() | (F.col(row) < F.col("_to"))).drop("_to")
    return rows


def merged_rows(rows: DataFrame, table: list[str], row: str, cells: str, column: str, down: bool = False) -> DataFrame:
    """Rows in which ``column`` is empty merged cell by cell into the row before (or ``down``, into the next that has it).

    A row without one to go into is let go. The merged row keeps its own place; cells of nulls are empty.
    """
    whole = cell_of(cells, column).isNotNull()
    order = F.col(row).desc() if down else F.col(row).asc()
    numbered = rows.withColumn("_whole", whole).withColumn("_group", F.sum(F.col("_whole").cast("int")).over(Window.partitionBy(*table).orderBy(order))).where("_group > 0")
    grouped = numbered.groupBy(*table, "_group").agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), F.col(cells).alias("c")))).alias("_rows"), F.max(F.when(F.col("_whole"), F.col(row))).alias(row), F.first("header").alias("header"))
    width = F.aggregate("_rows", F.lit(0), lambda n, x: F.greatest(n, F.size(x["c"])))
    joined = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.trim(F.array_join(F.filter(F.transform("_rows", lambda x: F.get(x["c"], i)), lambda c: F.coalesce(c, F.lit("")) != ""), " ")))
    return grouped.select(*table, row, "header", F.when(width > 0, joined).otherwise(F.array().cast("array<string>")).alias(cells))


def fanned_out(rows: DataFrame, brands: str, generics: str, kind: Column) -> DataFrame:
    """A row for each code (struct in the arrays): generics unless ``kind`` says brand, brands unless it says generic; one without a code if there is none at all."""
    told = F.coalesce(F.lower(kind), F.lit("both"))
    empty = F.array().cast(rows.schema[brands].dataType)
    b, g = (F.coalesce(c, empty) for c in (brands, generics))
    codes = F.concat(F.when(told.isin("generic", "both"), g).otherwise(empty), F.when(told.isin("brand", "both"), b).otherwise(empty))
    none = (F.size(b) == 0) & (F.size(g) == 0)
    out = rows.withColumn("code", F.explode_outer(codes)).where(F.col("code").isNotNull() | none)
    return out.drop(brands, generics)


def rendered(values: DataFrame, doc: str, order: list[str], title: str, kind: str, value: str) -> DataFrame:
    """doc, html: a document's parts (title, kind, value) in order; kinds are ``text``, ``date`` (as month/day/year) and ``list`` (parts between ``|``).

    Parts without a value are left out; titles are headings. A document's parts are one group.
    """
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = F.concat(F.lit("<ul>"), F.array_join(F.transform(F.split(safe(F.col(value)), r"\|"), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))
    day = F.date_format(F.try_to_timestamp(F.col(value)), "MM/dd/yyyy")
    body = F.when(F.col(kind) == "list", items).when(F.col(kind) == "date", F.concat(F.lit("<p>"), day, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), safe(F.col(value)), F.lit("</p>")))
    part = F.concat(F.lit("<h2>"), safe(F.col(title)), F.lit("</h2>"), body)
    rows = values.where(F.coalesce(F.trim(value), F.lit("")) != "").select(doc, F.struct(*order, part.alias("_part")).alias("_p")).where("_p._part IS NOT NULL")
    return rows.groupBy(doc).agg(F.sort_array(F.collect_list("_p")).alias("_p")).select(F.col(doc), F.concat(F.lit("<html><body>"), F.array_join(F.transform("_p", lambda p: p["_part"]), ""), F.lit("</body></html>")).alias("html"))
