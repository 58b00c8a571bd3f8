"""Office archives and uploads: texts and properties of word files, rows of sheets, uploads with list cells, deliveries by header."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: A delivery's last line, when no filter was set (fixed value).
SENTINEL = "No filters applied"
#: The columns of an upload of sites, in order (fixed values).
UPLOAD = ("name", "base_urls", "tags", "doc_exts", "url_keywords", "collection_method")


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def word_text(content: bytes) -> tuple[str, dict[str, str]]:
    """The paragraphs of a word file, one a line, and its core properties. What is no such archive gives none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return "", {}
    body, core = _xml(archive, "word/document.xml"), _xml(archive, "docProps/core.xml")
    lines = ["".join((x.text or "") if x.tag == f"{_WORD}t" else "\t" if x.tag == f"{_WORD}tab" else "" for x in p.iter()) for p in body.iter(f"{_WORD}p")] if body is not None else []
    return "\n".join(lines), {x.tag.rsplit("}", 1)[-1]: x.text for x in core if x.text} if core is not None else {}


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells) of all sheets in order; numbers as they are written, empty cells as null."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return []
    shared, book, links = _xml(archive, "xl/sharedStrings.xml"), _xml(archive, "xl/workbook.xml"), _xml(archive, "xl/_rels/workbook.xml.rels")
    texts = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in shared] if shared is not None else []
    paths = {x.get("Id"): x.get("Target") for x in links} if links is not None else {}
    out: list = []
    for sheet in book.iter(f"{_SHEET}sheet") if book is not None else ():
        page = _xml(archive, "xl/" + (paths.get(sheet.get(_LINK)) or "").removeprefix("/xl/"))
        for n, row in enumerate(page.iter(f"{_SHEET}row") if page is not None else ()):
            cells: dict[int, str | None] = {}
            for i, cell in enumerate(row):
                letters = re.match(r"[A-Z]*", cell.get("r") or "")[0]
                place = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else i
                value = cell.find(f"{_SHEET}v")
                inner = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                text = texts[int(value.text)] if cell.get("t") == "s" and value is not None else inner or (value.text if value is not None else None)
                cells[place] = text or None
            out.append((sheet.get("name"), n, [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
    return out


def read_word_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, properties of word files."""

    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_text(c) for c in content], columns=["text", "properties"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.pandas_udf(run, "struct<text:string,properties:map<string,string>>")("content").alias("w")).select("path", "w.text", "w.properties")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells (strings) of sheet files."""

    def run(content: pd.Series) -> pd.Series:
        return pd.Series([[{"sheet": s, "row": n, "cells": c} for s, n, c in sheet_rows(x)] for x in content], dtype=object)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(F.pandas_udf(run, "array<struct<sheet:string,row:int,cells:array<string>>>")("content")).alias("r")).select("path", "r.*")


def sheet_text(rows: DataFrame) -> DataFrame:
    """path, text: all rows of all sheets, cells joined by spaces, a blank line between sheets."""
    line = F.array_join(F.filter("cells", lambda c: c.isNotNull()), " ")
    sheets = rows.groupBy("path", "sheet").agg(F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("l"))
    sheets = sheets.select("path", "sheet", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"))
    return sheets.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def by_header(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of a delivery by the names in its first row: ``columns`` maps header cells to names; missing columns are null.

    Rows without a value in the first of ``columns``, or with the sentinel there, are skipped.
    """
    header = rows.where("row = 0").select("path", "sheet", F.col("cells").alias("_header"))
    both = rows.where("row > 0").join(header, ["path", "sheet"])
    cell = lambda h: F.get("cells", F.array_position("_header", h).cast("int") - 1)
    own = [F.when(F.array_contains("_header", h), cell(h)).alias(name) for h, name in columns.items()]
    out = both.select("path", "sheet", "row", *own)
    key = F.col(next(iter(columns.values())))
    return out.where(F.coalesce(F.trim(key), F.lit("")).isin("", SENTINEL) == F.lit(False))


def list_cell(text: Column, sep: str, default: list[str] | None = None) -> Column:
    """A cell that holds a list; an empty one is the default, or no element."""
    filled = F.coalesce(F.trim(text), F.lit("")) != ""
    return F.when(filled, F.transform(F.split(text, re.escape(sep)), lambda x: F.trim(x))).otherwise(F.array(*map(F.lit, default or [])).cast("array<string>"))


def uploaded_sites(lines: DataFrame) -> DataFrame:
    """Sites out of the six text columns ``UPLOAD``; urls that are not http or https are left out of their list."""
    urls = F.filter(list_cell(F.col("base_urls"), "|"), lambda u: u.rlike(r"(?i)^https?://[^/\s]+"))
    method = F.when(F.coalesce(F.col("collection_method"), F.lit("")) != "", F.col("collection_method")).otherwise("AUTOMATED")
    return lines.select("name", urls.alias("base_urls"), list_cell(F.col("tags"), ",").alias("tags"), list_cell(F.col("doc_exts"), ",", ["pdf"]).alias("doc_exts"), list_cell(F.col("url_keywords"), ",").alias("url_keywords"), method.alias("collection_method"))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Sites of an upload by the file's kind: JSON lines, a sheet, else text with tabs."""
    if path.endswith(".json"):
        kind = "name string, base_urls array<string>, tags array<string>, doc_exts array<string>, url_keywords array<string>, collection_method string"
        return spark.read.schema(kind).json(path)
    if path.endswith(".xlsx"):
        rows = read_sheets(spark, path)
        return uploaded_sites(rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(UPLOAD)]))
    return uploaded_sites(spark.read.schema(", ".join(f"{c} string" for c in UPLOAD)).csv(path, sep="\t"))
