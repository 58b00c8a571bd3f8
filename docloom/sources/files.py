"""Readers and writers: delimited exports, whole texts, page tables and content-addressed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.scalar import text_digest


def read_export(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", encoding: str = "ISO-8859-1") -> DataFrame:
    """A delimited export with a header; lines that do not fit the schema are null in what does not parse."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, escape="\\", mode="PERMISSIVE")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_texts(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """path, text: whole files, decoded and stripped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.trim(F.decode("content", encoding)).alias("text"))


def parser_of(extension: Column) -> Column:
    """The kind of parser for a file's extension (fixed values)."""
    kinds = {"pdf": "layout", "docx": "archive", "doc": "legacy", "xlsx": "sheet", "xls": "sheet", "html": "markup", "txt": "text", "csv": "text"}
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.lower(extension)]


def metadata_map(text: Column) -> Column:
    """Lines ``key: value`` as a map; a line without a key continues the one before it behind ``; ``. The last of equal keys counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    empty = F.array().cast("array<struct<k:string,v:string>>")

    def step(found: Column, line: Column) -> Column:
        key = F.regexp_extract(line, r"^([^:\s][^:]*):", 1)
        last = F.element_at(found, -1)
        fresh = F.struct(F.trim(key).alias("k"), F.trim(F.substr(line, F.length(key) + 2)).alias("v"))
        more = F.struct(last["k"].alias("k"), F.concat_ws("; ", last["v"], F.trim(line)).alias("v"))
        init = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
        return F.when(key != "", F.array_append(found, fresh)).when(F.size(found) > 0, F.array_append(init, more)).otherwise(found)

    pairs = F.aggregate(lines, empty, step)
    # of equal keys the last: those that come again are let go
    kept = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(kept)


def layout_rows(spans: DataFrame, page: list[str], y: str, x: str, text: str, tolerance: float = 1.5) -> DataFrame:
    """Spans joined to rows: a row ends where the next span lies more than ``tolerance`` below."""
    from pyspark.sql import Window

    w = Window.partitionBy(*page).orderBy(y, x)
    fresh = (F.col(y) - F.lag(y).over(w) > tolerance) | F.lag(y).over(w).isNull()
    rows = spans.withColumn("_new", fresh.cast("int")).withColumn("row", F.sum("_new").over(w) - 1)
    parts = rows.groupBy(*page, "row").agg(F.sort_array(F.collect_list(F.struct(x, text))).alias("_p"))
    return parts.select(*page, F.col("row").cast("int").alias("row"), F.array_join(F.transform("_p", lambda p: p[text]), " ").alias(text))


def add_texts(store: DataFrame | None, texts: DataFrame, text: str) -> DataFrame:
    """digest, text of the texts that a content-addressed store does not have yet, once each."""
    new = texts.select(text_digest(F.col(text)).alias("digest"), text).dropDuplicates(["digest"])
    return new if store is None else new.join(store.select("digest"), "digest", "left_anti")


def change_events(docs: DataFrame, fields: list[str]) -> DataFrame:
    """A JSON line for each document."""
    return docs.select(F.to_json(F.struct(*fields)).alias("value"))
