"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and token output over ``documents``.

Each stage takes all that the one before it has kept, with all its columns, whatever their names. In every stage an empty table
gives an empty table, and a row with a null doc_id is a document like others, but that it has no copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, mixing, ngram_join, token_file
from docloom.llm.base import new_dir, table, written
from docloom.llm.catalog import MIX_WEIGHTS, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the network learns from the labels of the table itself.

    Null texts, texts without a letter and those in which no language leads go; without any label all go. Repeated rows are
    judged alike. Equal probabilities: the language first in order.
    """
    return language_id.keep_identified(docs, language_id.fit(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its shingles of five words: that of the smallest doc_id.

    Null and empty texts and null ids are in no group and stay; of repeated rows of one id one stays.
    """
    return ngram_join.keep_first(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts, and a benchmark without items, leave all; rows of one doc_id go together, those of a null one by their texts.
    """
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, which the order of files and of rows in them keeps.

    Null sources are one source; ties in a source are ordered by a digest of the id, then by the other columns' hash.
    """
    placed = mixing.mix_sources(docs, MIX_WEIGHTS)
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, written as token segments in the order of files and rows, and read back as digests.

    A null text has the end id alone; null ids and repeated rows are kept, as their places tell them apart.
    """
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rows = docs.select("doc_id", "text", number.alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))
    segments = token_file.write_tokens(rows, new_dir(spark, "tokens"), tokenizer_path, order=["file", "name", "row"])
    return token_file.read_tokens(segments, digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix),
    ("token_file", write_ids),
]

#: SQL cannot express the trained network and the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
