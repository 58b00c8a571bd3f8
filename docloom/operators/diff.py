"""Differences between versions: blanked footers, words, tags and extracted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank_footers(docs: DataFrame, key: str, pages: Column) -> DataFrame:
    """key, text: pages (an array of arrays of lines) joined by form feeds, with lines that stand exactly once on every page blanked.

    One page, or none, is as it is; null pages give null. Everything is in the row, so nothing is shuffled.
    """

    def blanked(p: Column) -> Column:
        once = lambda line: F.forall(p, lambda lines: F.size(F.filter(lines, lambda x: x == line)) == 1)
        footers = F.when(F.size(p) > 1, F.filter(F.get(p, F.lit(0)), lambda line: (F.trim(line) != "") & once(line))).otherwise(F.array().cast("array<string>"))
        # bound to a name, so that footers are found once
        return F.get(F.transform(F.array(footers), lambda f: F.array_join(F.transform(p, lambda lines: F.array_join(F.transform(lines, lambda x: F.when(F.array_contains(f, x), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "\n")), "\f")), F.lit(0))

    return docs.select(key, F.get(F.transform(F.array(pages), blanked), F.lit(0)).alias("text"))


def word_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, word, n: how often each word stands in a text. Texts are dealt by their key, so that words are counted and joined by it where they are."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("_text"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.select(key, text.alias("_text")).repartition(key).select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def word_changes(counts: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, word, change: how many more of a word ``new`` has than ``old`` (below 0: fewer); words that are as many are left out.

    ``counts`` has _doc, word, n; ``pairs`` has key, old, new (ids). Only counts are joined and shuffled, no text is.
    """
    sides = pairs.select(key, F.inline(F.array(F.struct(F.col("old").alias("_doc"), F.lit(-1).alias("_d")), F.struct(F.col("new").alias("_doc"), F.lit(1).alias("_d")))))
    both = counts.join(sides, "_doc").select(key, "word", (F.col("n") * F.col("_d")).alias("n"))
    return both.groupBy(key, "word").agg(F.sum("n").alias("change")).where("change <> 0")


def tag_changes(current: DataFrame, previous: DataFrame, key: list[str], field: str) -> DataFrame:
    """key, status: ADDED, REMOVED, CHANGED or UNCHANGED, by the field's value on both sides."""
    a = previous.select(*key, F.struct(field).alias("_old"))
    b = current.select(*key, F.struct(field).alias("_new"))
    both = b.join(a, key, "full")
    status = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").when(F.col("_old").eqNullSafe(F.col("_new")), "UNCHANGED").otherwise("CHANGED")
    return both.select(*key, status.alias("status"))


def paired_tags(current: DataFrame, previous: DataFrame, code: str, page: str) -> DataFrame:
    """code, removed, added, changed: each code's tags of both versions paired in the order of their pages; changed ones are on another page.

    Tags are counted by code and page before they meet. The pairs that stay on a page are where the page's places on both sides
    overlap, so a code is a row for each page, however many tags it has. Null pages are one page, before the others.
    """
    side = lambda df, a, b: df.select(code, F.col(page).alias("_page"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    pages = side(current, 1, 0).unionByName(side(previous, 0, 1)).groupBy(code, "_page").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    w = Window.partitionBy(code).orderBy(F.asc_nulls_first("_page")).rowsBetween(Window.unboundedPreceding, 0)
    ends = pages.withColumns({f"_{s}_end": F.sum(f"_{s}").over(w) for s in "ab"})
    both = F.least("_a_end", "_b_end") - F.greatest(F.col("_a_end") - F.col("_a"), F.col("_b_end") - F.col("_b"))
    sums = ends.groupBy(code).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(F.greatest(both, F.lit(0))).alias("_same"))
    more = F.col("_a") - F.col("_b")
    return sums.select(code, F.greatest(-more, F.lit(0)).alias("removed"), F.greatest(more, F.lit(0)).alias("added"), (F.least("_a", "_b") - F.col("_same")).alias("changed"))


def new_elements(candidate: Column, existing: Column) -> Column:
    """Elements of one array that the other has not."""
    return F.array_except(candidate, existing)


def row_delta(current: DataFrame, previous: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """code, status, n: rows added, edited and removed between two extractions.

    Equal rows of a code are taken off against each other, one for one, by their counts. Of the rows left, as many as both sides have are
    edits, more current ones are added, more previous ones removed.
    """
    count = lambda df, name: df.select(code, F.xxhash64(*fields).alias("_h")).groupBy(code, "_h").agg(F.count("*").alias(name))
    sides = count(current, "_a").join(count(previous, "_b"), [code, "_h"], "full")
    more = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    both = sides.groupBy(code).agg(F.sum(F.greatest(more, F.lit(0))).alias("a"), F.sum(F.greatest(-more, F.lit(0))).alias("b"))
    rows = F.array(
        F.struct(F.lit("edit").alias("status"), F.least("a", "b").alias("n")),
        F.struct(F.lit("add").alias("status"), (F.col("a") - F.least("a", "b")).alias("n")),
        F.struct(F.lit("remove").alias("status"), (F.col("b") - F.least("a", "b")).alias("n")),
    )
    return both.select(code, F.inline(rows)).where("n > 0")


def delta_ratios(delta: DataFrame, total: int | Column) -> DataFrame:
    """added, edited and removed over a total."""
    part = lambda s: (F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)) / F.lit(total)).alias(s)
    return delta.agg(part("add"), part("edit"), part("remove"))
