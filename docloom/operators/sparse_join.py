"""The nearest names by the cosine of weighted character trigrams, over postings that bounds have cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import checkpointed

GRAM = 3


def grams(text: Column, n: int = GRAM) -> Column:
    """All runs of ``n`` characters of the lower-case text between two spaces, in order and with repeats."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array(padded))


def _vectors(texts: DataFrame, counts: DataFrame, n_texts: int) -> DataFrame:
    """text, vector: (df, gram, w) in order of rarity, of length 1. ``counts`` has gram, df of the side that is searched."""
    each = texts.select("text", F.explode(grams(F.col("text"))).alias("gram")).groupBy("text", "gram").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (F.log((n_texts + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    rows = each.join(counts, "gram", "left").select("text", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", weight.alias("w")).alias("t"))
    whole = rows.groupBy("text").agg(F.sort_array(F.collect_list("t")).alias("v"), F.sqrt(F.sum(F.col("t.w") * F.col("t.w"))).alias("size"))
    return whole.select("text", F.transform("v", lambda t: F.struct(t["df"].alias("df"), t["gram"].alias("gram"), (t["w"] / F.col("size")).alias("w"))).alias("v"))


def _postings(vectors: DataFrame, least: float) -> DataFrame:
    """gram, text: the rarest grams of each text, up to where what remains is shorter than ``least``.

    Two unit vectors whose product reaches ``least`` have their rarest common gram among these on both sides: else all that they have
    in common would be part of a remainder that is too short.
    """
    far = F.aggregate("v", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, t: F.struct((s["sum"] + t["w"] * t["w"]).alias("sum"), (s["n"] + F.when(1 - s["sum"] >= least * least - 1e-9, 1).otherwise(0)).alias("n")))["n"]
    return vectors.select("text", F.explode(F.slice("v", F.lit(1), far)).alias("t")).select("t.gram", "text")


def nearest_names(queries: DataFrame, items: DataFrame, k: int = 20, least: float = 0.5) -> DataFrame:
    """query, item, score, rank: for each distinct text of ``queries`` (text) the ``k`` distinct texts of ``items`` (text) nearest to it.

    Nearness is the cosine of trigram counts, weighted by their rarity among the distinct items, and ``least`` or more; ties (of nine digits) go
    to the text first in order. Equal texts are one, however many rows have them. Null and blank texts have no part. Pairs come from an
    equi-join of the postings that bounds leave; their products are then summed over whole vectors.
    """
    clean = lambda df: df.select(F.lower(F.trim("text")).alias("text")).where("text <> ''").distinct()
    queries, items = checkpointed(clean(queries)), checkpointed(clean(items))
    counts = checkpointed(items.select(F.explode(F.array_distinct(grams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")))
    n = items.count()
    x, y = (checkpointed(_vectors(t, counts, n)) for t in (queries, items))
    pairs = _postings(x, least).withColumnRenamed("text", "query").join(_postings(y, least).withColumnRenamed("text", "item"), "gram").select("query", "item").distinct()
    weights = F.map_from_entries(F.transform("v", lambda t: F.struct(t["gram"], t["w"])))
    both = pairs.join(x.select(F.col("text").alias("query"), F.col("v").alias("_x")), "query").join(y.select(F.col("text").alias("item"), weights.alias("_y")), "item")
    score = F.aggregate("_x", F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.try_element_at(F.col("_y"), t["gram"]), F.lit(0.0)))
    first = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "item")
    return both.select("query", "item", score.alias("score")).where(F.col("score") >= least).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
