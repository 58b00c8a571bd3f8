"""A text index as a table: terms with the places where they stand, in buckets by term, of which a search reads those it names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of an index; each is a folder of files in which the rows of a term stand together.
BUCKETS = 64


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A word without its plural, past or progressive ending, if a stem of three letters or more is left."""
    told = (
        F.when(word.rlike("[^e]{2,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("...(ing|ed)$"), F.regexp_replace(word, "(ing|ed)$", ""))
        .when(word.rlike("..[^su]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    # no other letter ends one of the endings
    return F.when(F.substring(word, -1, 1).isin("s", "g", "d"), told).otherwise(word)


@dataclass(frozen=True)
class TextIndex:
    """Where an index is, the name of its key and whether its terms are stems."""

    path: str
    key: str
    stems: bool
    buckets: int

    def _terms(self, spark: SparkSession, text: str) -> list[tuple[str, int]]:
        """The terms of a query in order, with their buckets. As many rows as the query has words."""
        told = F.explode(F.transform(words(F.lit(text)), lambda w: _term(w, self.stems)))
        return [tuple(r) for r in spark.range(1).select(told.alias("term")).select("term", _bucket(F.col("term"), self.buckets)).collect()]

    def postings(self, spark: SparkSession, terms: list[tuple[str, int]]) -> DataFrame:
        """term, key, at of the given terms: only the files of their buckets are read."""
        own = spark.read.parquet(self.path)
        return own.where(F.col("bucket").isin(sorted({b for _, b in terms})) & F.col("term").isin(sorted({t for t, _ in terms}))).select("term", self.key, "at")

    def any_word(self, spark: SparkSession, text: str) -> DataFrame:
        """key: the documents in which at least one word of ``text`` stands, once each."""
        return self.postings(spark, self._terms(spark, text)).select(self.key).distinct()

    def phrase(self, spark: SparkSession, text: str) -> DataFrame:
        """key: the documents in which the words of ``text`` follow one another, once each. A phrase without words is in none."""
        terms = self._terms(spark, text)
        places = F.explode(F.filter(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, (t, _) in enumerate(terms)] or [F.struct(F.lit("").alias("term"), F.lit(0).alias("i"))]), lambda p: p["term"] == F.col("term")))
        starts = self.postings(spark, terms).select(self.key, "at", places.alias("p")).select(self.key, (F.col("at") - F.col("p.i")).alias("start"))
        # a place holds one term, so as many rows as words are the whole phrase
        return starts.groupBy(self.key, "start").agg(F.count("*").alias("n")).where(F.col("n") == max(len(terms), 1)).select(self.key).distinct()

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """key: what the query finds: all of its quoted phrases, or else any of its words; nothing with a word or phrase behind a ``-``."""
        phrases, plain = query.split('"')[1::2], query.split('"')[0::2]
        banned = [p for p, before in zip(phrases, plain, strict=False) if before.endswith("-")]
        wanted = [p for p, before in zip(phrases, plain, strict=False) if not before.endswith("-")]
        rest = " ".join(plain).split()
        banned += [w[1:] for w in rest if w.startswith("-") and len(w) > 1]
        rest = [w for w in rest if not w.startswith("-")]
        if wanted:
            found = self.phrase(spark, wanted[0])
            for p in wanted[1:]:
                found = found.join(self.phrase(spark, p), self.key, "left_semi")
        else:
            found = self.any_word(spark, " ".join(rest))
        for p in banned:
            found = found.join(self.phrase(spark, p), self.key, "left_anti")
        return found


def _term(word: Column, stems: bool) -> Column:
    return stem(word) if stems else word


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def write_index(docs: DataFrame, key: str, text: Column, path: str, stems: bool = True, buckets: int = BUCKETS) -> TextIndex:
    """Writes the index of ``text`` below ``path``: a row for each word of each document (term, key, at).

    Rows go to the files of their bucket; a bucket that a frequent term makes large is split over several. Null keys have no
    place in an index and are left out; null texts have no words. Rows of one key count as one document whose texts each
    begin at place 0. Files are ordered by a hash of the term, as whole numbers are compared faster than terms, keys and places.
    """
    rows = docs.where(F.col(key).isNotNull()).select(key, F.posexplode(words(text)).alias("at", "_w")).select(_term(F.col("_w"), stems).alias("term"), key, "at")
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", F.xxhash64("term")).write.partitionBy("bucket").parquet(path)
    return TextIndex(path, key, stems, buckets)
