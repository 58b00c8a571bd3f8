"""The language of a text by ranked n-grams: profiles are tables, and the distance of a text to them is a join.

The n-grams of a text are counted where the text is, as whole numbers, so what Spark shuffles and joins are counts and not places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import checkpointed

#: The longest n-gram (of three characters at most, as a whole number holds them), and how many of the most frequent make a profile.
LONGEST, TOP = 3, 200
#: Profile rows up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Characters that are counted at once, n-grams that a task holds, and texts of one batch of results.
STEP, HELD, ROWS = 1 << 20, 1 << 20, 256
#: Bits of a character; the mark between texts is no character.
BITS, MARK = 21, (1 << 21) - 1


def only_letters(text: Column) -> Column:
    """The lower-case text between spaces, in which whatever is no letter is one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _counts(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one to ``LONGEST`` characters as numbers in their order, and how often each stands; none of a space alone or with a mark."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(chars), STEP):
        part = chars[at : at + STEP + LONGEST - 1]
        grams, marked = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
        every = []
        for n in range(min(LONGEST, len(part))):
            size = len(part) - n
            grams, marked = grams[:size] | part[n:] << BITS * (LONGEST - 1 - n), marked[:size] | (part[n:] == MARK)
            every.append(grams[:STEP][~marked[:STEP]])
        found.append(np.unique(np.concatenate(every), return_counts=True))
    codes, n = _summed(found) if len(found) > 2 else found[-1]
    blank = np.isin(codes, [32 << BITS * (LONGEST - 1), 32 << BITS * (LONGEST - 1) | 32 << BITS * (LONGEST - 2)])
    return codes[~blank], n[~blank]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several counts as one."""
    codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, place, np.concatenate([n for _, n in found]))
    return codes, n


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _texts(codes: np.ndarray) -> list[str]:
    """N-grams as texts."""
    own = np.stack([codes >> BITS * (LONGEST - 1 - n) & MARK for n in range(LONGEST)], 1).astype(np.uint32)
    return own.view(f"<U{LONGEST}")[:, 0].tolist() if len(own) else []


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n out of (lang, text): the sums of a task; they are let go whenever they are many."""
    held: dict = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), kind), pa.array(_texts(codes), pa.string()), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        texts: dict = {}

        def add(lang) -> None:
            held[lang] = _summed([held.get(lang, (np.zeros(0, np.int64),) * 2), _counts(np.concatenate(texts.pop(lang)))])

        sizes: dict = {}
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, own = lang.as_py(), _chars(text.as_py())
            texts.setdefault(lang, []).extend([own, np.array([MARK])])
            sizes[lang] = sizes.get(lang, 0) + len(own) + 1
            if sizes[lang] >= STEP:
                sizes[lang] = 0
                add(lang)
        for lang in list(texts):
            add(lang)
        if sum(len(codes) for codes, _ in held.values()) > HELD:
            yield from told()
    yield from told()


def _by_text(top: int | None):
    """key, grams, n out of (key, text): the ``top`` most frequent n-grams of each text in order of rank; all, if None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                found = [_counts(_chars(text.as_py())) for text in rows.column(1)]
                # codes are in order, so that the sort leaves ties to the n-gram
                firsts = [np.argsort(-n, kind="stable")[:top] for _, n in found]
                places = pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32())
                grams = _texts(np.concatenate([codes[f] for (codes, _), f in zip(found, firsts, strict=True)]))
                counts = np.concatenate([n[f] for (_, n), f in zip(found, firsts, strict=True)])
                lists = [pa.ListArray.from_arrays(places, x) for x in (pa.array(grams, pa.string()), pa.array(counts))]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=["_key", "grams", "n"])

    return run


def _ranked(counts: DataFrame, by: str) -> DataFrame:
    """``by``, gram, rank (from 0) of the most frequent n-grams of each; ties go by the n-gram."""
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < TOP).select(by, "gram", "rank")


def profiles(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, gram, rank of every language that is told, over all of its texts. Rows with a null language take no part."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), only_letters(F.col(text)).alias("text"))
    counts = rows.mapInArrow(_by_language, f"lang {rows.schema['lang'].dataType.simpleString()}, gram string, n long")
    return _ranked(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang")


def _own_grams(docs: DataFrame) -> DataFrame:
    """_key, gram, rank, size (the number of these rows) of the ranked n-grams of each key of ``docs`` (_key, _text); a key without any has one row of nulls.

    Texts whose key stands once are ranked where they are; counts of those of repeated keys are summed before.
    """
    kinds = f"_key {docs.schema['_key'].dataType.simpleString()}, grams array<string>, n array<long>"
    repeated = checkpointed(docs.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_again")))
    many = repeated.count()
    again = F.broadcast(repeated) if many <= BROADCAST_ROWS else repeated
    same = F.col("_key").eqNullSafe(F.col("_again"))
    once = docs.join(again, same, "left_anti") if many else docs
    own = once.mapInArrow(_by_text(TOP), kinds).select("_key", F.size("grams").alias("size"), F.posexplode_outer("grams").alias("rank", "gram")).select("_key", "gram", "rank", "size")
    if not many:
        return own
    counts = docs.join(again, same, "left_semi").mapInArrow(_by_text(None), kinds).select("_key", F.explode_outer(F.arrays_zip("grams", "n")).alias("g"))
    ranked = _ranked(counts.groupBy("_key", F.col("g.grams").alias("gram")).agg(F.sum("g.n").alias("n")).where("gram IS NOT NULL"), "_key")
    ranked = ranked.withColumn("size", F.count("*").over(Window.partitionBy("_key")).cast("int"))
    none = repeated.select(F.col("_again").alias("_key"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("int").alias("rank"), F.lit(0).alias("size"))
    return own.unionByName(ranked).unionByName(none)


def detected(docs: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, lang, distance: the nearest of the ``known`` profiles (lang, gram, rank) to each document.

    The distance of a text is the mean, over its own ranked n-grams, of how far their ranks in both profiles are apart, and of TOP where
    a profile has none. Ties go to the language first in order. A text without letters, a null one, or one that has no n-gram in common
    with any profile has none (null). Rows of one key count together; null keys are one document.
    """
    own = _own_grams(docs.select(F.col(key).alias("_key"), only_letters(F.col(text)).alias("_text")))
    near = known.select("lang", "gram", F.col("rank").alias("_rank"))
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    # what a common n-gram takes off the greatest distance
    met = own.join(near, "gram", "left").groupBy("_key", "lang").agg(F.sum(TOP - F.abs(F.col("rank") - F.col("_rank"))).alias("near"), F.max("size").alias("size"))
    best = F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("near")).alias("far"), "lang")))
    told = met.groupBy("_key").agg(best.alias("_b"), F.max("size").alias("size"))
    return told.select(F.col("_key").alias(key), "_b.lang", (TOP + F.col("_b.far") / F.col("size")).alias("distance"))
