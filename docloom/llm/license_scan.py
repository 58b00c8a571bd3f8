"""Operator 6, license scans: Dice coefficient over word bigrams between passages and licence templates.

Texts are normalised to lower-case words, whatever lines they stand in. A passage is any run of words that begins and ends
with a bigram of a template; longer ones only have bigrams more that the template lacks. Its size bounds the templates that
it can be similar to: with a coefficient of t or more, sizes differ by a factor of (2 - t) / t at most, and a template
of m bigrams needs t m / (2 - t) of them within that length. Where no such run has as many, nothing is compared.
Of passages that overlap, the one with the most in common is found, and then those that it leaves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.license_texts import TEMPLATES

#: The least coefficient of a find, in hundredths.
PERCENT = 80


def words(text: Column) -> Column:
    """The runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(text: Column) -> Column:
    """A hash for each pair of neighbouring words. The words are bound to a name, so that they are made once."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.xxhash64(x, y))

    return F.get(F.transform(F.array(words(text)), pairs), F.lit(0))


def _passages(at: list[int], grams: list[int], template: Counter, percent: int) -> Iterable[tuple[float, int, int, int]]:
    """For each place of a template's bigram, the best passage from there: (-coefficient, first, size, common)."""
    m = sum(template.values())
    longest, least = m * (200 - percent) // percent, -(-m * percent // (200 - percent))
    for i in range(len(at) - least + 1):
        if at[i + least - 1] - at[i] >= longest:
            continue
        seen: Counter = Counter()
        common, best = 0, (0.0, 0, 0, 0)
        for j in range(i, len(at)):
            size = at[j] - at[i] + 1
            if size > longest:
                break
            seen[grams[j]] += 1
            common += seen[grams[j]] <= template[grams[j]]
            best = min(best, (-2.0 * common / (size + m), at[i], size, common))
        if 200 * best[3] >= percent * (best[2] + m):
            yield best


def _finds(at: np.ndarray, grams: np.ndarray, templates: list[tuple[str, Counter, np.ndarray]], percent: int) -> list[tuple[int, int, str, int, int]]:
    """(first word, words, licence, common, template's bigrams) of the finds in one text."""
    found = []
    for number, (name, template, own) in enumerate(templates):
        here = np.isin(grams, own)
        n = sum(template.values())
        found += [(-common, far, first, size, name, number, n) for far, first, size, common in _passages(at[here].tolist(), grams[here].tolist(), template, percent)]
    kept: list = []
    for gone, _, first, size, name, _, n in sorted(found):
        if all(first > b + k or b > first + size for b, k, *_ in kept):  # a passage of s bigrams has s + 1 words
            kept.append((first, size, name, -gone, n))
    return [(first, size + 1, name, common, n) for first, size, name, common, n in sorted(kept)]


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, start (the passage's first word, from 0), n_words, license, common, n_template (bigrams) of each find.

    A find has 200 * common >= percent * (bigrams of the passage + n_template), each bigram counted as often as it stands in
    both. From each place of a template's bigram the best passage counts, of equal ones the shorter; of overlapping
    passages the one with more bigrams in common, then of the larger coefficient, the earlier, the shorter, the licence first
    in order of its name, the template first in order. Null and empty texts and those of one word have no finds. Repeated rows have theirs each; a
    null doc_id is an id. Templates of less than two words find nothing. Other columns are not read; empty tables give an
    empty table.
    """
    spark = docs.sparkSession
    named = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "number int, license string, notice string")
    # as many rows as the caller's templates, in the order that decides between equal ones
    told = [(r["license"], Counter(r["grams"])) for r in named.select("number", "license", _bigrams(F.col("notice")).alias("grams")).orderBy("number").collect() if r["grams"]]
    told = [(name, grams, np.array(sorted(grams), np.int64)) for name, grams in told]
    every = np.unique(np.concatenate([own for *_, own in told] or [np.empty(0, np.int64)]))
    least = min((-(-sum(grams.values()) * percent // (200 - percent)) for _, grams, _ in told), default=1)
    rows = docs.select("doc_id", _bigrams(F.col("text")).alias("grams"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("grams")
            grams, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            hits = np.flatnonzero(np.isin(grams, every))
            ends = np.searchsorted(hits, offsets)
            which, finds = [], []
            for row in np.flatnonzero(np.diff(ends) >= least).tolist():
                own = hits[ends[row] : ends[row + 1]]
                found = _finds(own - offsets[row], grams[own], told, percent)
                which += [row] * len(found)
                finds += found
            columns = [pa.array(c, t) for c, t in zip(zip(*finds, strict=True), _KINDS, strict=True)] if finds else [pa.array([], t) for t in _KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *columns], names=["doc_id", "start", "n_words", "license", "common", "n_template"])

    return rows.mapInArrow(run, f"doc_id {kind}, start int, n_words int, license string, common int, n_template int")


_KINDS = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())


def oracle_sql(percent: int = PERCENT) -> str:
    """DuckDB SQL for the fixed templates over ``documents``: all passages between two hits, then the best of each text in turn."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(notice)})" for i, (name, notice) in enumerate(TEMPLATES))
    split = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
    WITH RECURSIVE tw AS (SELECT number, license, {split("notice")} AS w FROM (VALUES {values}) AS v(number, license, notice)),
    tg AS (SELECT number, license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, len(w) - 1 AS m FROM tw),
    t AS (SELECT number, license, m, g, count(*) AS c FROM tg GROUP BY ALL),
    dw AS (SELECT doc_id, {split("text")} AS w FROM documents),
    d AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, unnest(range(0, len(w) - 1)) AS pos FROM dw),
    h AS MATERIALIZED (SELECT doc_id, number, license, m, g, c, pos FROM d JOIN t USING (g)),
    p AS (SELECT a.doc_id, a.number, a.license, a.m, a.pos AS first, b.pos - a.pos + 1 AS size FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.number = b.number AND b.pos BETWEEN a.pos AND a.pos + a.m * {200 - percent} // {percent} - 1),
    n AS (SELECT p.doc_id, p.number, p.license, p.m, first, size, h.g, least(count(*), any_value(h.c)) AS c FROM p JOIN h ON h.doc_id = p.doc_id AND h.number = p.number AND h.pos BETWEEN first AND first + size - 1 GROUP BY ALL),
    s AS (SELECT doc_id, number, license, m, first, size, CAST(sum(c) AS BIGINT) AS common FROM n GROUP BY ALL),
    b AS (SELECT doc_id, struct_pack(gone := -common, far := -2.0::DOUBLE * common / (size + m), first := first, size := size, license := license, number := number, common := common, m := m) AS f FROM s
          QUALIFY row_number() OVER (PARTITION BY doc_id, number, first ORDER BY -2.0::DOUBLE * common / (size + m), size) = 1),
    l AS (SELECT doc_id, list_sort(list(f)) AS rest FROM b WHERE 200 * f.common >= {percent} * (f.size + f.m) GROUP BY doc_id),
    r AS (SELECT doc_id, rest[1] AS f, list_filter(rest, lambda x: x.first > rest[1].first + rest[1].size OR rest[1].first > x.first + x.size) AS rest FROM l
          UNION ALL SELECT doc_id, rest[1], list_filter(rest, lambda x: x.first > rest[1].first + rest[1].size OR rest[1].first > x.first + x.size) FROM r WHERE len(rest) > 0)
    SELECT doc_id, CAST(f.first AS INTEGER) AS start, CAST(f.size + 1 AS INTEGER) AS n_words, f.license AS license, CAST(f.common AS INTEGER) AS common, CAST(f.m AS INTEGER) AS n_template FROM r
    """
