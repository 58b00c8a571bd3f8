"""Searches and lists: conditions made from what a user typed, projections by path, fallbacks, latest matches, best candidates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.table_query import PAGE, Filter

#: Fields that are searched by words, whatever text operator was chosen (fixed values).
WORD_FIELDS = frozenset({"name", "link_text"})
WORD_OPERATORS = {"contains": "textcontains", "notContains": "textnotContains"}


def shown_filters(raw: Iterable[Mapping[str, Any]], word_fields: frozenset[str] = WORD_FIELDS) -> list[Filter]:
    """The filters of a table's header that count: those with a value (0 is one), and ranges with both ends."""
    out = []
    for f in raw:
        value, operator = f.get("value"), f["operator"]
        if isinstance(value, Mapping):
            if any(value.get(end) in (None, "") for end in ("start", "end")):
                continue
        elif value in (None, "", []) or value is False:
            continue
        if f["name"] in word_fields:
            operator = WORD_OPERATORS.get(operator, operator)
        out.append(Filter(f["name"], operator, f.get("type", "string"), value))
    return out


def held_by(locks: Column, user: Column, now: Column, same_element: bool = True) -> Column:
    """Whether a user holds a live lock: in one element, or with owner and time in any two."""
    if same_element:
        return F.coalesce(F.exists(locks, lambda x: (x["user"] == user) & (x["expires"] > now)), F.lit(False))
    return F.coalesce(F.exists(locks, lambda x: x["user"] == user) & F.exists(locks, lambda x: x["expires"] > now), F.lit(False))


def same_name(name: Column, wanted: str) -> Column:
    """Equality without regard to case; null is not equal."""
    return F.coalesce(F.lower(name) == wanted.lower(), F.lit(False))


def name_starts(name: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(F.lower(name), F.lit(prefix.lower())), F.lit(False))


def find(df: DataFrame, typed: str, key: str, name: str, url: str | None = None, limit: int = PAGE) -> DataFrame:
    """The rows that a search box asks for: a url's, a number's, or those whose name begins with the text; by key, 50 at most."""
    typed = typed.strip()
    if url and typed.lower().startswith(("http://", "https://")):
        test = F.col(url) == typed
    elif typed.isdigit():
        test = F.col(key) == int(typed)
    else:
        test = name_starts(F.col(name), typed)
    return df.where(test).orderBy(key).limit(min(limit, PAGE))


def is_web_url(url: Column) -> Column:
    """Whether a url's scheme is http or https; null is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


def wanted_download(kind: Column, allowed: Iterable[str], expected: Column, body: Column) -> Column:
    """Whether a download's type is allowed, and it is no HTML page where another extension was expected."""
    page = F.coalesce(F.lower(F.ltrim(F.substring(body, 1, 200))).rlike(r"^(<!doctype html|<html)"), F.lit(False))
    return F.coalesce(kind.isin(*allowed), F.lit(False)) & ~(page & (F.coalesce(expected, F.lit("")) != "html"))


def all_or_any(names: list[str], values: list[Any], operator: str = "AND") -> Column:
    """Equality of each field with its value, joined by AND or OR; fewer names than values: the first name stands for the rest."""
    if not names or not values:
        return F.lit(False)
    names = names + [names[0]] * (len(values) - len(names))
    tests = [F.coalesce(F.col(n) == F.lit(v), F.lit(False)) for n, v in zip(names, values, strict=False)]
    return reduce((lambda a, b: a | b) if operator.upper() == "OR" else (lambda a, b: a & b), tests)


def project(df: DataFrame, paths: Iterable[str]) -> DataFrame:
    """Only the fields at the dotted paths, inside structs and arrays of them; a path that is not there is left out."""

    def cut(column: Column, kind: T.DataType, own: list[list[str]]) -> Column:
        if any(not p for p in own):
            return column
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: cut(x, kind.elementType, own))
        return F.when(column.isNotNull(), F.struct(*parts(column, kind, own)))

    def parts(column: Column | None, kind: T.StructType, own: list[list[str]]) -> list[Column]:
        names = dict.fromkeys(p[0] for p in own if p[0] in kind.fieldNames())
        of = lambda n: F.col(f"`{n}`") if column is None else column[n]
        return [cut(of(n), kind[n].dataType, [p[1:] for p in own if p[0] == n]).alias(n) for n in names]

    return df.select(*parts(None, df.schema, [p.split(".") for p in paths]))


def without_fields(df: DataFrame, paths: Iterable[str]) -> DataFrame:
    """All fields but those at the dotted paths, inside structs too."""
    for path in paths:
        root, _, rest = path.partition(".")
        df = df.withColumn(root, F.col(f"`{root}`").dropFields(rest)) if rest else df.drop(root)
    return df


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def url_name(url: Column) -> Column:
    """The last part of a url's path, without query and fragment."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#/]*)*?/([^?#/]*)/?(?:[?#].*)?$", 1), F.lit(""))


def latest_match(rows: DataFrame, key: str, docs: DataFrame, on: str, newest: list[Column], fields: list[str]) -> DataFrame:
    """``rows`` with ``fields`` of the newest of ``docs`` that has the same ``on``; nulls where none has. ``newest`` should end with a unique key."""
    best = docs.where(F.col(on).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(on).orderBy(*newest))).where("_rank = 1")
    return rows.join(best.select(F.col(on).alias("_on"), *fields), F.col(key) == F.col("_on"), "left").drop("_on")


def numbers_of(text: Column) -> Column:
    """The distinct numbers in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def adjusted_score(score: Column, asked: Column, candidate: Column) -> Column:
    """A candidate's score: one more for each number that both have, one less for each that only one has. Numbers are those of ``numbers_of``."""
    both = F.size(F.array_intersect(asked, candidate))
    return score + both - (F.size(asked) + F.size(candidate) - 2 * both)


def with_following(rows: DataFrame, key: str, reach: int, name: str, block: int = 1024) -> DataFrame:
    """``rows`` with the array ``name`` of all rows whose whole-number keys are by 1 to ``reach`` greater. Rows without a key are left out.

    Keys are cut into blocks that also have the first rows of the next one, so a row is sent twice at most and no pair is.
    """
    own = F.floor(F.col(key) / block)
    blocks = F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own")))
    # the rows that some row of an earlier block looks for
    back = F.transform(F.sequence(F.lit(1), F.lit(-(-reach // block))), lambda n: F.struct((own - n).alias("_block"), F.lit(False).alias("_own")))
    back = F.filter(back, lambda b: F.col(key) - reach < (b["_block"] + 1) * block)
    dealt = rows.where(F.col(key).isNotNull()).select("*", F.inline(F.concat(blocks, back)))
    near = F.collect_list(F.struct(*rows.columns)).over(Window.partitionBy("_block").orderBy(key).rangeBetween(1, reach))
    return dealt.withColumn(name, near).where("_own").drop("_block", "_own")


def best_candidates(rows: DataFrame, key: str, candidates: Column, least: float = 0.5) -> DataFrame:
    """Of each key's ``candidates`` (an array of structs of candidate, score and adjusted) with a score of ``least`` or more, the one of the
    greatest adjusted score, then of the least name. Arrays are searched where they are; only their best goes on to the rows of its key."""
    order = F.transform(F.filter(candidates, lambda c: c["score"] >= least), lambda c: F.struct((-c["adjusted"]).alias("far"), c["candidate"].alias("candidate"), c["score"].alias("score")))
    best = rows.select(key, F.array_min(order).alias("_b")).where("_b IS NOT NULL").groupBy(key).agg(F.min("_b").alias("_b"))
    return best.select(key, "_b.candidate", "_b.score", (-F.col("_b.far")).alias("adjusted"))


def newest_dates(dates: Column, n: int = 25) -> Column:
    """The ``n`` newest distinct dates, oldest first; nulls go."""
    own = F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull())))
    return F.when(F.size(own) <= n, own).otherwise(F.slice(own, -n, n))


def with_previous(rows: DataFrame, page: DataFrame, key: str, edited: Column) -> DataFrame:
    """A page of rows with the earlier state of its edited ones (by ``previous``) before it; ``is_previous`` tells them apart."""
    wanted = page.where(edited & F.col("previous").isNotNull()).select(F.col("previous").alias(key)).distinct()
    old = rows.join(wanted, key, "left_semi").withColumn("is_previous", F.lit(True))
    return old.unionByName(page.withColumn("is_previous", F.lit(False)))
