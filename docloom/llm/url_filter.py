"""Operator 8, URL filters: pattern rules indexed by their rarest literal token.

Each rule has a regular expression and the literal tokens that any URL it matches must hold. The rule is filed under
the one of these tokens that is rarest in the URLs to judge. A URL's own tokens fetch candidate rules, and only those
run their regular expression. Every distinct URL is judged once.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are sent to every task; more are joined by a shuffle on their token.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A compiled rule. Ranks decide between rules: the higher ``tier`` first, then the longer ``text``, then its order."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    tier: int
    named: bool


def host_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, slash, path = text.partition("/")
    regex = rf"^([^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}"
    whole = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"(?<=/)[a-z0-9]+(?=[^a-z0-9])", (slash + path).lower())
    return Rule(text, verdict, regex, tuple(dict.fromkeys(whole)), 1, True)


def pattern_rule(text: str, verdict: str) -> Rule:
    """A pattern over host and path: ``*`` is anything, ``^`` a separator or an end. Only tokens between separators are literal."""
    parts = {"*": ".*", "^": "(^|$|[^a-z0-9])"}
    regex = "(?i)" + "".join(parts.get(c) or re.escape(c) for c in text)
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text.lower())
    return Rule(text, verdict, regex, tuple(dict.fromkeys(tokens)), 0, False)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(subject: Column) -> Column:
    """The distinct runs of letters a-z and digits, in lower case, with the empty token, which files rules without tokens."""
    found = F.filter(F.split(F.lower(subject), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_union(F.array(F.lit("")), found)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict.

    The rules' number is fixed by the caller's list. Null urls and urls without ``://`` have an empty host and path and
    get ``default`` unless a rule fits the empty text; repeated rows are judged alike and all kept. Columns of ``pages``
    with one of the four names are replaced. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    # inside, the columns have names that no others can have
    names = pages.columns
    pages = pages.toDF(*[f"_c{i}" for i in range(len(names))])
    told = F.coalesce(F.col(f"_c{names.index(url_col)}").cast("string"), F.lit(""))
    judged = pages.select(told.alias("_url")).distinct()
    judged = judged.select("_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    judged = judged.withColumn("_subject", F.concat("host", "path"))
    probes = judged.select("_url", "_subject", F.explode(url_tokens(F.col("_subject"))).alias("_token"))

    schema = "array<struct<_order:int,_rule:string,_verdict:string,_regex:string,_tokens:array<string>,_tier:int,_named:boolean>>"
    told_rules = json.dumps([dict(zip(("_order", "_rule", "_verdict", "_regex", "_tokens", "_tier", "_named"), (i, *vars(r).values()), strict=True)) for i, r in enumerate(rules)])
    rule_table = spark.range(1).select(F.inline(F.from_json(F.lit(told_rules), schema)))
    send = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    rule_tokens = rule_table.select("_order", F.explode_outer("_tokens").alias("_token")).na.fill({"_token": ""})
    seen = (
        probes.join(send(rule_tokens.select("_token").distinct()), "_token", "left_semi")
        .groupBy("_token")
        .agg(F.count("*").alias("_seen"))
    )
    filed = (
        rule_tokens.join(send(seen), "_token", "left")
        .groupBy("_order")
        .agg(F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), F.col("_token"))).alias("_key"))
        .select("_order", F.col("_key._token").alias("_token"))
    )
    index = rule_table.drop("_tokens").join(send(filed), "_order")
    hits = (
        probes.join(send(index), "_token")
        .where(F.regexp_like("_subject", F.col("_regex")))
        .groupBy("_url")
        .agg(F.min(F.struct(-F.col("_tier"), -F.length("_rule"), F.col("_order"), F.col("_rule"), F.col("_verdict"), F.col("_named"))).alias("_best"))
    )
    best = F.col("_best")
    verdicts = judged.join(hits, "_url", "left").select(
        "_url",
        "host",
        "path",
        F.when(best["_named"], best["_rule"]).alias("rule"),
        F.coalesce(best["_verdict"], F.lit(default)).alias("verdict"),
    )
    rows = pages.withColumn("_url", told).join(verdicts, "_url", "left")
    return rows.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(names)], "host", "path", "rule", "verdict")
