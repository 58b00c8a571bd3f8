"""The text index against scans of stems, and the nearest names against all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import sparse_join, text_index
from docloom.session import shared_path


def stemmed(word):
    for ending, put, kept in (("ies", "y", r"[^e]{2,}ies$"), ("es", "", r"(ss|x|ch|sh)es$"), ("ing", "", r"...ing$"), ("ed", "", r"...ed$"), ("s", "", r"..[^su]s$")):
        if re.search(kept, word):
            return word[: -len(ending)] + put
    return word


def test_stems(spark):
    told = {"policies": "policy", "boxes": "box", "classes": "class", "walking": "walk", "walked": "walk", "fees": "fee", "bus": "bus", "red": "red", "sing": "sing", "gas": "gas", "class": "class", "x": "x"}
    rows = spark.createDataFrame([(w,) for w in told], "w string").select("w", text_index.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == told == {w: stemmed(w) for w in told}


TEXTS = ["walk", "walks walked", "The fees, of THE box", "of the", "the of the box", "box; fee", "Fees of boxes", None, "", "--", "a a a b a a b", "naïve café 42"]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(1)
    more = [" ".join(rng.choice(["walk", "fees", "of", "the", "box", "a", "b"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    rows = list(enumerate(TEXTS + more)) + [(None, "walk")]
    docs = spark.createDataFrame([(i, t, 0, 0, "t") for i, t in rows], "id long, text string, bucket int, at int, term string")
    return {i: t for i, t in rows if i is not None}, text_index.write_index(docs, "id", F.col("text"), shared_path(spark, "test-index"), buckets=8)


def scanned(texts, asked):
    def terms(text):
        return [stemmed(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]

    def follows(text, phrase):
        own, wanted = terms(text), terms(phrase)
        return bool(wanted) and any(own[i : i + len(wanted)] == wanted for i in range(len(own)))

    wanted, banned, any_ = asked
    return {i for i, t in texts.items() if (all(follows(t, p) for p in wanted) if wanted else set(terms(t)) & set(terms(any_))) and not any(follows(t, p) for p in banned)}


@pytest.mark.parametrize(
    ("text", "asked"),
    [
        ("Walking fee", ([], [], "walking fee")),
        ('"of the" box', (["of the"], [], "")),
        ('"a a" "a b" -walk', (["a a", "a b"], ["walk"], "")),
        ('fees -"the box" -of', ([], ["the box", "of"], "fees")),
        ('"a a b a"', (["a a b a"], [], "")),
        ("café", ([], [], "café")),
        ("nowhere", ([], [], "nowhere")),
        ("--", ([], [], "")),
        ('""', ([""], [], "")),
    ],
)
def test_searches_equal_scans(spark, index, text, asked):
    texts, own = index
    found = [r["id"] for r in own.search(spark, text).collect()]
    assert sorted(found) == sorted(scanned(texts, asked))


def test_only_the_buckets_of_the_terms_are_read(spark, index):
    own = index[1]
    plan = own.postings(spark, own._terms(spark, "walk"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (= \d+|IN)", plan) and re.search(r"PushedFilters: \[[^]]*EqualTo\(term,walk\)", plan)


def all_pairs(queries, items, k, least):
    names = sorted({t.strip().lower() for t in items if t and t.strip()})
    asked = sorted({t.strip().lower() for t in queries if t and t.strip()})

    def counted(text):
        padded = f" {text} "
        return Counter(padded[i : i + 3] for i in range(len(padded) - 2))

    df = Counter(g for t in names for g in counted(t))

    def vector(text):
        own = {g: n * (math.log((len(names) + 1) / (df[g] + 1)) + 1) for g, n in counted(text).items()}
        size = math.sqrt(sum(w * w for w in own.values()))
        return {g: w / size for g, w in own.items()}

    vectors = {t: vector(t) for t in names}
    for q in asked:
        own = vector(q)
        scores = [(-round(sum(w * vectors[t].get(g, 0.0) for g, w in own.items()), 9), t) for t in names]
        for rank, (score, t) in enumerate(sorted(s for s in scores if -s[0] >= least)[:k], 1):
            yield (q, rank, t), -score


@pytest.mark.parametrize(("k", "least"), [(3, 0.5), (20, 0.5), (5, 0.8), (4, 0.2)])
def test_nearest_names_are_those_of_all_pairs(spark, k, least):
    rng = random.Random(9)
    names = [" ".join(rng.choice(["alpha", "alphas", "beta", "betamax", "10", "100", "mg", "x", "Zeta "]) for _ in range(rng.randint(1, 4))) for _ in range(120)] + ["", " ", None, "a"]
    asked = rng.sample(names, 60) + ["alpa", "beta max", "unknown", None, "a"]
    frame = lambda texts: spark.createDataFrame([(t, 1) for t in texts], "text string, df int")
    found = sparse_join.nearest_names(frame(asked), frame(names), k, least).collect()
    expected = dict(all_pairs(asked, names, k, least))
    assert {(r["query"], r["rank"], r["item"]): pytest.approx(r["score"], abs=1e-8) for r in found} == expected and len(found) == len(expected)


def test_no_names(spark):
    empty = spark.createDataFrame([], "text string")
    some = spark.createDataFrame([("a b",)], "text string")
    assert sparse_join.nearest_names(empty, some).count() == 0 == sparse_join.nearest_names(some, empty).count()
