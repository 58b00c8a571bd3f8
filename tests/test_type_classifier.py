"""The classifier against the same steps in numpy, on held-out texts, and on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import type_classifier as tc
from docloom.session import table


def test_steps_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    vocabulary = {"a": ["fee", "rate", "cost", "the"], "b": ["drug", "dose", "the", "list"], "c": ["plan", "the"]}
    docs = [(i, " ".join(rng.choice(vocabulary[t], rng.integers(0, 6))), t) for i, t in enumerate(rng.choice(["a", "b", "c"], 90, p=[0.5, 0.3, 0.2]))]
    frame = spark.createDataFrame([(int(i), str(t), str(y)) for i, t, y in docs], "id long, text string, label string").repartition(5)
    model = tc.fit(frame, "label", "text", buckets=64, rounds=6)
    rows = frame.select("id", tc.word_buckets(F.col("text"), 64).alias("w"), "label").collect()
    x, y = np.zeros((len(rows), 65)), np.array(["abc".index(r["label"]) for r in rows])
    for i, r in enumerate(rows):
        x[i, r["w"]] = 1 / np.sqrt(max(len(r["w"]), 1))
    x[:, -1] = 1
    w, speed = np.zeros((3, 65)), np.zeros((3, 65))
    w[:, -1] = np.log(np.bincount(y) / len(y))
    for _ in range(6):
        p = np.exp(x @ w.T)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        penalty = 1e-4 * w
        penalty[:, -1] = 0
        speed = 0.9 * speed - 2.0 * (p.T @ x / len(y) + penalty)
        w = w + speed
    assert model.types == ["a", "b", "c"] and np.allclose(model.weights, w, atol=1e-9)
    told = {r["id"]: r["type"] for r in model.classified(frame, "id", "text").collect()}
    assert told == {r["id"]: "abc"[(x[i] @ w.T).argmax()] for i, r in enumerate(rows)}


def test_held_out_texts(spark):
    """Languages stand in for types: their words are as apart as those of kinds of documents are."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("lang IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = tc.fit(docs.where(~held), "lang", "text")
    told = model.classified(docs.where(held), "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(told) > 30 and np.mean([r["type"] == r["lang"] for r in told]) > 0.85


def test_odd_rows(spark):
    schema = "id long, text string, label string, type string"
    docs = spark.createDataFrame([(1, "x y", "a", "z"), (2, None, "a", "z"), (3, "", "b", "z"), (None, "x", None, "z"), (4, "q " * 50_000, None, "z")], schema)
    model = tc.fit(docs, "label", "text", rounds=2)
    found = {r["id"]: (r["type"], r["by"]) for r in tc.types_told(docs, "id", "label", "text", model).collect()}
    assert found[1] == ("a", "rule") and found[3] == ("b", "rule") and found[None] == ("a", "model") and found[4][1] == "model"
    assert tc.fit(docs.where("label IS NULL"), "label", "text") is None
    assert tc.types_told(docs, "id", "label", "text", None).where("type IS NULL").count() == 2
    assert model.classified(docs.limit(0), "id", "text").count() == 0
    many = spark.range(tc.MAX_TYPES + 1).selectExpr("id", "'x' AS text", "CAST(id AS STRING) AS label")
    with pytest.raises(ValueError, match="types"):
        tc.fit(many, "label", "text")
