"""Operator 7 with more queries than a task takes, and scores that no batch changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import vector_tree


def test_many_queries_of_one_shelf(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 24)).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    told = lambda: sorted(map(tuple, vector_tree.search(vectors, F.lit(True), k=5).collect()))
    whole = told()
    monkeypatch.setattr(vector_tree, "QUERIES", 60)  # nine slices, on one shelf
    monkeypatch.setattr(vector_tree, "ASKED", 7)
    assert told() == whole
    # each score is the plain sum over the components, to the last digit
    own = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for query, _, other, score in whole:
        plain = 0.0
        for x, y in zip(own[query].tolist(), own[other].tolist(), strict=True):
            plain += x * y
        assert score == plain
    assert len(whole) == 2500
