"""Types of documents by multinomial logistic regression over hashed words, for those that no rule tells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import checkpointed

#: Numbers that words are hashed to. The model has one weight for each and type: with 100 types under 4 MB.
BUCKETS = 1 << 12
#: Types that a model can have.
MAX_TYPES = 200


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The distinct words of a text as numbers below ``buckets``; a null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


@dataclass
class TypeModel:
    """Weights by type and bucket, and a weight for each type alone behind them."""

    types: list[str]
    weights: np.ndarray

    def _probabilities(self, words: pa.Array) -> np.ndarray:
        row, bucket, value = _sparse(words)
        scores = np.stack([np.bincount(row, own[bucket] * value, len(words)) + own[-1] for own in self.weights], 1)
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def classified(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """key, type, confidence: each document's most probable type; texts without words have the one that is most frequent."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = self._probabilities(batch.column("_w"))
                best = told.argmax(1) if len(told) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([self.types[i] for i in best], pa.string()), pa.array(told[np.arange(len(best)), best])], names=[key, "type", "confidence"])

        rows = docs.select(F.col(key), word_buckets(F.col(text), self.weights.shape[1] - 1).alias("_w"))
        return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, type string, confidence double")


def _sparse(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each word; a row's values have length 1."""
    sizes = np.diff(words.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, words.flatten().to_numpy(), 1 / np.sqrt(np.maximum(sizes, 1))[row]


def fit(docs: DataFrame, label: str, text: str, buckets: int = BUCKETS, rounds: int = 20, rate: float = 2.0, l2: float = 1e-4) -> TypeModel | None:
    """A model from all documents whose ``label`` is told, or None if there are none.

    Each round sums the gradient over all rows: tasks add up their batches, an aggregate adds up the tasks, and the sums (types times
    buckets) come to the driver, which takes the step with momentum and sends the weights along with the next round.
    """
    rows = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), word_buckets(F.col(text), buckets).alias("_w"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).limit(MAX_TYPES + 1).collect()}
    if len(counts) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    if not counts:
        return None
    types, n = sorted(counts), sum(counts.values())
    numbers = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))])
    rows = checkpointed(rows.select(numbers[F.col("_label")].alias("_y"), "_w"))
    # it begins with the types' own frequencies
    model = TypeModel(types, np.zeros((len(types), buckets + 1)))
    model.weights[:, -1] = np.log([counts[t] / n for t in types])
    speed = np.zeros_like(model.weights)
    for _ in range(rounds):
        found = rows.mapInArrow(_gradients(model), "type int, bucket int, g double").groupBy("type", "bucket").agg(F.sum("g").alias("g")).toArrow()
        step = np.zeros_like(model.weights)
        step[found["type"].to_numpy(), found["bucket"].to_numpy()] = found["g"].to_numpy()
        penalty = l2 * model.weights
        penalty[:, -1] = 0
        speed = 0.9 * speed - rate * (step / n + penalty)
        model.weights = model.weights + speed
    return model


def _gradients(model: TypeModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(model.weights)
        for batch in batches:
            words = batch.column("_w")
            wrong = model._probabilities(words)
            wrong[np.arange(len(wrong)), batch.column("_y").to_numpy()] -= 1
            row, bucket, value = _sparse(words)
            for own, off in zip(total, wrong.T, strict=True):
                own += np.bincount(bucket, off[row] * value, len(own))
            total[:, -1] += wrong.sum(0)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[kind, bucket])], names=["type", "bucket", "g"])

    return run


def types_told(docs: DataFrame, key: str, rule: str, text: str, model: TypeModel | None) -> DataFrame:
    """key, type, by, confidence: the type that a rule tells (``rule``, a column), else the model's; null without either."""
    sure = docs.where(F.col(rule).isNotNull()).select(key, F.col(rule).alias("type"), F.lit("rule").alias("by"), F.lit(1.0).alias("confidence"))
    left = docs.where(F.col(rule).isNull())
    if model is None:
        return sure.unionByName(left.select(key, F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("by"), F.lit(0.0).alias("confidence")))
    return sure.unionByName(model.classified(left, key, text).select(key, "type", F.lit("model").alias("by"), "confidence"))
