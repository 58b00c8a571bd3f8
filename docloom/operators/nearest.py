"""The vectors that can be among the nearest of queries, by matrix products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products that are held at once, and how far they may be from those in columns.
PRODUCTS, MARGIN = 4_000_000, 1e-5


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; not numbers where squares could leave the range of doubles."""
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where((norms > 1e-75) & (norms < 1e75), norms, np.nan)


def _matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: (places, vectors as rows) of what has a cosine; not of null, zero or empty ones or those with a null."""
    told: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    offsets, values, valid = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(float), vectors.values.is_valid().to_numpy(zero_copy_only=False)
    for i, known in enumerate(vectors.is_valid().to_numpy(zero_copy_only=False)):
        own = slice(offsets[i], offsets[i + 1])
        if known and valid[own].all() and values[own].any():
            places, rows = told.setdefault(own.stop - own.start, ([], []))
            places.append(i)
            rows.append(values[own])
    return {n: (np.array(places), np.array(rows)) for n, (places, rows) in told.items()}


def near_pairs(queries: DataFrame, items: DataFrame, k: int, blocks: int) -> DataFrame:
    """a, x, b, y: pairs that hold the ``k`` of the greatest cosine for every row of ``queries`` (a, x) among ``items`` (b, y) but itself.

    Queries are copied to blocks of items. A block multiplies them as matrices and keeps what is as near as its own ``k``-th, with a margin
    for rounding; the caller scores and ranks the few that are left. Of equal items the ``k`` + 1 of the smallest ids are enough. Pairs
    without a cosine count as 0, of them the first by id are kept; those with a product that is no finite number all are.
    """

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        asked, own = asked.combine_chunks(), own.sort_by("b").combine_chunks()
        if not (asked.num_rows and own.num_rows):
            return pa.table({"a": asked["a"], "x": asked["x"], "b": asked["a"], "y": asked["x"]}).slice(0, 0)
        x, y = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (asked["x"].combine_chunks(), own["y"].combine_chunks()))
        a, b = asked["a"].to_numpy(), own["b"].to_numpy()
        left, right = _matrices(x), _matrices(y)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        odd = np.ones(len(a), bool)
        for n, (of, rows) in left.items():
            odd[of], rows = False, _unit(rows)
            to, others = right.get(n, (np.zeros(0, int), np.zeros((0, n))))
            if len(to):
                _, same = np.unique(others, axis=0, return_inverse=True)
                order = np.argsort(same.ravel(), kind="stable")
                _, first, size = np.unique(same.ravel()[order], return_index=True, return_counts=True)
                few = np.sort(order[np.arange(len(order)) - np.repeat(first, size) <= k])
                to, others = to[few], _unit(others[few])
            none = np.setdiff1d(np.arange(len(b)), right.get(n, (to,))[0])[: k + 1]
            step = max(PRODUCTS // max(len(to) + len(none), 1), 1)
            for low in range(0, len(of), step):
                part = of[low : low + step]
                with np.errstate(all="ignore"):
                    score = np.concatenate([rows[low : low + step] @ others.T, np.zeros((len(part), len(none)))], axis=1)
                places = np.concatenate([to, none])
                score[a[part][:, None] == b[places][None, :]] = -np.inf
                finite = np.where(np.isnan(score) | (score == np.inf), -np.inf, score)
                least = np.partition(finite, -k, axis=1)[:, -k] if len(places) >= k else np.full(len(part), -np.inf)
                i, j = np.nonzero(~(score < least[:, None] - MARGIN) & (score != -np.inf))
                pairs.append((part[i], places[j]))
        (lone,) = odd.nonzero()
        pairs.append((np.repeat(lone, min(len(b), k + 1)), np.tile(np.arange(min(len(b), k + 1)), len(lone))))
        i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
        out = pa.table({"a": a[i], "x": x.take(pa.array(i)), "b": b[j], "y": y.take(pa.array(j))})
        return out.filter(pa.array(a[i] != b[j]))

    asked = queries.select("a", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_p"))
    own = items.select("b", "y", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int").alias("_q"))
    kind = items.schema["y"].dataType.simpleString()
    return asked.groupBy("_p").cogroup(own.groupBy("_q")).applyInArrow(run, f"a long, x {kind}, b long, y {kind}")
