"""Operator 7, approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The driver fits the tree on a bounded sample; every vector is filed under its leaf. A query walks the tree with a priority
queue of nodes, the best centroid first, and visits the leaves in the order in which it meets them. How many leaves are
visited is calibrated: visits widen until the sample's own queries find the wanted share of their true neighbours, and for
each query until the leaves it has met hold as many vectors as it asks for.

Equal vectors are filed once, with as many of their ids as any query can return, so copies make no leaf large; a leaf that
is large all the same is dealt over several shelves, as the groups of leaves are called that one task looks through. So are its queries,
each slice of which gets a copy of the shelf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import written

#: Vectors that the tree is fitted on, at most; the sample's queries, for calibration.
SAMPLE, SAMPLE_QUERIES = 20_000, 200
#: Children of a node; vectors of a leaf (of the sample) and on a shelf, at most.
BRANCHES, LEAF, SHELF = 8, 128, 16_384
#: Queries that a shelf looks up at once, and about as many as one task gets; more of them get copies of the shelf.
ASKED, QUERIES = 64, 16_384
#: The share of the true neighbours that the sample's queries must find. The wanted recall is 0.9.
CALIBRATED_RECALL = 0.97


@dataclass
class Tree:
    """Nodes by number, 0 the root: centroids, children (none: a leaf), and each leaf's place among the leaves."""

    centroids: np.ndarray
    children: list[list[int]]
    visits: int = 1

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down from the root, to the nearest child."""
        at = np.zeros(len(vectors), np.int64)
        moved = np.arange(len(vectors))
        while len(moved):
            moved = moved[[bool(self.children[n]) for n in at[moved]]]
            for node in np.unique(at[moved]):
                own, kids = moved[at[moved] == node], np.array(self.children[node])
                at[own] = kids[_nearest(vectors[own], self.centroids[kids])]
        return at

    def leaves(self, scores: np.ndarray, visits: int, enough: int = 0, sizes: dict[int, int] | None = None) -> list[int]:
        """The first ``visits`` leaves that best-bin-first meets, and more until their ``sizes`` sum to ``enough``.

        ``scores`` has the query's inner product with each centroid.
        """
        queue, found, held = [(-scores[0], 0)], [], 0
        while queue and (len(found) < visits or held < enough):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(node)
                held += sizes.get(node, 0) if sizes else 0
            for child in self.children[node]:
                heapq.heappush(queue, (-scores[child], child))
        return found


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def _means(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Each vector's cluster of at most ``k``, by Lloyd's rounds from random vectors."""
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(vectors, centres)
        centres = np.stack([vectors[own == i].mean(0) if (own == i).any() else centres[i] for i in range(k)])
    return _nearest(vectors, centres)


def grow(sample: np.ndarray, leaf: int = LEAF, seed: int = 0) -> Tree:
    """A tree over the sample whose leaves hold at most ``leaf`` of its vectors, but for equal ones."""
    rng = np.random.default_rng(seed)
    tree, open_ = Tree(sample.mean(0)[None], [[]]), [(0, np.arange(len(sample)))]
    centroids = [sample.mean(0)]
    while open_:
        node, rows = open_.pop()
        if len(rows) <= leaf:
            continue
        own = _means(sample[rows], min(BRANCHES, len(rows)), rng)
        if len(kinds := np.unique(own)) < 2:
            continue
        for kind in kinds:
            centroids.append(sample[rows[own == kind]].mean(0))
            tree.children[node].append(len(tree.children))
            open_.append((len(tree.children), rows[own == kind]))
            tree.children.append([])
    tree.centroids = np.stack(centroids)
    return tree


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float = CALIBRATED_RECALL, seed: int = 1) -> Tree:
    """Sets the number of leaves to visit: as few as find ``recall`` of the true ``k`` neighbours of the sample's queries."""
    own = np.random.default_rng(seed).permutation(len(sample))[:SAMPLE_QUERIES]
    leaf = tree.file(sample)
    n_leaves = sum(not c for c in tree.children)
    needed = []
    for i in own:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        k_ = min(k, len(sample) - 1)
        if k_ < 1:
            continue
        place = {node: n for n, node in enumerate(tree.leaves(tree.centroids @ sample[i], n_leaves), 1)}
        needed += [place[x] for x in leaf[np.argpartition(-scores, k_ - 1)[:k_]]]
    tree.visits = int(np.quantile(needed, recall, method="higher")) if needed else n_leaves
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _filed(tree: Tree):
    def run(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.file(_matrix(batch.column("vector"))).astype(np.int32))], names=[*batch.schema.names, "leaf"])

    return run


def shelves(counts: dict[int, int], n_shelves: int) -> dict[int, tuple[int, int]]:
    """The first and the last shelf of each leaf, about as many vectors on each. A leaf larger than a shelf is dealt over several."""
    room = max(1, -(-sum(counts.values()) // n_shelves))
    out, filled, shelf = {}, 0.0, 0
    for leaf, n in sorted(counts.items()):
        first, pieces = shelf, -(-n // room)
        for piece in range(pieces):
            last = shelf
            filled += n / pieces
            if filled >= room:
                shelf, filled = shelf + 1, 0.0
        out[leaf] = (first, last)
    return out


def _visited(tree: Tree, places: dict[int, tuple[int, int]], sizes: dict[int, int], enough: int):
    """A row for each query and shelf, with the leaves to look through there."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            at, on, leaves = [], [], []
            for row, scores in enumerate(_matrix(batch.column("vector")) @ tree.centroids.T):
                own: dict[int, list[int]] = {}
                for leaf in tree.leaves(scores, tree.visits, enough, sizes):
                    for shelf in range(places[leaf][0], places[leaf][1] + 1) if leaf in places else ():
                        own.setdefault(shelf, []).append(leaf)
                at += [row] * len(own)
                on += own
                leaves += own.values()
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(on, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=[*batch.schema.names, "shelf", "leaves"])

    return run


def _search(k: int):
    """On one shelf, the ``k`` nearest ids for each query that visits it."""

    def run(key, queries: pa.Table, members: pa.Table) -> pa.Table:
        number, best = [], []
        if len(queries) and len(members):
            ids, base = members.column("ids").to_pylist(), _matrix(members.column("vector").combine_chunks())
            reach = np.abs(base).max()
            kinds, leaf = np.unique(members.column("leaf").to_numpy(), return_inverse=True)
            for part in queries.combine_chunks().to_batches(max_chunksize=ASKED):
                asked = _matrix(part.column("vector"))
                scores = asked @ base.T
                seen = np.stack([np.isin(kinds, x) for x in part.column("leaves").to_pylist()])
                scores[~seen[:, leaf]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(base) > k else np.full(len(scores), -np.inf)
                # sums of a block depend on its shape in their last digits: what is near is summed again, from the first component on
                margin = 1e-9 * np.abs(asked).sum(1) * reach
                for query, vector, own, low in zip(part.column("query").to_pylist(), asked, scores, least - margin, strict=True):
                    near = np.flatnonzero((own >= low) & (own > -np.inf))
                    exact = np.cumsum(base[near] * vector, axis=1)[:, -1]
                    number.append(query)
                    best.append([{"far": far, "vec_id": v} for far, v in heapq.nsmallest(k, ((-e, v) for j, e in zip(near.tolist(), exact.tolist(), strict=True) for v in ids[j]))])
        return pa.table([pa.array(number, pa.int64()), pa.array(best, pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))], names=["query", "found"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, leaf: int = LEAF, recall: float = CALIBRATED_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products found for each row that ``queries`` is true for.

    ``vectors`` has vec_id (long) and embedding (array of numbers). Rows with a null id or vector, a zero vector, an empty
    one, or null or non-finite components take no part; vectors of more than one length are an error. Equal scores: the
    smaller vec_id first. A row is no neighbour of its own id; repeated rows of an id count as one candidate for each distinct vector.
    Fewer than ``k`` candidates: all of them. Other columns are not read; an empty table gives an empty table.
    """
    # 32-bit numbers are sent as they are and widened where they are multiplied
    narrow = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    vector = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    # equal vectors once, with the ids that any query can return: k, and one more for the query's own
    few = Window.partitionBy("vector").orderBy("vec_id")
    base = rows.select("vector", "vec_id").distinct().withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= k + 1)
    base = written(base.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    kind = base.schema["vector"].dataType.simpleString()

    n, shortest, longest = base.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} components: all must have as many")
    # the smallest hashes; few more than are taken pass the filter
    place = F.pmod(F.xxhash64("vector"), F.lit(1_000_000_000))
    sample = base.where(place < 1_000_000_000 * min(1.0, 1.2 * SAMPLE / max(n, 1))).select("vector").orderBy(place, "vector").limit(SAMPLE).collect()
    if not sample:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    sample = np.array(sorted(r["vector"] for r in sample))
    tree = calibrate(grow(sample, leaf), sample, k, recall)

    filed = written(base.mapInArrow(_filed(tree), f"vector {kind}, ids array<long>, leaf int"), "vector-leaves")
    # one row for each leaf of the tree, whose size the sample bounds
    counted = filed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    sizes = {r["leaf"]: r["ids"] for r in counted}
    places = shelves({r["leaf"]: r["n"] for r in counted}, -(-n // SHELF))
    first, last = (F.create_map(*[x for leaf, on in places.items() for x in (F.lit(leaf), F.lit(on[i]))])[F.col("leaf")] for i in (0, 1))
    members = filed.select((first + F.pmod(F.xxhash64("vector"), last - first + 1)).cast("int").alias("shelf"), "leaf", "vector", "ids")
    # equal queries walk once; the smallest id stands for them
    asks = rows.where("asks").groupBy("vector").agg(F.min("vec_id").alias("query"))
    visits = asks.select("query", "vector").mapInArrow(_visited(tree, places, sizes, k + 1), f"query long, vector {kind}, shelf int, leaves array<int>")
    # a query visits a shelf once at most, so slices of queries bound what a task holds
    slices = max(1, -(-asks.count() // QUERIES))
    visits = visits.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
    members = members.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    found = visits.groupBy("shelf", "slice").cogroup(members.groupBy("shelf", "slice")).applyInArrow(_search(k + 1), "query long, found array<struct<far:double,vec_id:long>>")
    # a query has k + 1 ids at most from each of its shelves
    found = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    # every row that asks gets its vector's neighbours, without itself
    own = rows.where("asks").join(asks, "vector").select(F.col("vec_id").alias("query_id"), "query").distinct()
    told = own.join(found, "query").select("query_id", F.inline("found")).where(F.col("vec_id") != F.col("query_id")).withColumn("score", -F.col("far"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
