"""Operator 3, mixing sources to target weights: Pfair scheduling in DataFrame functions only.

A source of integer weight a among weights of sum A owes its k-th block (k from 0) to one slot of the window from its
release time floor(kA/a) up to its deadline ceil((k+1)A/a). In every slot the released block of the earliest deadline
goes out, so that after any number of slots each source has within less than one block of its share. The schedule repeats
after A slots. When a source has no more blocks, the others go on with their own weights, in a new phase.

The schedule is a table made by ``plan`` from the block counts: a phase has a row for each of its slots, but for no more
than one period. Documents find their place in it by joins; none passes the driver and no source is sorted in one task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block, and in one sort group of a source (16 to the power of the prefix's digits groups share a source).
BLOCK_ROWS, GROUP_ROWS = 16, 20_000
#: The schedule is made on the driver, for at most so many sources, slots in a period and rows in all (some 50 bytes each);
#: more are an error that comes before the work. Sources of n different lengths have n phases, of n * n / 2 slots at weight 1.
MAX_SOURCES, MAX_PERIOD, MAX_SLOTS = 10_000, 100_000, 1_000_000


def period(weights: dict[str, int], slots: int | None = None) -> list[str]:
    """The sources of the slots 0 .. A-1, or of the first ``slots`` of them, by earliest deadline first among released blocks."""
    total = sum(weights.values())
    order: list[str] = []
    ready = [(-(-total // a), s, 0) for s, a in weights.items()]  # deadline, source, number of its block
    heapq.heapify(ready)
    later: list[tuple[int, int, str, int]] = []  # release, deadline, source, number
    for slot in range(total if slots is None else min(slots, total)):
        while later and later[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        _, s, k = heapq.heappop(ready)
        order.append(s)
        k += 1
        if k < weights[s]:
            heapq.heappush(later, (k * total // weights[s], -(-(k + 1) * total // weights[s]), s, k))
    return order


def plan(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """The phases (source, phase, first block, end, first slot, weight, period) and their slots (phase, source, k, slot)."""
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    used, at, phase = dict.fromkeys(left, 0), 0, 0
    phases, slots = [], []
    while left:
        own = {s: weights[s] for s in left}
        total = sum(own.values())
        # the phase ends at the latest with the deadline of the last block of the source that is over first
        most = min(-(-n * total // own[s]) for s, n in left.items())
        if len(slots) + min(total, most) > MAX_SLOTS:
            raise ValueError(f"the schedule needs more than {MAX_SLOTS} slots: use fewer sources or smaller weights")
        order = period(own, most)
        places: dict[str, list[int]] = {s: [] for s in own}
        for slot, s in enumerate(order):
            places[s].append(slot)
        # the slot after the one in which a source's last block goes out
        last = {s: (n - 1) // own[s] * total + places[s][(n - 1) % own[s]] for s, n in left.items() if (n - 1) % own[s] < len(places[s])}
        end = min(last.values()) + 1
        whole, rest = divmod(end, total)
        for s in own:
            n = whole * own[s] + sum(p < rest for p in places[s])
            phases.append({"source": s, "phase": phase, "low": used[s], "high": used[s] + n, "base": at, "weight": own[s], "period": total})
            used[s] += n
            left[s] -= n
            slots += [{"phase": phase, "source": s, "k": k, "slot": p} for k, p in enumerate(places[s]) if p < end]
        left = {s: n for s, n in left.items() if n}
        at, phase = at + end, phase + 1
    return phases, slots


def _local(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split(":")[0] for c in schema.split(",")]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def order_key(doc_id: Column) -> Column:
    """The order of documents in a source: by a digest of the id, which is as good as shuffled."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with mix_source, mix_block (of the source, from 0), mix_slot (from 0) and mix_position (the order of the mix).

    ``docs`` has doc_id and source; every row is kept once, whatever its other columns. Sources without a weight take
    ``default_weight``; weights are positive integers. A null source counts as the empty one. A source is ordered by
    ``order_key``; rows of one id by their other columns' hash. A source's last block may be short. Columns of ``docs``
    that are named like the four new ones are replaced. An empty table gives an empty table.
    """
    weights = weights or {}
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_position")
    # inside, the columns have names that no others can have
    names, kinds = docs.columns, [kind for _, kind in docs.dtypes]
    own = [f"_c{i}" for i in range(len(names))]
    docs = docs.toDF(*own)
    doc_id, source = F.col(own[names.index("doc_id")]), F.col(own[names.index("source")])
    keyed = docs.withColumn("mix_source", F.coalesce(source.cast("string"), F.lit(""))).withColumn("_key", order_key(doc_id))
    counted = {r["mix_source"]: r["n"] for r in keyed.groupBy("mix_source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    digits = 1
    while sum(counted.values()) > GROUP_ROWS * 16**digits:
        digits += 1
    shares = {s: weights.get(s, default_weight) for s in counted}
    if sum(shares.values()) > MAX_PERIOD or min(shares.values(), default=1) < 1:
        raise ValueError(f"weights must be positive and their sum at most {MAX_PERIOD}")
    phases, slots = plan({s: -(-n // block_rows) for s, n in counted.items()}, shares)
    keyed = keyed.withColumn("_group", F.substring("_key", 1, digits))
    sizes = keyed.groupBy("mix_source", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("mix_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("mix_source", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ties = F.xxhash64(*[F.col(c) for c, kind in zip(own, kinds, strict=True) if "map<" not in kind and "variant" not in kind])
    inside = Window.partitionBy("mix_source", "_group").orderBy("_key", ties)
    placed = (
        keyed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, ["mix_source", "_group"])
        .withColumn("_rank", F.col("_start") + F.col("_row"))
        .withColumn("mix_block", F.floor(F.col("_rank") / block_rows))
    )
    phase_table = _local(docs, phases, "source:string,phase:int,low:long,high:long,base:long,weight:int,period:int")
    slot_table = _local(docs, slots, "phase:int,source:string,k:int,slot:long")
    p, block = phase_table.withColumnRenamed("source", "_source"), F.col("mix_block")
    found = placed.join(F.broadcast(p), (F.col("mix_source") == F.col("_source")) & (block >= F.col("low")) & (block < F.col("high")))
    found = found.withColumn("k", ((block - F.col("low")) % F.col("weight")).cast("int"))
    s = slot_table.withColumnRenamed("source", "_source")
    found = found.join(F.broadcast(s), ["_source", "phase", "k"])
    slot = F.col("base") + F.floor((block - F.col("low")) / F.col("weight")) * F.col("period") + F.col("slot")
    return found.select(
        *[F.col(c).alias(name) for c, name in zip(own, names, strict=True)],
        "mix_source",
        "mix_block",
        slot.alias("mix_slot"),
        (slot * block_rows + F.col("_rank") % block_rows).alias("mix_position"),
    )


def largest_deviation(slots: list[str], weights: dict[str, int]) -> Fraction:
    """The largest distance, in blocks, of a source's count from its share after any number of ``slots``."""
    total, done, worst = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for n, s in enumerate(slots, 1):
        done[s] += 1
        worst = max([worst, *(abs(done[x] - Fraction(n * a, total)) for x, a in weights.items())])
    return worst


def oracle_sql(weights: dict[str, int], default_weight: int = 1, block_rows: int = BLOCK_ROWS) -> str:
    """DuckDB SQL for the place of each of ``documents`` (of distinct ids): one slot after another, by recursion, without periods."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    weight = f"CASE source {' '.join(f'WHEN {quoted(s)} THEN {a}' for s, a in weights.items())} ELSE {default_weight} END" if weights else str(default_weight)
    every, total = "range(1, len(ws) + 1)", "list_sum(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN n[i] > 0 THEN ws[i] ELSE 0 END))"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS k FROM documents),
    c AS (SELECT source, {weight} AS w, (count(*) + {block_rows - 1}) // {block_rows} AS n FROM d GROUP BY source),
    l AS (SELECT list(source ORDER BY source) AS ss, list(CAST(w AS BIGINT) ORDER BY source) AS ws, list(CAST(n AS BIGINT) ORDER BY source) AS ns FROM c),
    r AS (
        SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS base, ss, ws, ns, ns AS n, list_transform(ns, lambda x: CAST(0 AS BIGINT)) AS k, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS block FROM l WHERE len(ns) > 0
        UNION ALL
        SELECT slot, CASE WHEN n[s] = 1 THEN slot + 1 ELSE base END, ss, ws, ns, list_transform({every}, lambda i: CASE WHEN i = s THEN n[i] - 1 ELSE n[i] END),
            list_transform({every}, lambda i: CASE WHEN n[s] = 1 THEN 0 WHEN i = s THEN k[i] + 1 ELSE k[i] END), s, ns[s] - n[s]
        FROM (SELECT slot + 1 AS slot, base, ss, ws, ns, n, k, list_min(list_transform(list_filter({every}, lambda i: n[i] > 0 AND k[i] * a // ws[i] <= slot + 1 - base), lambda i: struct_pack(deadline := ((k[i] + 1) * a + ws[i] - 1) // ws[i], i := i))).i AS s
            FROM (SELECT *, CAST({total} AS BIGINT) AS a FROM r WHERE list_sum(n) > 0))
    )
    SELECT doc_id, d.source AS mix_source, d.k // {block_rows} AS mix_block, r.slot AS mix_slot, r.slot * {block_rows} + d.k % {block_rows} AS mix_position
    FROM d JOIN r ON r.slot >= 0 AND r.ss[r.s] = d.source AND r.block = d.k // {block_rows}
    """
