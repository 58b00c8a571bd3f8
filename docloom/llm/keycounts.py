"""How often keys stand in a whole corpus, told to each block of texts that asks for its own keys.

The corpus is cut into blocks. A block sends its sorted distinct keys, with its own counts of them, to the buckets of the
key space; a bucket adds up what all blocks have sent and answers each with the totals, in the order in which it asked.
So no key, however common, costs more than one entry a block, and the keys as a whole are nowhere in one place.

Up to ``FAN`` buckets, blocks ask them directly. Beyond it a row for each block and bucket would make the rows grow with
the square of the corpus; there relays stand between, each for some blocks and a range of buckets, which merge what their
blocks ask and pass the answers on.

Keys are unsigned integers below 2**62. Sorted keys are sent as the low bits of each, as many as the mean gap has, and the
rest in unary, two or three bits a key, so that a key's bytes depend on the size of a block and not on the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import give_back

#: Buckets that blocks ask without relays. So many leave a hundred keys and more to the row of a block and a bucket.
FAN = 16_384
ASK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])
ASK_DDL, ANSWER_DDL = "block long, bucket int, keys binary, counts binary", "block long, bucket int, totals binary, stats array<long>"
#: What is told about all keys of a bucket: some sums, which are added up over the buckets.
Stats = Callable[[np.ndarray, np.ndarray], list[int]]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys (uint64) in a few bits each."""
    m = len(keys)
    if not m:
        return b""
    gap = (int(keys[-1]) - int(keys[0]) + 1) // m
    low = max(0, gap.bit_length() - 1)
    rest = keys - keys[0]
    high = (rest >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(m + int(high[-1]), np.uint8)
    unary[high + np.arange(m)] = 1
    raw = rest.astype("<u8").view(np.uint8).reshape(m, 8)
    odd = np.unpackbits(raw[:, low // 8, None], axis=1, bitorder="little", count=low % 8) if low % 8 else np.empty(0, np.uint8)
    head = np.array([m, low, int(keys[0])], "<u8").tobytes()
    return head + raw[:, : low // 8].tobytes() + np.packbits(odd.ravel(), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    m, low, first = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    whole, odd = divmod(low, 8)
    data, at = np.frombuffer(blob, np.uint8), 24
    raw = np.zeros((m, 8), np.uint8)
    raw[:, :whole] = data[at : at + m * whole].reshape(m, whole)
    at += m * whole
    if odd:
        size = -(-m * odd // 8)
        bits = np.unpackbits(data[at : at + size], bitorder="little", count=m * odd).reshape(m, odd)
        raw[:, whole] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
        at += size
    high = np.flatnonzero(np.unpackbits(data[at:], bitorder="little"))[:m] - np.arange(m)
    return raw.view("<u8").ravel() + (high.astype(np.uint64) << np.uint64(low)) + np.uint64(first)


def pack_counts(counts: np.ndarray) -> bytes:
    """Two bits for each count; for those of 3 and more a byte follows, and for those too large for one the whole number."""
    code = np.minimum(counts, 3).astype(np.uint8)
    more = counts[code == 3] - 3
    return np.packbits(code & 1).tobytes() + np.packbits(code >> 1).tobytes() + np.minimum(more, 255).astype(np.uint8).tobytes() + more[more >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    size = -(-n // 8)
    one, two = (np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n) for at in (0, size))
    counts = one.astype(np.int64) + 2 * two
    large = counts == 3
    k = int(large.sum())
    more = np.frombuffer(blob, np.uint8, k, 2 * size).astype(np.int64)
    whole = more == 255
    if whole.any():
        more[whole] = np.frombuffer(blob, "<i8", -1, 2 * size + k)
    counts[large] += more
    return counts


class Layout:
    """How many blocks and buckets there are, and which ranges of keys blocks ask for at once."""

    def __init__(self, n_blocks: int, n_buckets: int, key_bits: int, fan: int | None = None):
        self.n_blocks, self.n_buckets, self.key_bits = n_blocks, n_buckets, key_bits
        self.relayed = n_buckets > (FAN if fan is None else fan)
        # a relay stands for as many blocks as there are ranges, so that it holds about what one block does
        self.n_ranges = isqrt(n_buckets - 1) + 1 if self.relayed else n_buckets
        self.n_fine = -(-n_buckets // self.n_ranges)
        self.n_lanes = -(-n_blocks // self.n_ranges)

    def edges(self, n: int) -> np.ndarray:
        """The first keys of ``n`` equal ranges of the key space (without the first range's)."""
        return np.array([(i << self.key_bits) // n for i in range(1, n)], np.uint64)

    def asked(self, keys: np.ndarray, counts: np.ndarray, block: int) -> pa.Table:
        """A block's questions: one row for each range, in order."""
        return _rows(keys, counts, self.edges(self.n_ranges), block, 0)

    def answered(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The totals of a block's keys in their order, and the sums of the stats."""
        order = np.argsort(answers.column("bucket").to_numpy())
        blobs, stats = answers.column("totals").to_pylist(), answers.column("stats").to_pylist()
        totals = [_whole(blobs[i]) for i in order]
        return np.concatenate(totals or [np.empty(0, np.int64)]), np.array(stats, np.int64).sum(0) if len(stats) else np.zeros(0, np.int64)


def _whole(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    return unpack_counts(blob[4:], n)


def _told(totals: np.ndarray) -> bytes:
    return np.array([len(totals)], "<u4").tobytes() + pack_counts(totals)


def _rows(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray, block: int, first: int) -> pa.Table:
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    parts = list(zip(at[:-1], at[1:], strict=True))
    return pa.table(
        [
            pa.array([block] * len(parts), pa.int64()),
            pa.array(range(first, first + len(parts)), pa.int32()),
            pa.array([pack_keys(keys[a:b]) for a, b in parts], pa.binary()),
            pa.array([pack_counts(counts[a:b]) for a, b in parts], pa.binary()),
        ],
        schema=ASK,
    )


def _read(asks: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each row's keys; the distinct keys of all rows, where each row's keys are among them, and their counts."""
    give_back()
    keys = [unpack_keys(b) for b in asks.column("keys").to_pylist()]
    counts = [unpack_counts(b, len(k)) for b, k in zip(asks.column("counts").to_pylist(), keys, strict=True)]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    # weights are floats, which are exact up to 2**53
    return keys, distinct, at, np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _spread(asks: pa.Table, keys: list[np.ndarray], at: np.ndarray, totals: np.ndarray, stats: list[int]) -> pa.Table:
    ends = np.cumsum([len(k) for k in keys])[:-1]
    blobs = [_told(totals[own]) for own in np.split(at, ends)]
    return pa.table([asks.column("block"), asks.column("bucket"), pa.array(blobs, pa.binary()), pa.array([stats] * len(blobs), pa.list_(pa.int64()))], schema=ANSWER)


def _sum(stats: Stats) -> Callable[[pa.Table], pa.Table]:
    def run(asks: pa.Table) -> pa.Table:
        keys, distinct, at, totals = _read(asks)
        return _spread(asks, keys, at, totals, stats(distinct, totals))

    return run


def _merge(layout: Layout) -> Callable[[pa.Table], pa.Table]:
    def run(asks: pa.Table) -> pa.Table:
        _, distinct, _, counts = _read(asks)
        own, relay = asks.column("bucket")[0].as_py(), asks.column("relay")[0].as_py()
        return _rows(distinct, counts, _fine(layout, own), relay, own * layout.n_fine)

    return run


def _fine(layout: Layout, own: int) -> np.ndarray:
    """The edges inside one range."""
    low, high = ((own + i << layout.key_bits) // layout.n_ranges for i in (0, 1))
    return np.array([low + (high - low) * i // layout.n_fine for i in range(1, layout.n_fine)], np.uint64)


def _pass_on(layout: Layout) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, asks: pa.Table, answers: pa.Table) -> pa.Table:
        keys, _, at, _ = _read(asks)
        totals, stats = layout.answered(answers)
        return _spread(asks, keys, at, totals, stats.tolist())

    return run


def totals(asks: DataFrame, layout: Layout, stats: Stats) -> DataFrame:
    """block, bucket, totals, stats for each row of ``asks`` (``ASK``), which holds what ``Layout.asked`` gives.

    Every block asks every range, if for no key; so all ranges tell it their stats. No rows give no rows.
    """
    if not layout.relayed:
        return asks.groupBy("bucket").applyInArrow(_sum(stats), ANSWER_DDL)
    relay = F.col("block") % layout.n_lanes * layout.n_ranges + F.col("bucket")
    asks = asks.withColumn("relay", relay)
    inner = asks.groupBy("relay").applyInArrow(_merge(layout), ASK_DDL).groupBy("bucket").applyInArrow(_sum(stats), ANSWER_DDL)
    return asks.groupBy("relay").cogroup(inner.groupBy("block")).applyInArrow(_pass_on(layout), ANSWER_DDL)


def no_stats(keys: np.ndarray, totals: np.ndarray) -> list[int]:
    return []
