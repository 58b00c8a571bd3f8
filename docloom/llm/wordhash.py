"""Word hashes and packed key chunks in numpy, for the operators that count word sequences in Arrow batches.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. A word's hash is a polynomial over its
bytes modulo 2**64, mixed; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; bounds the memory beside the batch itself (about 30 bytes for each).
SEGMENT = 1 << 19
_LIBC = ctypes.CDLL(None)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256)
_BYTES[65:91] += 32
_CODES = mix(_BYTES.astype(np.uint64) + np.uint64(0x51ED2701))
_POWERS: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, kept for the next call."""
    if name not in _POWERS or len(_POWERS[name]) < n:
        row = np.full(max(n, SEGMENT + 4096), base, np.uint64)
        row[0] = 1
        _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS[name][:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """The hashes of the byte runs ``data[starts:ends]``, which are in order and do not overlap."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers("base", _BASE, len(data)), out=total[1:])
    own = (total[ends] - total[starts]) * powers("inverse", _INVERSE, len(data) + 1)[starts]
    return mix(own ^ mix((ends - starts).astype(np.uint64)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (with the end of the last); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes of text; a longer text is its own."""
    offsets = np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


#: What workers keep between tasks of one operator, as functions that drop it.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    """Drops what a worker has kept for other operators."""
    for drop in KEPT:
        drop()
    gc.collect()
    give_back()


def give_back() -> None:
    """Hands memory that numpy and Arrow have freed back to the system: a worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about ``size`` bytes of text."""
    for batch in batches:
        for at, end in row_slices(batch.column("text"), size):
            yield batch.slice(at, end - at)
        del batch
        give_back()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and each text's number of words."""
    data, offsets = text_bytes(texts)
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return hashes[0], counts
    begins = np.zeros(len(data), bool)
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = 0
    while at < len(data):
        # a segment ends behind white space or where a text does, wherever that comes
        end = min(at + SEGMENT, len(data))
        while end < len(data):
            cut = SPACE[data[end - 1 : end + 65535]] | np.append(begins[end : end + 65536], True)[: len(data[end - 1 : end + 65535])]
            if cut.any():
                end += int(cut.argmax())
                break
            end = min(end + 65536, len(data))
        part = data[at:end]
        word = ~SPACE[part]
        fresh = begins[at:end].copy()
        fresh[0] = True
        starts = np.flatnonzero(word & (fresh | np.append(True, ~word[:-1])))
        ends = np.flatnonzero(word & np.append(fresh[1:] | ~word[1:], True)) + 1
        hashes.append(run_hashes(part, starts, ends))
        counts += np.diff(np.searchsorted(starts + at, offsets))
        at = end
    return np.concatenate(hashes), counts


def scatter(buckets: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' values by bucket, in their order."""
    order = np.argsort(buckets, kind="stable")
    ends = np.cumsum(np.bincount(buckets, minlength=n_buckets))
    columns = [c[order] for c in columns]
    start = 0
    for bucket, end in enumerate(ends):
        if end > start:
            yield bucket, [c[start:end] for c in columns]
        start = end
