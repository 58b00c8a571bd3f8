"""Operator 2, token-ID / binary output: patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, in ascending order of doc_id or of other columns. Its ids are cut into blocks of 128. From
each block its minimum is subtracted; the differences are packed at the width that a percentile of them fits, and those
that do not fit go to the block's list of exceptions whole. An index in front holds where each block begins, by which a range
of ids is read without the blocks before it (``read_range``).

    segment := "DLT2" u32:n_ids u32:n_blocks u32:n_docs  i64:doc_id[n_docs] bit:is_null[n_docs] u32:n_tokens[n_docs]  u32:start[n_blocks + 1]  block*
    block   := u32:minimum u8:width u8:n_exceptions  packed bits  u8:place[n_exceptions] u32:value[n_exceptions]

Segments are rows of a Parquet table in the shared folder, which Spark commits task by task, so that a lost executor
leaves no half-written file. A segment's shard and its number within give the order; ``offsets`` counts the ids before it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.wordhash import KEPT, give_back, mix, run_hashes, text_bytes, text_slices

BLOCK, PERCENTILE = 128, 90
#: A segment is closed when it holds so many ids (a document is never split).
SEGMENT_IDS = 1 << 18
#: Distinct pieces of text whose ids a worker keeps (under 100 bytes each).
CACHE_PIECES = 500_000
#: Text bytes that are encoded at once.
SLICE_BYTES = 1 << 19
#: Words that the library gets in one string.
LINE_PIECES = 500
END_ID = 2
MAGIC = b"DLT2"


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (unsigned 32-bit), and where each begins (with the end of the last)."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return b"", np.zeros(1, np.uint32)
    # the last block is filled with its own first id, which adds no width
    full = np.append(ids, np.repeat(ids[(n_blocks - 1) * BLOCK], n_blocks * BLOCK - len(ids))).reshape(n_blocks, BLOCK).astype(np.uint32)
    low = full.min(1)
    rest = full - low[:, None]
    rank = -(-PERCENTILE * BLOCK // 100) - 1
    width = np.ceil(np.log2(np.partition(rest, rank, 1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
    out: list = [None] * n_blocks
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        values = rest[own]
        over = values >= np.uint64(1 << int(w))
        bits = (values[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.reshape(len(own), -1).astype(np.uint8), axis=1, bitorder="little")
        counts = over.sum(1)
        heads = np.zeros((len(own), 6), np.uint8)
        heads[:, :4] = low[own].astype("<u4").view(np.uint8).reshape(-1, 4)
        heads[:, 4], heads[:, 5] = w, counts
        rows, places = np.nonzero(over)
        extra = values[rows, places].astype("<u4")
        ends = np.cumsum(counts)
        places = places.astype(np.uint8)
        for i, block in enumerate(own):
            at = slice(ends[i] - counts[i], ends[i])
            out[block] = heads[i].tobytes() + packed[i].tobytes() + places[at].tobytes() + extra[at].tobytes()
    return b"".join(out), np.append(0, np.cumsum([len(b) for b in out])).astype(np.uint32)


def unpack(data: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks."""
    n_blocks = len(starts) - 1
    out = np.zeros((n_blocks, BLOCK), np.uint32)
    raw, starts = np.frombuffer(data, np.uint8), starts[:-1].astype(np.int64)
    if not n_blocks:
        return out.ravel()
    heads = raw[starts[:, None] + np.arange(6)]
    low, width, counts = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel(), heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        packed = raw[starts[own][:, None] + 6 + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        out[own] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32)) if w else 0
    tail = starts + 6 + BLOCK // 8 * width
    rows = np.repeat(np.arange(n_blocks), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    value_at = tail[rows] + counts[rows] + 4 * number
    out[rows, raw[tail[rows] + number]] = np.ascontiguousarray(raw[value_at[:, None] + np.arange(4)]).view("<u4").ravel()
    return (out + low[:, None]).ravel()[:n_ids]


def write_segment(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    data, starts = pack(ids)
    head = np.array([len(ids), len(starts) - 1, len(lengths)], "<u4").tobytes()
    nulls = np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
    return MAGIC + head + doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + nulls + lengths.astype("<u4").tobytes() + starts.astype("<u4").tobytes() + data


def _head(segment: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, int, int]:
    """The doc_ids, their numbers of ids, where the blocks begin, where they do in the segment, and the number of ids."""
    if segment[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_ids, n_blocks, n_docs = (int(x) for x in np.frombuffer(segment, "<u4", 3, 4))
    at = 16
    doc_ids = np.frombuffer(segment, "<i8", n_docs, at)
    nulls = np.unpackbits(np.frombuffer(segment, np.uint8, -(-n_docs // 8), at := at + 8 * n_docs), count=n_docs).astype(bool)
    lengths = np.frombuffer(segment, "<u4", n_docs, at := at + -(-n_docs // 8))
    starts = np.frombuffer(segment, "<u4", n_blocks + 1, at := at + 4 * n_docs)
    return pa.array(doc_ids, pa.int64(), mask=nulls), lengths, starts, at + 4 * (n_blocks + 1), n_ids


def read_segment(segment: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The doc_ids, their numbers of ids, and all ids."""
    doc_ids, lengths, starts, at, n_ids = _head(segment)
    return doc_ids, lengths, unpack(segment[at:], starts, n_ids)


def read_range(segment: bytes, low: int, high: int) -> np.ndarray:
    """The ids at the places ``low`` .. ``high`` - 1 of a segment; only the blocks that hold them are unpacked."""
    _, _, starts, at, n_ids = _head(segment)
    low, high = max(low, 0), min(high, n_ids)
    if low >= high:
        return np.empty(0, np.uint32)
    first, last = low // BLOCK, -(-high // BLOCK)
    part = unpack(segment[at + int(starts[first]) : at + int(starts[last])], starts[first : last + 1] - starts[first], (last - first) * BLOCK)
    return part[low - first * BLOCK : high - first * BLOCK]


#: Bytes that can follow a piece's first space or line feed: visible ASCII, and lead bytes that begin no white space.
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[[*range(0x21, 0x7F), *(b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3))]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[ord(c) for c in "!.,:;?()"]] = True
_CODES = mix(np.arange(256).astype(np.uint64) + np.uint64(0x7F4A))


class Encoder:
    """A byte-level BPE of the tokenizers library, which encodes each distinct piece of text once.

    Such a tokenizer cuts texts before a single white space that a visible character follows, and between a letter and a
    mark, whatever stands around. The pieces between such cuts are told apart by 64-bit hashes, and all new ones of a
    batch go to the library together. That holds for the byte-level pre-tokenizer without a normaliser; with a tokenizer of
    another kind whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        told = json.loads(tokenizer.to_str())
        cuts = told["pre_tokenizer"] or {}
        plain = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
        added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in told["added_tokens"])
        self.cuts = bool(plain and added and told["normalizer"] is None and not told["truncation"] and not told["padding"])
        # white space before an added token belongs to what stands before it
        self.follows = _FOLLOWS.copy()
        self.follows[[x.content.encode()[0] for x in tokenizer.get_added_tokens_decoder().values()]] = False
        self.clear()

    def clear(self) -> None:
        self.keys, self.places, self.lengths, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encoded(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and each piece's number of them. Words behind a space go to the library as lines of many."""
        lines = [words[i : i + LINE_PIECES] for i in range(0, len(words), LINE_PIECES)]
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for line, found in zip(lines, self.tokenizer.encode_batch(["".join(line) for line in lines], add_special_tokens=False), strict=True):
            counts = np.bincount(found.word_ids)
            if len(counts) == len(line):
                ids.append(np.array(found.ids, np.uint32))
                lengths.append(counts)
            else:  # the library sees a letter otherwise
                own = [x.ids for x in self.tokenizer.encode_batch_fast(line, add_special_tokens=False)]
                ids.append(np.array(sum(own, []), np.uint32))
                lengths.append(np.array([len(x) for x in own]))
        own = [x.ids for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
        ids.append(np.fromiter(chain.from_iterable(own), np.uint32, lengths[-1].sum()))
        return np.concatenate(ids), np.concatenate(lengths)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of them."""
        if not self.cuts:
            raw = data.tobytes()
            own = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)]
            counts = np.fromiter(map(len, own), np.int64, len(own))
            return np.fromiter(chain.from_iterable(own), np.uint32, counts.sum()), counts
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data) > 1:
            follows = self.follows[data[1:]]
            follows[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
            cut[:-2] |= follows & (data[:-1] == 0x20)
            line = follows & (data[:-1] == 0x0A)
            cut[:-2] |= line
            cut[1:-1] |= line
            cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        hashes = run_hashes(data, starts, ends, _CODES)
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.append(self.keys, np.uint64(0))[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            if len(self.keys) > CACHE_PIECES:
                self.clear()
                known[:] = False
            fresh = np.flatnonzero(~known)
            raw, own = data.tobytes(), first[fresh]
            pieces = [raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            plain = np.array([p[:1] == " " and p[1:].isalpha() for p in pieces])
            told, lengths = self.encoded([p for p, own in zip(pieces, plain, strict=True) if own], [p for p, own in zip(pieces, plain, strict=True) if not own])
            # back into the order of the keys
            order = np.argsort(np.append(np.flatnonzero(plain), np.flatnonzero(~plain)))
            into = np.searchsorted(self.keys, distinct[fresh])
            self.keys = np.insert(self.keys, into, distinct[fresh])
            self.places = np.insert(self.places, into, (len(self.ids) + np.cumsum(lengths) - lengths)[order])
            self.lengths = np.insert(self.lengths, into, lengths[order])
            self.ids = np.append(self.ids, told)
            place = np.searchsorted(self.keys, distinct)
        piece = place[at]
        lengths = self.lengths[piece]
        before = np.append(0, np.cumsum(lengths))
        ids = self.ids[np.repeat(self.places[piece] - before[:-1], lengths) + np.arange(before[-1])]
        counts = np.diff(before[np.searchsorted(starts, offsets)])
        return ids, counts


@cache
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which later tasks of the worker use again with what it has kept."""
    return Encoder(path)


KEPT.append(encoder_of.cache_clear)


def _encode(path: Callable[[], str] | str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        from pyspark import TaskContext

        own = path() if callable(path) else path
        encoder = encoder_of(own)
        shard, number, kept, n_kept = TaskContext.get().partitionId(), 0, [], 0

        def segment():
            doc_ids, *columns = zip(*kept, strict=True)
            columns = [pa.concat_arrays(doc_ids), *map(np.concatenate, columns)]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(columns[2])]), pa.array([write_segment(*columns)], pa.binary())], names=["shard", "number", "n_ids", "segment"])

        for part in text_slices(batches, SLICE_BYTES):
            ids, counts = encoder(*text_bytes(part.column("text")))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            # a copy, as a slice would keep its whole batch
            kept.append((pa.array(part.column("doc_id").to_pylist(), pa.int64()), counts + 1, ids))
            n_kept += len(ids)
            if n_kept >= SEGMENT_IDS:
                yield segment()
                number, kept, n_kept = number + 1, [], 0
        if kept:
            yield segment()
            kept.clear()
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: Callable[[], str] | str, end_id: int = END_ID, order: list[str] | None = None) -> DataFrame:
    """Writes the ids of all texts of ``docs`` (doc_id, text) below ``path`` and returns the written table of segments.

    Documents come in ascending order of the columns ``order``, or of doc_id, nulls first.

    ``tokenizer`` is the tokenizer's file, or a function that finds it on an executor. Null texts are empty and have the
    end id alone. Rows of equal places come in the order of their texts' hashes; rows with a null doc_id are kept. Other
    columns are not read. An empty table writes no segment.
    """
    order = order or ["doc_id"]
    keys = {f"_{i}": F.col(c) for i, c in enumerate(order)} | {"_tie": F.xxhash64("text")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[c.alias(k) for k, c in keys.items()])
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    segments = ordered.mapInArrow(_encode(tokenizer, end_id), "shard int, number int, n_ids long, segment binary")
    segments.write.parquet(path)
    return docs.sparkSession.read.schema(segments.schema).parquet(path)


def offsets(segments: DataFrame) -> DataFrame:
    """shard, number, start: the ids before each segment. Shards are summed first; there are as many as write tasks."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("number")
    own = segments.select("shard", "number", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inside"))
    return own.join(before, "shard").select("shard", "number", (F.col("before") + F.col("inside")).alias("start"))


def read_tokens(segments: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (with ``digest``, their ids_crc32 instead) of every document in the segments."""
    rows = segments.join(offsets(segments), ["shard", "number"])

    def run(batches):
        for batch in batches:
            for start, segment in zip(batch.column("start").to_pylist(), batch.column("segment"), strict=True):
                doc_ids, lengths, ids = read_segment(segment.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    own = pa.array([zlib.crc32(raw[4 * (e - int(n)) : 4 * e]) for e, n in zip(ends, lengths, strict=True)], pa.int64())
                else:
                    own = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), own], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return rows.select("start", "segment").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")


def read_places(segments: DataFrame, low: int, high: int) -> DataFrame:
    """start and ids: the pieces of the whole file's ids at the places ``low`` .. ``high`` - 1, as a loader of training batches reads them.

    Only segments and blocks that hold such places are unpacked. An empty range gives no rows.
    """
    rows = segments.join(offsets(segments), ["shard", "number"]).where((F.col("start") < high) & (F.col("start") + F.col("n_ids") > low) & F.lit(low < high))

    def run(batches):
        for batch in batches:
            for start, segment in zip(batch.column("start").to_pylist(), batch.column("segment"), strict=True):
                ids = read_range(segment.as_py(), low - start, high - start)
                yield pa.RecordBatch.from_arrays([pa.array([max(start, low)]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return rows.select("start", "segment").mapInArrow(run, "start long, ids array<int>")
