"""Operator 11, best-fit packing: best fit, then a local search of exchanges and moves between underfull sequences.

Every document becomes its ids and an end id; only longer ones than a sequence are cut, into pieces. Pieces are dealt to groups
of about ``GROUP_ITEMS`` by a hash of their place in a written table, so that equal rows spread as others do. A task packs
a group: pieces in descending length go to the sequence that they fit best. Then underfull sequences, fullest first, take from
those that are less full: one piece for none (a move), one for one, one for two, or two for one, whatever brings most. The
receiver was the fuller one, so each exchange raises the sum of squared fills, until sequences are full or empty. Pieces of
sequences that still have room are dealt anew, to as many groups fewer as they are fewer, for a few rounds.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import written
from docloom.llm.wordhash import SPACE, give_back, mix, run_hashes, text_bytes, text_slices

SIZE, END_ID = 2048, 0
#: Pieces that a task packs together, on average.
GROUP_ITEMS = 8192
#: How often what is left is dealt anew, and the share of a sequence (one in so many) that may stay free before.
ROUNDS, SLACK = 3, 128
#: The emptiest sequences, of which two pieces are taken together.
DRAINED = 32
#: Text bytes that are encoded at once, and distinct words whose ids a worker keeps.
SLICE_BYTES, CACHE_WORDS = 1 << 19, 500_000
#: Words that the library gets in one string.
LINE_WORDS = 500
_CODES = mix(np.arange(256).astype(np.uint64) + np.uint64(0x3D91))
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[ord(c) for c in "!.,:;?()"]] = True


class WordEncoder:
    """A tokenizer that white space always cuts, which encodes each distinct word once.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, cut between a letter and a mark as well, and are told apart by 64-bit
    hashes. That holds where white space is only folded by the normaliser and dropped by the pre-tokenizer, and letters stand
    apart; with a tokenizer of another kind whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        folds = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        dropped = [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and splits[0]["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+")
        added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or " " in x["content"]) for x in told["added_tokens"])
        self.cuts = bool(folds == ["NFC", "Replace", "Lowercase"] and dropped and not splits[1]["add_prefix_space"] and added and not told["truncation"] and not told["padding"])
        self.clear()

    def clear(self) -> None:
        self.keys, self.places, self.lengths, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.uint32, lengths.sum()), lengths

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, of which a line of many becomes as many pre-tokens."""
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        for line, found in zip(lines, self.tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False), strict=True):
            counts = np.bincount(found.word_ids)
            own = (np.array(found.ids, np.uint32), counts) if len(counts) == len(line) else self._encoded(line)  # the library sees a letter otherwise
            ids.append(own[0])
            lengths.append(own[1])
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        keys = np.append(keys[plain], keys[~plain])
        parts = self._lines([w for w, p in zip(words, plain, strict=True) if p]), self._encoded([w for w, p in zip(words, plain, strict=True) if not p])
        ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        places = np.cumsum(lengths) - lengths
        keys, lengths, places = keys[order], lengths[order], places[order]
        into = np.searchsorted(self.keys, keys)
        self.keys, self.lengths = np.insert(self.keys, into, keys), np.insert(self.lengths, into, lengths)
        self.places = np.insert(self.places, into, len(self.ids) + places)
        self.ids = np.append(self.ids, ids)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of them."""
        raw = data.tobytes()
        if not self.cuts:
            return self._encoded([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~SPACE[data]
        text = np.zeros(len(data) + 1, bool)
        text[offsets] = True
        text[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        starts = np.flatnonzero(word[1:-1] & (text[:-1] | ~word[:-2]))
        ends = np.flatnonzero(word[1:-1] & (text[1:] | ~word[2:])) + 1
        hashes, first, which = np.unique(run_hashes(data, starts, ends, _CODES), return_index=True, return_inverse=True)
        known = np.isin(hashes, self.keys, assume_unique=True)
        if not known.all():
            if len(self.keys) > CACHE_WORDS:
                self.clear()
                known[:] = False
            fresh = first[~known]
            self._learn(hashes[~known], [raw[a:b].decode() for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
        own = np.searchsorted(self.keys, hashes)[which]
        lengths = self.lengths[own]
        before = np.append(0, np.cumsum(lengths))
        ids = self.ids[np.repeat(self.places[own] - before[:-1], lengths) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


@cache
def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder, with the words that it has kept."""
    return WordEncoder(path)


def _cut(tokenizer: Callable[[], str] | str, end_id: int, size: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = encoder_of(tokenizer() if callable(tokenizer) else tokenizer)
        for part in text_slices(batches, SLICE_BYTES):
            ids, counts = encoder(*text_bytes(part.column("text")))
            ids, counts = np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
            n_pieces = -(-counts // size)
            doc = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            length = np.minimum(size, counts[doc] - size * piece)
            ends = np.cumsum(length)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(size * piece), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return run


def cut_documents(docs: DataFrame, tokenizer: Callable[[], str] | str, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (with ``with_ids`` also ids) of the pieces of every document of ``docs``.

    ``docs`` has doc_id, text; other columns are not read. ``tokenizer`` is its file, or a function that finds it on an
    executor. A null or empty text is its end id alone. Null ids and repeated rows are documents like others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, size, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences of item numbers: items in descending length, each to the sequence that it leaves the least room in."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # the rooms that some sequence has, ascending
    by_room: dict[int, list[int]] = defaultdict(list)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(rooms, lengths[item])
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, own = size, len(bins)
            bins.append([])
        bins[own].append(item)
        room -= lengths[item]
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(own)
    return bins


class Search:
    """The local search over the underfull sequences of a group."""

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.lengths, self.bins, self.size = lengths, bins, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        #: of the sequences that can give: items by length, as (sequence, item), and how many there are
        self.pool: dict[int, set[tuple[int, int]]] = defaultdict(set)
        self.count = np.zeros(size + 1, np.int64)

    def _put(self, own: int, items: list[int], sign: int) -> None:
        for item in items:
            n = self.lengths[item]
            (self.pool[n].add if sign > 0 else self.pool[n].discard)((own, item))
            self.count[n] += sign

    def _by_length(self, own: int) -> dict[int, int]:
        return {self.lengths[i]: i for i in self.bins[own]}

    @staticmethod
    def _sums(own: dict[int, int], items: list[int], lengths: list[int]) -> dict[int, list[int]]:
        """Sums of two items of a sequence, with the items."""
        values = sorted(own)
        found = {values[i] + values[j]: [own[values[i]], own[values[j]]] for i in range(len(values)) for j in range(i)}
        for i in items:  # two of the same length
            if own[lengths[i]] != i:
                found.setdefault(2 * lengths[i], [i, own[lengths[i]]])
        return found

    def _exchange(self, own: int, drained: list[int]) -> bool:
        """The exchange that brings the sequence most; False if there is none."""
        room, mine = self.size - self.fill[own], self._by_length(own)
        pairs = self._sums(mine, self.bins[own], self.lengths)
        gives = {0: []} | {n: [i] for n, i in mine.items()}
        gives = {n: i for n, i in pairs.items()} | gives
        best = (0, 0, None, None, None)
        given = np.array(list(gives))
        there = np.flatnonzero(self.count)
        if len(there):
            taken = there[np.maximum(np.searchsorted(there, given + room, side="right") - 1, 0)]
            gain = np.where(taken <= given + room, taken - given, 0)
            at = int(gain.argmax())
            if gain[at] > 0:
                other, item = min(self.pool[int(taken[at])], key=lambda x: (self.fill[x[0]], x))
                best = (int(gain[at]), -self.fill[other], other, gives[int(given[at])], [item])
        if best[0] < room:
            singles = np.array([0, *mine])
            for other in drained:
                if other == own or not self.bins[other]:
                    continue
                sums = self._sums(self._by_length(other), self.bins[other], self.lengths)
                if sums:
                    there = np.array(sorted(sums))
                    taken = there[np.maximum(np.searchsorted(there, singles + room, side="right") - 1, 0)]
                    gain = np.where(taken <= singles + room, taken - singles, 0)
                    at = int(gain.argmax())
                    if (int(gain[at]), -self.fill[other]) > best[:2] and gain[at] > 0:
                        best = (int(gain[at]), -self.fill[other], other, gives[int(singles[at])], sums[int(taken[at])])
        gain, _, other, out, into = best
        if other is None or self.fill[own] - self.fill[other] + gain <= 0:
            return False
        self._put(other, into, -1)
        self._put(other, out, 1)
        self.bins[own] = [i for i in self.bins[own] if i not in out] + into
        self.bins[other] = [i for i in self.bins[other] if i not in into] + out
        self.fill[own] += gain
        self.fill[other] -= gain
        return True

    def sweep(self) -> bool:
        """Every underfull sequence, fullest first, takes from those that come after it. False if nothing has changed."""
        order = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.size), key=lambda b: (-self.fill[b], b))
        self.pool.clear()
        self.count[:] = 0
        for own in order:
            self._put(own, self.bins[own], 1)
        changed, last = False, len(order)
        for at, own in enumerate(order):
            while last > at + 1 and not self.bins[order[last - 1]]:
                last -= 1
            self._put(own, self.bins[own], -1)
            while 0 < self.fill[own] < self.size and self._exchange(own, order[max(at + 1, last - DRAINED) : last]):
                changed = True
        return changed


def pack_group(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Sequences of item numbers, by best fit and local search; none is empty."""
    search = Search(lengths, best_fit(lengths, size), size)
    while search.sweep():
        pass
    return [b for b in search.bins if b]


def _pack(size: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_item").combine_chunks()
        group, lengths = table.column("_group")[0].as_py(), table.column("length").to_pylist()
        sequence, offset, room = (np.empty(len(lengths), np.int64) for _ in range(3))
        for number, own in enumerate(pack_group(lengths, size)):
            at = 0
            for item in sorted(own):
                sequence[item], offset[item] = ((group << 20) + number << 3) + turn, at
                at += lengths[item]
            room[own] = size - at
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("_room", pa.array(room))

    return run


def pack(pieces: DataFrame, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id and offset: a place for each in a sequence of at most ``size``.

    ``pieces`` has length (1 .. size) and any other columns, which stay. Places in a sequence follow one another from 0. Rows may be
    equal; ties in length go by a hash of the row's place. An empty table gives an empty table.
    """
    payload = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = written(pieces.select(*[F.col(f"`{c}`") for c in payload]), "pieces")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = rows.where(F.col("length") >= size).select("*", (F.monotonically_increasing_id() * 8).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.where(F.col("length") < size).select("*", F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("_item"))
    for turn in range(1, rounds + 1):
        n = left.count()
        if not n:
            break
        groups = -(-n // GROUP_ITEMS)
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("_item", F.lit(turn)), F.lit(groups)))
        packed = dealt.groupBy("_group").applyInArrow(_pack(size, turn), f"{kinds}, _item long, sequence_id long, offset long, _room long")
        packed = written(packed, "packed")
        again = F.lit(turn < rounds and groups > 1) & (F.col("_room") > size // SLACK)
        done = done.unionByName(packed.where(~again).select(*rows.columns, "sequence_id", "offset"))
        left = packed.where(again).select(*rows.columns, "_item")
    return done


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths: the sequences themselves, from pieces with their ids (``cut_documents(with_ids=True)``)."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_parts"))
    return parts.select(
        "sequence_id",
        F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("_parts", lambda p: F.size(p["ids"])).alias("lengths"),
    )
