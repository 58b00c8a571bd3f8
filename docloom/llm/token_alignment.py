"""Operator 12, cross-tokenizer alignment: relational over tokens, once for each distinct stretch of text.

``align`` is the relational part: tokens are exploded with their places, windowed cumulative lengths give their ends, equi-joins
on document and end find where both tokenizers cut, running counts of such cuts number the groups, and groups are joined.

Texts share most of their words, so that work is done once for each distinct stretch: both tokenizers keep apart what stands
before and behind a stretch (``stretches``), so a text's tokens, groups and links are those of its stretches one after another. Texts
are packed in blocks, which ask for their distinct stretches; how often each occurs weighs its links in the corpus-wide counts; and
blocks are told about their stretches and put their documents together. A stretch keeps a list of the blocks that ask for it, which is
no longer than there are blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.base import BROADCAST_IDS, discard, written
from docloom.llm.wordhash import give_back, mix, run_hashes, text_bytes, text_slices

#: Bytes of text in one block, and that a task cuts at once.
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Stretches that go to the libraries at once.
BATCH = 4096
#: Bytes that can follow a space or line feed at which texts are cut: visible ASCII, and lead bytes that begin no white space.
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[[*range(0x21, 0x7F), *(b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3))]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[ord(c) for c in "!.,:;?()"]] = True
_CODES = mix(np.arange(256).astype(np.uint64) + np.uint64(0x9C17))

Paths = tuple[Callable[[], str] | str, Callable[[], str] | str]


class Tokenizers:
    """A byte-level tokenizer (A) and a sentence-piece model that adds a space (B), with the bytes of their tokens.

    Stretches are only safe for pieces that hold no line feed, no space behind another character and no mark behind a letter;
    with other vocabularies it is an error.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        # the byte-level alphabet: visible Latin-1 stands for itself, the others for characters from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if set(token) <= set(alphabet) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("\n|[^▁]▁|[A-Za-z][!.,:;?()]", p) for p in pieces):
            raise ValueError("pieces of this model go across the places at which texts are cut")
        self.lead = self.b.encode("\n")

    def takes(self, text: str | None) -> bool:
        """Whether the text has tokens: B's bytes are those of its normalised text."""
        return bool(text) and self.b.normalize(text).replace("▁", " ") == " " + text

    def tokens(self, stretches: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of each stretch. B gets them behind a line feed, which no piece joins with what follows."""
        own_a = self.a.encode_batch_fast(stretches, add_special_tokens=False)
        own_b = self.b.encode(["\n" + s for s in stretches], num_threads=1)
        for stretch, a, b in zip(stretches, own_a, own_b, strict=True):
            a, b = a.ids, b[len(self.lead) :]
            whole = stretch.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                raise ValueError(f"tokens do not add up to {stretch!r}")
            yield a, b


@cache
def _loaded(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def tokenizers_of(paths: Paths) -> Tokenizers:
    return _loaded(*(p() if callable(p) else p for p in paths))


def stretches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with a space before each; where stretches begin and end in them; each text's number of stretches.

    Cuts are before a lone space or around a line feed that a visible character follows, and between a letter and a mark.
    """
    data, offsets = text_bytes(texts)
    data = np.insert(data, offsets[:-1], np.uint8(0x20))
    offsets = offsets + np.arange(len(offsets))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    if len(data) > 1:
        follows = _FOLLOWS[data[1:]] & ~cut[1:-1]
        lone = follows & (data[:-1] == 0x20)
        lone[1:] &= data[:-2] != 0x20
        line = follows & (data[:-1] == 0x0A)
        cut[:-2] |= lone | line
        cut[1:-1] |= line | (_LETTER[data[:-1]] & _MARK[data[1:]])
    edges = np.flatnonzero(cut)
    return data, edges[:-1], edges[1:], np.diff(np.searchsorted(edges, offsets))


_PACKED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _pack(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Array) -> Iterator[pa.RecordBatch]:
    for own in packed:
        yield from pa.ipc.open_stream(own.as_buffer())


def _blocks(paths: Paths):
    """block and texts: slices of the documents, packed; texts that lie together, of BLOCK_BYTES, are a block. Texts without tokens go."""

    def run(batches):
        from pyspark import TaskContext

        tokenizers, size, first = tokenizers_of(paths), 0, TaskContext.get().partitionId() << 32
        for part in text_slices(batches, SLICE_BYTES):
            texts = pa.array([t if tokenizers.takes(t) else None for t in part.column("text").to_pylist()], pa.string())
            packed = _pack(pa.RecordBatch.from_arrays([part.column("doc_id"), texts], schema=_PACKED))
            yield pa.RecordBatch.from_arrays([pa.array([first + size // BLOCK_BYTES], pa.int64()), pa.array([packed], pa.binary())], names=["block", "texts"])
            size += part.nbytes
        give_back()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, stretch, n: how often each distinct stretch stands in the part of a block that follows in a task."""
    block, found = None, {}

    def told():
        return pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["block", "stretch", "n"])

    for batch in batches:
        for own, packed in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
            if own != block:
                if found:
                    yield told()
                block, found = own, {}
            for part in _unpack([packed]):
                data, starts, ends, _ = stretches(part.column("text").drop_null())
                _, first, counts = np.unique(run_hashes(data, starts, ends, _CODES), return_index=True, return_counts=True)
                raw = data.tobytes()
                for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), counts.tolist(), strict=True):
                    found[raw[a:b]] = found.get(raw[a:b], 0) + n
    if found:
        yield told()
    found.clear()
    give_back()


def _tokens(paths: Paths):
    """doc, key (the stretch's hash), n, blocks and both sides' ids."""

    def run(batches):
        from pyspark import TaskContext

        tokenizers, doc = tokenizers_of(paths), TaskContext.get().partitionId() << 33
        for batch in (whole.slice(at, BATCH) for whole in batches for at in range(0, len(whole), BATCH)):
            data, offsets = text_bytes(batch.column("stretch"))
            keys = run_hashes(data, offsets[:-1], offsets[1:], _CODES).astype(np.int64)
            a, b = zip(*tokenizers.tokens(batch.column("stretch").to_pylist()), strict=True)
            columns = [pa.array(doc + np.arange(len(batch))), pa.array(keys), batch.column("n"), batch.column("blocks")]
            doc += len(batch)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], names=["doc", "key", "n", "blocks", "a", "b"])

    return run


_TOKENS = "doc long, key long, n long, blocks array<long>, a array<int>, b array<int>"


def vocabulary_sizes(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """id and size (bytes) of every token of A and of B: as many rows as their vocabularies have, so they can be broadcast."""
    tokenizers = tokenizers_of(paths)
    return tuple(spark.createDataFrame(pa.table({"id": pa.array(range(len(told)), pa.int32()), "size": pa.array(map(len, told), pa.int32())})) for told in (tokenizers.bytes_a, tokenizers.bytes_b))


@contextmanager
def _dealt_once(spark: SparkSession) -> Iterator[None]:
    """Lets joins on document and end (or group) take rows that are dealt by document alone as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(tokens: DataFrame, sizes: tuple[DataFrame, DataFrame]) -> DataFrame:
    """doc, grp, a, b, cut: the groups of every document, with both sides' ids in order and the last ones, which end together.

    ``tokens`` has doc, a, b (ids in order); ``sizes`` has id and size of each side's tokens. Both sides are dealt by document once; the
    windows and joins after that need no exchange (run it within ``_dealt_once``).
    """

    def ends(side, own):
        rows = tokens.select("doc", side).repartition("doc").select("doc", F.posexplode(side).alias("at", "id")).join(F.broadcast(own), "id")
        before = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("doc", F.sum("size").over(before).alias("end"), F.col("id").alias(side))

    def groups(own, other, side, there):
        """The side's ids by group: a token is in the group of as many cuts as end before it does."""
        cut = F.col(there).isNotNull().cast("long")
        before = Window.partitionBy("doc").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
        rows = own.join(other, ["doc", "end"], "left").select("doc", "end", side, there, (F.sum(cut).over(before) - cut).alias("grp"))
        ids = F.transform(F.array_sort(F.collect_list(F.struct("end", side))), lambda t: t[side])
        return rows.groupBy("doc", "grp").agg(ids.alias(f"{side}s"), F.max(there).alias("last"))

    a, b = ends("a", sizes[0]), ends("b", sizes[1])
    both = groups(a, b, "a", "b").join(groups(b, a, "b", "a").drop("last"), ["doc", "grp"])
    return both.select("doc", "grp", F.col("as").alias("a"), F.col("bs").alias("b"), F.struct(F.element_at("as", -1).alias("a"), F.col("last").alias("b")).alias("cut"))


def told_groups(aligned: DataFrame) -> DataFrame:
    """doc, n_a, n_b, n_groups, groups (as ``a1,a2|b1;a3|b2,b3``) and links, the pairs of ids that end together."""
    ids = lambda side: F.array_join(F.transform(side, lambda i: i.cast("string")), ",")
    rows = F.array_sort(F.collect_list(F.struct("grp", F.concat(ids("a"), F.lit("|"), ids("b")).alias("told"), "cut")))
    whole = aligned.groupBy("doc").agg(F.sum(F.size("a")).alias("n_a"), F.sum(F.size("b")).alias("n_b"), F.count("*").alias("n_groups"), rows.alias("_rows"))
    return whole.select("doc", "n_a", "n_b", "n_groups", F.array_join(F.transform("_rows", lambda r: r["told"]), ";").alias("groups"), F.transform("_rows", lambda r: r["cut"]).alias("links"))


def link_counts(links: DataFrame) -> DataFrame:
    """a, b, count, best: how many links hold each pair of ids (``links`` has a, b, n), and whether no pair of its b has more."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("long"))


_TOLD = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _documents(with_groups: bool):
    """The documents of a block, from what it has been told about its stretches."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        keys, at = np.unique(answers.column("key").to_numpy(), return_index=True)
        parts = pc.list_flatten(pc.split_pattern(answers.column("told").combine_chunks().take(pa.array(at)), " ")).to_numpy(zero_copy_only=False).reshape(len(at), len(_TOLD) + 1)
        figures, told = parts[:, :-1].astype(np.int64), parts[:, -1].tolist()
        del answers, parts
        doc_ids, sums, texts = [], [], []
        for part in _unpack(packed.column("texts")):
            doc_ids.append(part.column("doc_id"))
            held = part.column("text").is_valid().to_numpy(zero_copy_only=False)
            data, starts, ends, counts = stretches(part.column("text").drop_null())
            own = np.searchsorted(keys, run_hashes(data, starts, ends, _CODES).astype(np.int64))
            total = np.zeros((len(held), len(_TOLD)), np.int64)
            if len(own):
                total[held] = np.add.reduceat(figures[own], np.cumsum(counts) - counts, axis=0)
            sums.append(total)
            names = [told[i] for i in own.tolist()]
            edges = iter(np.append(0, np.cumsum(counts)).tolist())
            low = next(edges)
            for there in held:
                high = next(edges) if there else low
                groups = ";".join(names[low:high])
                texts.append(groups if with_groups or not there else hashlib.sha256(groups.encode()).hexdigest())
                low = high
        sums = np.concatenate(sums)
        columns = [pa.chunked_array(doc_ids, pa.int64()), *(pa.array(sums[:, i]) for i in range(len(_TOLD))), pa.array(texts, pa.string())]
        return pa.table(columns, names=["doc_id", *_TOLD, "groups" if with_groups else "groups_sha256"])

    return run


def align_documents(docs: DataFrame, paths: Paths, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or groups) for every row of ``docs`` (doc_id, text).

    ``paths`` are the files of A and B, or functions that find them on a machine. A text that is null or empty, or whose tokens
    do not add up to the text behind a space (it holds U+2581), has zeros and an empty string, and its links count nowhere. Null
    ids and repeated rows are documents like others; other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = written(rows.mapInArrow(_blocks(paths), "block long, texts binary"), "blocks")
    asked = packed.mapInArrow(_asked, "block long, stretch string, n long")
    distinct = asked.groupBy("stretch").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    tokens = written(distinct.mapInArrow(_tokens(paths), _TOKENS), "tokens", "zstd")
    told = told_groups(align(tokens, vocabulary_sizes(spark, paths))).join(tokens.select("doc", "key", "n", "blocks").repartition("doc"), "doc")
    with _dealt_once(spark):
        told = written(told, "told", "zstd")
    discard(tokens)

    links = told.select("doc", "n", F.explode("links").alias("l")).select("doc", "n", "l.a", "l.b")
    counts = written(link_counts(links), "link-counts")
    near = F.broadcast(counts) if counts.count() <= BROADCAST_IDS else counts
    figures = links.join(near, ["a", "b"]).groupBy("doc").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    # one string for each block that asks: figures as digits take less room in the exchange than as longs
    answers = told.drop("links", "n").join(figures, "doc").select("key", "blocks", F.concat_ws(" ", *_TOLD, "groups").alias("told")).select(F.explode("blocks").alias("block"), "key", "told")
    out = f"doc_id long, {', '.join(f'{c} long' for c in _TOLD)}, {'groups' if with_groups else 'groups_sha256'} string"
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_documents(with_groups), out)
