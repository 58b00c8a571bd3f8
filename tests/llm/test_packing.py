"""Operator 11 against the tokenizer's library, the least number of sequences, and odd rows."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import catalog, packing
from docloom.llm.base import table
from docloom.llm.wordhash import text_bytes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, length long, piece int, sequence_id long, _item long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.word_tokenizer_path())


def check_places(rows, size):
    """Sequences without gaps or overlaps, none over its size; their number."""
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in found.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(found)


def test_words_are_encoded_as_whole_texts_are(tokenizer):
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "e\u0301", "Σ", "ς", "'s", "'", "7", "字", " ", "\t", "\n", "\u00a0", "\u3000", "\u0345", ".", "<|endoftext|>", "<|ENDOFTEXT|>", "ﬁ", "\x00", "\x1c", "😀"]
    texts = ["", " ", "x" * 5000, "Word  word\r\nWORD"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    encoder = packing.WordEncoder(catalog.word_tokenizer_path())
    assert encoder.cuts
    for own in (texts, texts[::-1]):  # the second time from what is kept
        ids, counts = encoder(*text_bytes(pa.array(own)))
        expected = [x.ids for x in tokenizer.encode_batch(own, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, expected))
        assert ids.tolist() == sum(expected, [])
    encoder.cuts = False
    assert encoder(*text_bytes(pa.array(texts)))[0].tolist() == sum((x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)), [])


def least(lengths, size):
    """The least number of sequences, by trying every place of every item."""
    lengths = sorted(lengths, reverse=True)

    def fits(rooms, i):
        if i == len(lengths):
            return True
        for at in sorted({r: at for at, r in enumerate(rooms) if r >= lengths[i]}.values()):
            if fits([r - lengths[i] * (n == at) for n, r in enumerate(rooms)], i + 1):
                return True
        return False

    return next(n for n in count(-(-sum(lengths) // size)) if fits([size] * n, 0))


def test_few_items_take_hardly_more_than_the_least(spark):
    rng, more = random.Random(3), 0
    for _ in range(150):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
        bins = packing.pack_group(lengths, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 40 for b in bins)
        more += len(bins) - least(lengths, 40)
    assert more <= 3
    assert packing.pack_group([], 40) == []


@pytest.mark.parametrize(("low", "high"), [(1, 2047), (200, 900), (600, 1100)])
def test_local_search_beats_best_fit(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 1500).tolist()
    first, bins = packing.best_fit(lengths, 2048), packing.pack_group(lengths)
    squares = [sum(sum(lengths[i] for i in b) ** 2 for b in x) for x in (first, bins)]
    assert len(bins) <= len(first) and squares[1] > squares[0]
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


@pytest.mark.parametrize(("taker", "giver", "after"), [([55, 40], [31, 29], [29, 31, 40]), ([30, 28, 20], [70], [30, 70]), ([90], [10, 70], [10, 90])])
def test_pairs_and_moves_fill_a_sequence(taker, giver, after):
    lengths = taker + giver
    search = packing.Search(lengths, [list(range(len(taker))), list(range(len(taker), len(lengths)))], 100)
    search.sweep()
    assert search.fill[0] == 100 and sorted(lengths[i] for i in search.bins[0]) == after


def test_groups_and_rounds_leave_no_more_than_one_task_does(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 200)
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 2048), rng.randint(1, 300)]) for _ in range(3000)] + [2048] * 5
    rows = packing.pack(spark.createDataFrame([(n, "x") for n in lengths], "length long, _group string").drop("_group")).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_places(rows, 2048) <= -(-sum(lengths) // 2048) * 1.01 + 1


def test_all_documents_of_the_table(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = catalog.QUERIES["op11_best_fit_packing"](spark, SF).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        found[r["doc_id"]].append(r)
    assert set(found) == set(docs)
    total = 0
    for doc_id, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for i, r in enumerate(found[doc_id]):
            own = ids[2048 * i : 2048 * i + 2048]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (i, 2048 * i, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert 2048 * len(found[doc_id]) >= len(ids)
    assert check_places(rows, 2048) <= -(-total // 2048) + 1


def test_odd_documents_and_the_sequences_themselves(spark, tokenizer):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "word " * 5000), (3, " \n"), (4, "Same text."), (4, "Same text."), (5, "z" * 100_000)]
    docs = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], DOCS)
    placed = packing.pack(packing.cut_documents(docs, catalog.word_tokenizer_path, with_ids=True)).cache()
    found = placed.collect()
    check_places(found, 2048)
    told = defaultdict(list)
    for r in sorted(found, key=lambda r: r["piece"]):
        told[r["doc_id"]] += r["ids"]
    for doc_id in {r[0] for r in rows}:
        own = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if i == doc_id]
        assert sorted(told[doc_id]) == sorted(sum(own, []))
    for r in packing.sequences(placed).collect():
        assert len(r["ids"]) == sum(r["lengths"]) and len(r["doc_ids"]) == len(r["lengths"])
    assert packing.sequences(placed).select(F.sum(F.size("ids"))).first()[0] == sum(r["length"] for r in found)
    assert packing.pack(packing.cut_documents(docs.limit(0), catalog.word_tokenizer_path)).count() == 0
