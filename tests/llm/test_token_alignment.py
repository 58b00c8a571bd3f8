"""Operator 12 against a plain alignment of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from docloom.llm import catalog, token_alignment
from docloom.llm.base import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, block long, stretch string, n long, doc long"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(catalog.tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=catalog.piece_model_path())


def spans(sizes):
    at = 0
    for size in sizes:
        at += size
        yield at


def plain(texts, both):
    """Rows of ``COLUMNS`` for each text, over whole texts."""
    a, b = both
    found = []
    for text in texts:
        if not text or "\u2581" in text:
            found.append(None)
            continue
        own_a, own_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        # offsets of A are in characters and cover a whole character for each of its bytes: count the alphabet's characters instead
        ends_a = list(spans(len(a.id_to_token(i)) for i in own_a.ids))
        ends_b = list(spans(1 if b.is_byte(i) else len(b.id_to_piece(i).replace("\u2581", " ").encode()) for i in own_b))
        assert ends_a[-1] == ends_b[-1] == len((" " + text).encode())
        found.append((own_a.ids, ends_a, own_b, ends_b))
    counts = Counter()
    links = []
    for one in found:
        own = []
        if one:
            by_end = dict(zip(one[3], one[2], strict=True))
            own = [(i, by_end[e]) for i, e in zip(one[0], one[1], strict=True) if e in by_end]
        counts.update(own)
        links.append(own)
    top = defaultdict(int)
    for (_, i), n in counts.items():
        top[i] = max(top[i], n)
    for one, own in zip(found, links, strict=True):
        if not one:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        cuts = sorted(set(one[1]) & set(one[3]))
        told, low = [], 0
        for high in cuts:
            told.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= high) for ids, ends in (one[:2], one[2:])))
            low = high
        best = sum(counts[x] == top[x[1]] for x in own)
        yield (len(one[0]), len(one[2]), len(cuts), len(own), best, sum(counts[x] for x in own), hashlib.sha256(";".join(told).encode()).hexdigest())


def odd_texts():
    rng = random.Random(8)
    alphabet = ["a", "the", "Word", " ", " ", "  ", "\n", "\n", "\t", "\r\n", ".", ",", "(", "é", "e\u0301", "字", "\u3000", "\u00a0", "😀", "'s", "<0x0A>", "<|endoftext|>", "<s>", "7", "\x00", "-", "ß"]
    texts = [None, "", " ", "\n", "\n\n", " a", "a ", "a\u2581b", "word.\nWord  two", "x" * 3000, ("long text, " * 400).strip(), "same text", "same text"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(300)]


def test_stretches_are_encoded_as_whole_texts_are(both):
    tokenizers = token_alignment.tokenizers_of((catalog.tokenizer_path, catalog.piece_model_path))
    texts = [t for t in odd_texts() if tokenizers.takes(t)]
    assert len(texts) > 250
    data, starts, ends, counts = token_alignment.stretches(pa.array(texts))
    raw = data.tobytes()
    own = list(tokenizers.tokens([raw[a:b].decode() for a, b in zip(starts, ends, strict=True)]))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert sum((x[0] for x in own[at : at + n]), []) == both[0].encode(" " + text, add_special_tokens=False).ids, text
        assert sum((x[1] for x in own[at : at + n]), []) == both[1].encode(text), text
        at += n


def test_odd_documents(spark, both, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 3000)
    texts = odd_texts()
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in zip(ids, texts, strict=True)], DOCS)
    found = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in token_alignment.align_documents(docs, (catalog.tokenizer_path, catalog.piece_model_path)).collect())
    assert found == Counter((i, *row) for i, row in zip(ids, plain(texts, both), strict=True))
    assert token_alignment.align_documents(docs.limit(0), (catalog.tokenizer_path, catalog.piece_model_path)).count() == 0


def test_all_documents_of_the_table(spark, both):
    docs = table(spark, SF, "documents").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in catalog.QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert found == {d["doc_id"]: row for d, row in zip(docs, plain([d["text"] for d in docs], both), strict=True)}


def test_groups_of_whole_texts_by_the_same_joins(spark):
    """The relational part alone, over a text that is one stretch, and the groups as they are told."""
    tokens = spark.createDataFrame([(5, 1, 3, [1], [10, 11, 12, 13], [20, 21, 22]), (6, 2, 1, [1], [10], [23])], token_alignment._TOKENS)
    sizes = [spark.createDataFrame(rows, "id int, size int") for rows in ([(10, 2), (11, 1), (12, 3), (13, 1)], [(20, 3), (21, 1), (22, 3), (23, 2)])]
    aligned = token_alignment.align(tokens, sizes)
    assert sorted((r["doc"], r["grp"], r["a"], r["b"], tuple(r["cut"])) for r in aligned.collect()) == [(5, 0, [10, 11], [20], (11, 20)), (5, 1, [12, 13], [21, 22], (13, 22)), (6, 0, [10], [23], (10, 23))]
    assert {tuple(r)[:5] for r in token_alignment.told_groups(aligned).collect()} == {(5, 4, 3, 2, "10,11|20;12,13|21,22"), (6, 1, 1, 1, "10|23")}
    links = spark.createDataFrame([(1, 9, 4), (2, 9, 3), (2, 9, 1), (3, 8, 1)], "a int, b int, n long")
    assert sorted(map(tuple, token_alignment.link_counts(links).collect())) == [(1, 9, 4, 1), (2, 9, 4, 1), (3, 8, 1, 1)]
