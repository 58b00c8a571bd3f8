"""Operator 5, LM scoring: a weighted backoff automaton over word trigrams.

States are the contexts: the root, the start of a text, every word and every pair of words that the training texts hold.
A state has an arc for each word seen behind it, weighted with its smoothed log-probability, and a failure arc to the state
of its last word, or to the root, weighted with what smoothing leaves for all other words. One pass from left to right
carries each text's state and adds up the weights.

    arc(s, w)  = (c(s, w) + prior * p(w | shorter s)) / (c(s) + prior)        failure(s) = prior / (c(s) + prior)
    p(w)       = (c(w) + 0.5) / (N + 0.5 * (V + 1)) at the root

The corpus is cut into blocks of whole texts. A block asks for the counts of its distinct words, bigrams and trigrams
(``keycounts``) and builds just the part of the automaton that its own texts can reach; the model as a whole is nowhere in
one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.keycounts import ASK_DDL, Layout, no_stats, totals
from docloom.llm.wordhash import give_back, mix, word_hashes

#: Text bytes of a block, and of what stands behind one bucket of keys.
BLOCK_BYTES = 8 << 20
#: The weight of the shorter context's distribution, in observations: behind one word, and behind two.
PRIORS = (100.0, 4.0)
START, END = mix(np.array([1, 2], np.uint64))
#: Bits of the hashes by which words are told apart, and sequences of them. Words decide what is known and how many there
#: are; of sequences so many share 50 bits with another as they are to 2**50, one in 10**5 at 10**10 of them.
WORD_BITS, SEQUENCE_BITS = 62, 50
#: Blocks of which one bucket counts the words; they are few beside the sequences.
WORD_BLOCKS = 8


def _keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


class _Block:
    """A block's tokens (each text's words, then one end) and its distinct words, bigrams and trigrams."""

    def __init__(self, table: pa.Table):
        give_back()
        words, counts = word_hashes(table.column("text"))
        self.lengths = counts + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        tokens = np.full(self.lengths.sum(), END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[self.starts + counts] = False
        tokens[inside] = words
        self.words, self.word = np.unique(_keys(tokens, WORD_BITS), return_inverse=True)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = START
        pairs = mix(before * np.uint64(3) + mix(tokens))
        self.pairs, at, self.pair = np.unique(_keys(pairs, SEQUENCE_BITS), return_index=True, return_inverse=True)
        # a pair's context is the word before, or the start of a text, which stands behind all words
        context = np.empty(len(tokens), np.int64)
        context[1:] = self.word[:-1]
        context[self.starts] = len(self.words)
        self.pair_context, self.pair_word = context[at], self.word[at]
        # a trigram's context is the pair before; the first word of a text has none
        self.long = np.ones(len(tokens), bool)
        self.long[self.starts] = False
        triples = mix(pairs[:-1] * np.uint64(5) + mix(tokens[1:]))[self.long[1:]]
        self.triples, at, triple = np.unique(_keys(triples, SEQUENCE_BITS), return_index=True, return_inverse=True)
        self.triple = np.full(len(tokens), -1, np.int64)
        self.triple[self.long] = triple
        places = np.flatnonzero(self.long)[at]
        self.triple_context, self.triple_pair = self.pair[places - 1], self.pair[places]
        # a key that a pair and a trigram share is one, and counts as often as both
        self.sequences, at = np.unique(np.concatenate([self.pairs, self.triples]), return_inverse=True)
        self.of_pair, self.of_triple = at[: len(self.pairs)], at[len(self.pairs) :]

    def sequence_counts(self, held_out: np.ndarray) -> np.ndarray:
        """How often each pair and trigram stands in them."""
        learn = np.repeat(~held_out, self.lengths)
        n = len(self.sequences)
        return np.bincount(self.of_pair[self.pair[learn]], minlength=n) + np.bincount(self.of_triple[self.triple[learn & self.long]], minlength=n)


def _ask_words(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        words, counts = word_hashes(table.column("text"))
        held_out = np.array(table.column("held_out").to_pylist(), bool)
        keys, at = np.unique(_keys(np.append(words, END), WORD_BITS), return_inverse=True)
        own = np.bincount(at[:-1][np.repeat(~held_out, counts)], minlength=len(keys))
        own[at[-1]] += (~held_out).sum()
        return layout.asked(keys, own, table.column("block")[0].as_py())

    return run


def _ask_sequences(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        return layout.asked(block.sequences, block.sequence_counts(np.array(table.column("held_out").to_pylist(), bool)), table.column("block")[0].as_py())

    return run


def _training(keys: np.ndarray, counts: np.ndarray) -> list[int]:
    """Of one bucket of words, the tokens and the distinct words of the training texts."""
    return [int(counts.sum()), int((counts > 0).sum())]


class Automaton:
    """The part of the automaton that a block's texts reach. -1 stands for a state that is not there."""

    def __init__(self, block: _Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, priors: tuple[float, float]):
        root = (words + 0.5) / (n + 0.5 * (v + 1))
        ends = words[block.words == _keys(np.array([END]), WORD_BITS)[0]]
        contexts = np.append(words, ends[0] if len(ends) else 0)
        behind_one = (pairs + priors[0] * root[block.pair_word]) / (contexts[block.pair_context] + priors[0])
        behind_two = (triples + priors[1] * behind_one[block.triple_pair]) / (pairs[block.triple_context] + priors[1])
        self.root, self.pair_arc, self.triple_arc = np.log10(root), np.log10(behind_one), np.log10(behind_two)
        self.has_pair_arc, self.has_triple_arc = pairs > 0, np.append(triples > 0, False)  # the last: no trigram
        self.word_failure, self.pair_failure = np.log10(priors[0] / (contexts + priors[0])), np.log10(priors[1] / (pairs + priors[1]))
        self.is_word, self.is_pair = contexts > 0, pairs > 0

    def traverse(self, block: _Block) -> np.ndarray:
        """Each text's log10 probability. All texts take a step at a time, the longest first, so that those left are a prefix."""
        order = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[order], block.lengths[order]
        left = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
        total = np.zeros(len(order))
        # a state is a pair, or else a word, or else the root
        by_pair = np.full(len(order), -1)
        by_word = np.full(len(order), len(self.is_word) - 1 if self.is_word[-1] else -1)  # the start of a text
        for step, k in enumerate(left):
            at = starts[:k] + step
            word, pair, triple = block.word[at], block.pair[at], block.triple[at]
            p, w = by_pair[:k], by_word[:k]
            by_arc = (p >= 0) & self.has_triple_arc[triple]
            weight = np.where(p >= 0, self.pair_failure[p], 0.0)  # the pair fails over to its last word,
            next_arc = (w >= 0) & self.has_pair_arc[pair]
            weight += np.where(next_arc, self.pair_arc[pair], np.where(w >= 0, self.word_failure[w], 0.0) + self.root[word])  # and that to the root
            total[:k] += np.where(by_arc, self.triple_arc[triple] if len(self.triple_arc) else 0.0, weight)
            by_pair[:k] = np.where(self.is_pair[pair], pair, -1)
            by_word[:k] = np.where(self.is_word[word], word, -1)
        out = np.empty(len(order))
        out[order] = total
        return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(words: Layout, sequences: Layout, priors: tuple[float, float]):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        block = _Block(docs)
        told_words, (n, v) = words.answered(answers.filter(pc.equal(answers.column("kind"), 0)))
        told, _ = sequences.answered(answers.filter(pc.equal(answers.column("kind"), 1)))
        automaton = Automaton(block, told_words, told[block.of_pair], told[block.of_triple], int(n), int(v), priors)
        text = np.repeat(np.arange(len(docs)), block.lengths)
        base = np.bincount(text, weights=automaton.root[block.word], minlength=len(docs))
        known = np.bincount(text, weights=(told_words > 0)[block.word], minlength=len(docs)).astype(np.int64)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": block.lengths, "n_known": known, "train_tokens": np.full(len(docs), n), "base_score": base, "score": automaton.traverse(block)})

    return run


def score_texts(docs: DataFrame, held_out: Column, priors: tuple[float, float] = PRIORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Learns from the rows that ``held_out`` is not true for and scores all. Null texts are empty: they have one token, the
    end. Repeated rows and rows with a null doc_id count like others. Without any row to learn from, every word is unknown
    and the score is the base. Other columns are not read; an empty table gives an empty table. Words are told apart by
    62 bits of a hash, sequences by 50. A block must fit one task, so a text of any length must.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    words, sequences = Layout(n_blocks, -(-n_blocks // WORD_BLOCKS), WORD_BITS), Layout(n_blocks, n_blocks, SEQUENCE_BITS)
    # asked and scored from one exchange; the row's number deals out repeated rows as well
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_blocks)))
    told = totals(blocks.groupBy("block").applyInArrow(_ask_words(words), ASK_DDL), words, _training).withColumn("kind", F.lit(0))
    more = totals(blocks.groupBy("block").applyInArrow(_ask_sequences(sequences), ASK_DDL), sequences, no_stats).withColumn("kind", F.lit(1))
    answers = told.unionByName(more)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(words, sequences, priors), _SCORES)
