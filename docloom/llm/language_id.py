"""Operator 4, language ID: a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read each window of a text's UTF-8 bytes, one from either end. Their states at a byte give that
byte's language probabilities; a text's probabilities are the means over all its bytes. A window is read with some bytes
before and behind it, so that every byte it labels has both its sides. What is read beside a text in one batch has no part
in its labels: the layer that comes from the end has no state before the window's last byte. The driver trains the
network by backpropagation through time on windows from all over a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.wordhash import text_bytes, text_slices

UNDETERMINED = "und"
#: Bytes that a window labels, bytes that it reads before and behind them, and windows that a task holds in one batch.
WINDOW, MARGIN, BATCH = 256, 24, 512
#: Text bytes that a task labels at once.
SLICE_BYTES = 4 << 20
#: The least score at which a filter keeps a text: below it, no language has a clear lead.
LEAST_SCORE = 0.35
#: Labelled rows of each language to learn from, and windows of all of these rows' texts, each at most.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1000, 4096
#: More labels than this are an error: the sample is their number times SAMPLE_WINDOWS.
MAX_LANGUAGES = 500
HIDDEN, STEPS, STEP_WINDOWS, STEP_BYTES, RATE = 10, 300, 128, 64, 0.02


HALF = np.float32(0.5)


def _read(x: np.ndarray, inside: np.ndarray, inputs: np.ndarray, weights: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states of one layer after each byte of ``x`` (bytes by windows), from the first to the last; zero where not ``inside``."""
    steps, n = x.shape
    full = inside.all(1)
    size = weights.shape[1]
    h = np.zeros((size, n), np.float32)
    states = np.empty((steps, size, n), np.float32)
    a = np.empty((3 * size, n), np.float32)
    for t in range(steps):
        np.take(inputs, x[t].astype(np.intp), axis=1, out=a, mode="clip")
        u = weights @ h
        gates = a[: 2 * size] + u[: 2 * size]
        gates *= HALF
        np.tanh(gates, out=gates)
        gates *= HALF
        gates += HALF
        z, r = gates[:size], gates[size:]
        new = r * u[2 * size :]
        new += a[2 * size :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((h, z, r, new, u[2 * size :]))
        h = np.subtract(h, new, out=states[t])
        h *= z
        h += new
        if not full[t]:
            h *= inside[t]
    return states


def _unread(x: np.ndarray, inside: np.ndarray, weights: np.ndarray, kept: list, by_state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of a layer's inputs and weights, through time from the last byte to the first."""
    back = np.zeros_like(by_state[0])
    by_input, by_weight = np.empty((len(x), len(weights), x.shape[1]), np.float32), np.zeros_like(weights)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, new, u = kept[t]
        by_h = (by_state[t] + back) * inside[t]
        by_new = by_h * (1 - z) * (1 - new * new)
        by_r = by_new * u * r * (1 - r)
        by_z = by_h * (h - new) * z * (1 - z)
        by_input[t] = np.concatenate([by_z, by_r, by_new])
        by_u = np.concatenate([by_z, by_r, by_new * r])
        by_weight += by_u @ h.T
        back = by_h * z + weights.T @ by_u
    table = np.zeros((256, len(weights)), np.float32)
    np.add.at(table, x.ravel(), by_input.transpose(0, 2, 1).reshape(-1, len(weights)))
    return table.T, by_weight


@dataclass
class Network:
    """The languages, and the weights: inputs and recurrence of either layer, then the labels' weights and biases."""

    languages: list[str]
    weights: list[np.ndarray]

    @classmethod
    def new(cls, languages: list[str], seed: int = 0, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(seed)
        shapes = [(3 * hidden, 256), (3 * hidden, hidden)] * 2 + [(len(languages), 2 * hidden), (len(languages), 1)]
        return cls(languages, [rng.normal(0, 0.3, s).astype(np.float32) for s in shapes[:-1]] + [np.zeros(shapes[-1], np.float32)])

    def label(self, x: np.ndarray, inside: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The language probabilities at every byte of ``x`` (bytes by windows), and the states they come from."""
        forth = _read(x, inside, *self.weights[0:2], keep and keep[0])
        back = _read(x[::-1], inside[::-1], *self.weights[2:4], keep and keep[1])[::-1]
        size = forth.shape[1]
        told = self.weights[4][:, :size] @ forth
        told += self.weights[4][:, size:] @ back
        told += self.weights[5]
        told -= told.max(1, keepdims=True)
        np.exp(told, out=told)
        told /= told.sum(1, keepdims=True)
        return told, (forth, back)

    def gradients(self, x: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss over all bytes inside, and its gradient by each weight."""
        kept: tuple[list, list] = ([], [])
        told, states = self.label(x, inside, kept)
        n = np.arange(x.shape[1])
        loss = float(-np.log(told[:, labels, n] + 1e-9)[inside].mean())
        by = told.copy()
        by[:, labels, n] -= 1
        by *= inside[:, None, :] / inside.sum()
        by_states = self.weights[4].T @ by
        size = states[0].shape[1]
        out = [*_unread(x, inside, self.weights[1], kept[0], by_states[:, :size]), *_unread(x[::-1], inside[::-1], self.weights[3], kept[1], by_states[::-1, size:])]
        by_label = np.concatenate([np.tensordot(by, s, ((0, 2), (0, 2))) for s in states], 1)
        return loss, [*out, by_label, by.sum((0, 2))[:, None]]

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> list[float]:
        """Adam over random windows of as many of each language; the losses of all steps."""
        rng = np.random.default_rng(seed)
        by_language = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        losses = []
        for step in range(1, steps + 1):
            of = np.concatenate([rng.choice(rows, -(-STEP_WINDOWS // len(by_language))) for rows in by_language])
            # some are cut short, as short texts are
            shown = np.minimum(lengths[of], np.where(rng.random(len(of)) < 0.3, rng.integers(4, windows.shape[1], len(of)), windows.shape[1]))
            inside = np.arange(windows.shape[1])[:, None] < shown
            loss, grads = self.gradients(np.ascontiguousarray(windows[of].T), inside, labels[of])
            losses.append(loss)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(self.weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return losses

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean language probabilities, and how many of its bytes were given each language."""
        data, offsets = text_bytes(texts)
        sizes = np.diff(offsets)
        n_windows = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), n_windows)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        low = offsets[:-1][text] + number * WINDOW
        high = np.minimum(low + WINDOW, offsets[1:][text])
        starts, ends = np.maximum(low - MARGIN, offsets[:-1][text]), np.minimum(high + MARGIN, offsets[1:][text])
        k = len(self.languages)
        pooled, given = np.zeros((len(sizes), k)), np.zeros((len(sizes), k), np.int64)
        order = np.argsort(starts - ends, kind="stable")
        data = np.append(data, np.zeros(WINDOW + 2 * MARGIN, np.uint8))
        batch = max(1, BATCH // max(1, k // 16))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            place = np.arange((ends - starts)[own[0]])[:, None] + starts[own]
            told, _ = self.label(np.ascontiguousarray(data[place]), place < ends[own])
            counts = (place >= low[own]) & (place < high[own])
            best = told.argmax(1)
            for language in range(k):
                pooled[:, language] += np.bincount(text[own], np.where(counts, told[:, language], 0).sum(0), len(sizes))
                given[:, language] += np.bincount(text[own], ((best == language) & counts).sum(0), len(sizes)).astype(np.int64)
        return pooled / np.maximum(sizes, 1)[:, None], given


def fit(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> Network | None:
    """A network from at most ``sample_rows`` rows of each language, or None if no row has a language and a text.

    Rows where ``learn`` is not true, without a language or without a letter in their text teach nothing. Repeated rows count
    as often as they stand there. Other columns than doc_id, text and lang are not read.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    # a share of each language by a hash of its rows, half as large again as what is kept of them
    digest = F.xxhash64("doc_id", "text")
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(1.5 * sample_rows / n))])
    taken = rows.where(F.pmod(digest, F.lit(1_000_000)) / 1_000_000 < share[F.col("lang")]).select("lang", "text", digest.alias("digest"))
    kept = Window.partitionBy("lang").orderBy("digest", "text")
    taken = taken.withColumn("rank", F.row_number().over(kept)).where(F.col("rank") <= sample_rows)
    # all windows of these rows' whole texts, of which a hash chooses
    windows = F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(STEP_BYTES)), lambda at: F.substr("text", at, F.lit(STEP_BYTES)))
    taken = taken.select("lang", "digest", F.posexplode(windows).alias("at", "window"))
    kept = Window.partitionBy("lang").orderBy(F.xxhash64("digest", "at"), "window")
    found = taken.withColumn("rank", F.row_number().over(kept)).where(F.col("rank") <= SAMPLE_WINDOWS).select("lang", "rank", "window").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in found})  # a language of a few rows may have been missed by its share
    network = Network.new(languages, seed)
    cut = [r["window"].encode()[:STEP_BYTES] for r in found]
    samples = np.stack([np.frombuffer(x.ljust(STEP_BYTES), np.uint8) for x in cut])
    network.train(samples, np.array([len(x) for x in cut]), np.array([languages.index(r["lang"]) for r in found]), seed=seed)
    return network


def _labelled(network: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[tuple[str, int]]]]:
    """Each text's language, score and bytes by language."""
    told = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, scores, given = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
    if network and told.any():
        at = np.flatnonzero(told)
        mean, n = network.texts(texts.take(pa.array(at)))
        for i, own, of in zip(at, mean, n, strict=True):
            names[i], scores[i] = network.languages[own.argmax()], min(1.0, round(own.max(), 6))
            given[i] = [(lang, int(c)) for lang, c in zip(network.languages, of, strict=True) if c]
    return names, scores, given


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score (its mean probability over all bytes), lang_bytes (bytes given each language) for every row.

    Reads doc_id and text. A null text, or one without a letter, is ``und`` with score 0 and no lang_bytes; so is every
    text without a network. Equal probabilities: the language first in order. Repeated rows are all kept; an empty table
    gives an empty table.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, SLICE_BYTES):
            names, scores, given = _labelled(network, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores), pa.array(given, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "lang_pred", "score", "lang_bytes"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, lang_bytes map<string,bigint>")


def keep_identified(docs: DataFrame, network: Network | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` (all columns; one is text) whose language is determined with a score of ``least`` or more.

    Only texts go to Python, and one truth value for each comes back.
    """

    def run(texts: pa.Array) -> pa.Array:
        kept = []
        for part in text_slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), SLICE_BYTES):
            names, scores, _ = _labelled(network, part.column("text"))
            kept.append((np.array(names, object) != UNDETERMINED) & (scores >= least))
        return pa.array(np.concatenate([*kept, np.zeros(0, bool)]), pa.bool_())

    told = F.arrow_udf(run, "boolean")
    return docs.where(told(docs["text"].cast("string")))
