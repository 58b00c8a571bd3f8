"""The ten operators on small frames: nulls, empty and repeated rows, ties, clashing names, empty tables, and brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import catalog, chat_format, decontaminate, keycounts, language_id, license_scan, lm_score, mixing, ngram_join, token_file, url_filter, vector_tree, wordhash
from docloom.llm.base import new_dir, table
from docloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls long, low string, _url string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y") for i, t, lang, s in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_word_hashes_equal_for_equal_words(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "A b\tC", "x" * 3000] + ["".join(rng.choice("aBé \n\t字") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    for segment in (16, 1000, 4 << 20):
        monkeypatch.setattr(wordhash, "SEGMENT", segment)
        hashes, counts = wordhash.word_hashes(pa.array(texts))
        assert list(counts) == [len(words(t)) for t in texts]
        found = {}
        for word, own in zip((w for t in texts for w in words(t)), hashes, strict=True):
            assert found.setdefault(word, own) == own
        assert len(set(found.values())) == len(found)


@pytest.mark.parametrize(("n", "bits"), [(0, 10), (1, 3), (5, 3), (70_001, 17), (70_001, 48), (9, 62), (5000, 56)])
def test_packed_keys_come_back(n, bits):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
    counts = rng.integers(0, 400, len(keys))
    assert (keycounts.unpack_keys(keycounts.pack_keys(keys)) == keys).all()
    assert (keycounts.unpack_counts(keycounts.pack_counts(counts), len(keys)) == counts).all()


@pytest.mark.parametrize("fan", [1, 512])
def test_every_block_is_told_the_totals_of_its_keys(spark, fan):
    layout, rng = keycounts.Layout(30, 23, 20, fan), np.random.default_rng(fan)
    own = {b: np.unique(rng.integers(0, 1 << 20, rng.integers(0, 3000), dtype=np.uint64)) for b in range(30)}
    own[3] = np.empty(0, np.uint64)
    for b in own:  # a key that every block has
        own[b] = np.union1d(own[b], np.array([77], np.uint64)) if b != 3 else own[b]
    counts = {b: rng.integers(0, 300, len(k)) for b, k in own.items()}
    total = Counter()
    for b, keys in own.items():
        total.update(dict(zip(keys.tolist(), counts[b].tolist(), strict=True)))

    def ask(table):
        b = table.column("block")[0].as_py()
        return layout.asked(own[b], counts[b], b)

    def answer(key, table):
        b = table.column("block")[0].as_py()
        told, stats = layout.answered(table)
        return pa.table([pa.array([b], pa.int64()), pa.array([told.tolist()], pa.list_(pa.int64())), pa.array([stats.tolist()], pa.list_(pa.int64()))], names=["block", "told", "stats"])

    asks = spark.range(30).withColumnRenamed("id", "block").groupBy("block").applyInArrow(ask, keycounts.ASK_DDL)
    answers = keycounts.totals(asks, layout, lambda keys, n: [len(keys), int(n.sum())])
    found = answers.groupBy("block").applyInArrow(answer, "block long, told array<long>, stats array<long>").collect()
    assert len(found) == 30
    for r in found:
        assert r.told == [total[k] for k in own[r.block].tolist()]
        assert r.stats == [len(total), sum(total.values())]


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 120)] + [(5, 4), (7, 7), (None, 3), (200, 201), (201, 200)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in range(21)} == {0}
    assert {out[x] for x in range(100, 120)} == {100}
    assert out[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ------------------------------------------------------------------------------------------------------------------


def test_masks_hit_every_window_of_two_substitutions():
    size = decontaminate.WINDOW
    for wrong in combinations(range(size), decontaminate.SUBSTITUTIONS):
        assert any(
            all(c == "0" or at + i not in wrong for i, c in enumerate(mask)) for mask in decontaminate.MASKS for at in range(size - len(mask) + 1)
        ), wrong


def _leaks(docs, items):
    """Brute force over all shifts and windows."""
    out = {}
    toks = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    for (d, text), (b, item) in product(docs, items):
        x, y = toks(text), toks(item)
        if len(y) < 8:
            continue
        width = min(13, len(y))
        for shift in range(-len(y), len(x)):
            equal = [0 <= shift + j < len(x) and x[shift + j] == y[j] for j in range(len(y))]
            best = max(sum(equal[s : s + width]) for s in range(len(y) - width + 1))
            if best >= width - (2 if width == 13 else 0) and best > out.get((d, b), (0, 0))[0]:
                out[d, b] = (best, shift)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)]
    items = [(b, " ".join(rng.choice(pool) for _ in range(n))) for b, n in enumerate((7, 8, 10, 13, 14, 40, 90))] + [(7, None), (8, "")]
    docs = [(0, None), (1, ""), (2, "short")]
    for d in range(3, 20):
        own = [rng.choice(pool) for _ in range(rng.randint(5, 120))]
        source = items[rng.randrange(7)][1].split()
        cut = source[rng.randrange(3) :]
        for at in rng.sample(range(len(cut)), min(len(cut), rng.randrange(4))):
            cut[at] = "zz"
        at = rng.randrange(len(own))
        docs.append((d, " ".join(own[:at] + cut + own[at:])))
    frame_ = frame(spark, [(i, t, "en", "s") for i, t in docs]).union(frame(spark, [(3, docs[3][1], "en", "s")]))
    out = decontaminate.find_leaks(frame_, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.window_matched, r.doc_start) for r in out} == _leaks(docs, items)
    assert len(out) == len({(r.doc_id, r.item_id) for r in out})
    kept = decontaminate.drop_leaked(frame_, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame_.columns
    gone = {d for d, _ in _leaks(docs, items)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in frame_.collect() if r.doc_id not in gone)
    nulls = frame(spark, [(None, items[5][1], "en", "s"), (None, "a clean text", "en", "s"), (None, None, "en", "s")])
    assert {r.text for r in decontaminate.drop_leaked(nulls, spark.createDataFrame(items, "item_id long, text string")).collect()} == {"a clean text", None}


def test_leaks_in_a_very_long_text(spark):
    rng = random.Random(12)
    item = [f"q{i}" for i in range(30)]
    text = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    text[41_000:41_020] = [*item[5:15], "zz", *item[16:25]]
    out = decontaminate.find_leaks(frame(spark, [(1, " ".join(text), "en", "s")]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.window_matched, r.doc_start) for r in out] == [(1, 7, 12, 40_995)]


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark, [(1, "a b c", "en", "s")]), none).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), table(spark, SF, "benchmark")).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 3, 50_000, 2**32])
def test_segments_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::17] = 4_000_000_000
    doc_ids, lengths, back = token_file.read_segment(segment := token_file.write_segment(pa.array([5, None, -1]), np.array([n, 0, 0]), ids))
    assert (back == ids).all() and doc_ids.to_pylist() == [5, None, -1] and list(lengths) == [n, 0, 0]
    for low, high in ((0, n), (-3, 5), (127, 129), (300, 301), (n - 1, n + 9), (5, 5)):
        assert (token_file.read_range(segment, low, high) == ids[max(low, 0) : max(high, 0)]).all()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path, rng = catalog.tokenizer_path(), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "1", "23", "!", "'s", "'ll", "é", "字", "\u2003", "\u3000", "\xa0", "<|endoftext|>", "\r", "\x85", "\x1c", "\u2028", "Ü", "😀", "...", "Foo,", " bar"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "a" * 60]
    ids, counts = token_file.Encoder(path)(*wordhash.text_bytes(pa.array(texts)))
    expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(counts) == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path().replace("byte_bpe_50k.json", "word_bpe_49k.json")
    encoder, texts = token_file.Encoder(path), ["", "Hello there,  world!", " a\nb é", "don't  stop"]
    ids, counts = encoder(*wordhash.text_bytes(pa.array(texts)))
    expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert not encoder.cuts and list(counts) == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_token_files_read_back(spark):
    from tokenizers import Tokenizer

    rows = [(9, "last one", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, "x y " * 4000, "en", "s"), (3, "again", "en", "s"), (None, "no id", "en", "s"), (-4, "first", "en", "s")]
    segments = token_file.write_tokens(frame(spark, rows), new_dir(spark, "t"), catalog.tokenizer_path)
    out = token_file.read_tokens(segments).orderBy("start").collect()
    encode = Tokenizer.from_file(catalog.tokenizer_path()).encode
    assert [r.doc_id for r in out] == [None, -4, 1, 2, 3, 3, 9]
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, (*encode(t or "").ids, 2)) for i, t, _, _ in rows)
    at = 0
    for r in out:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    whole = [x for r in out for x in r.ids]
    for low, high in ((0, 5), (3, 4), (900, 2500), (0, at), (at, at + 5)):
        pieces = token_file.read_places(segments, low, high).orderBy("start").collect()
        assert [x for p in pieces for x in p.ids] == whole[low:high] and all(p.start >= low for p in pieces)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_file.read_tokens(segments, digest=True).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out}
    assert token_file.read_tokens(token_file.write_tokens(frame(spark, []), new_dir(spark, "t"), catalog.tokenizer_path)).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 4, "b": 3, "c": 2}, {"a": 50, "b": 1, "c": 7, "d": 7}])
def test_schedule_stays_within_a_block(weights):
    slots = mixing.period(weights) * 3
    assert Counter(slots) == {s: 3 * a for s, a in weights.items()}
    assert mixing.largest_deviation(slots, weights) < 1


def test_mix_keeps_every_row_in_scheduled_order(spark):
    rows = [(i, f"t{i}", "en", "ab"[i % 3 == 0] if i % 10 else None) for i in range(500)] + [(7, "t7", "en", "a")] * 3
    docs = frame(spark, rows).withColumn("mix_slot", F.lit(-1)).withColumn("k", F.lit(1)).withColumn("phase", F.lit(2))
    out = mixing.mix_sources(docs, {"a": 3, "b": 1}, block_rows=4).orderBy("mix_position").collect()
    assert len(out) == len(rows) and len({r.mix_position for r in out}) == len(rows)
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert set(docs.columns) - {"mix_slot"} < set(out[0].asDict())
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.mix_slot, set()).add((r.mix_source, r.mix_block))
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(x) == 1 for x in by_slot.values())
    order = [next(iter(by_slot[s]))[0] for s in sorted(by_slot)]
    first = next(i for i in range(len(order)) if "" not in order[i:] or "b" not in order[i:])
    shares = {"a": 3, "b": 1, "": 1}
    assert mixing.largest_deviation(order[:first], shares) < 1
    assert mixing.mix_sources(frame(spark, [])).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def test_gradients_equal_differences():
    network = language_id.Network.new(["a", "b", "c"], hidden=3)
    network.weights = [w.astype(np.float64) for w in network.weights]
    rng = np.random.default_rng(0)
    x, labels = rng.integers(97, 100, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    inside = np.arange(4)[:, None] < np.array([4, 1, 3, 4, 2])
    _, grads = network.gradients(x, inside, labels)
    for w, g in zip(network.weights, grads, strict=True):
        for at in [tuple(i) for i in np.argwhere(np.abs(g) > 1e-3)[:4]]:
            old, step = w[at], 1e-2
            w[at] = old + step
            up = network.gradients(x, inside, labels)[0]
            w[at] = old - step
            down = network.gradients(x, inside, labels)[0]
            w[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-4)


def _labelled_slowly(network, text):
    """Each byte's probabilities, a byte and a number at a time: windows with margins, both layers, labels."""
    data, size = text.encode(), network.weights[1].shape[1]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def layer(part, inputs, weights):
        h, states = [0.0] * size, []
        for byte in part:
            u = [sum(float(weights[r][c]) * h[c] for c in range(size)) for r in range(3 * size)]
            a = [float(inputs[r][byte]) for r in range(3 * size)]
            z = [sigmoid(a[i] + u[i]) for i in range(size)]
            r = [sigmoid(a[size + i] + u[size + i]) for i in range(size)]
            new = [math.tanh(a[2 * size + i] + r[i] * u[2 * size + i]) for i in range(size)]
            h = [z[i] * h[i] + (1 - z[i]) * new[i] for i in range(size)]
            states.append(h)
        return states

    out = []
    for low in range(0, len(data), language_id.WINDOW):
        high = min(low + language_id.WINDOW, len(data))
        start, end = max(low - language_id.MARGIN, 0), min(high + language_id.MARGIN, len(data))
        forth, back = layer(data[start:end], *network.weights[:2]), layer(data[start:end][::-1], *network.weights[2:4])[::-1]
        for at in range(low - start, high - start):
            told = [float(network.weights[5][k][0]) + sum(float(network.weights[4][k][c]) * x for c, x in enumerate([*forth[at], *back[at]])) for k in range(len(network.languages))]
            told = [math.exp(x - max(told)) for x in told]
            out.append([x / sum(told) for x in told])
    return out


def test_labels_equal_a_byte_at_a_time():
    network = language_id.Network.new(["a", "b", "c"], hidden=3)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé zü") for _ in range(n)) for n in (1, 2, 17, 255, 256, 257, 600)]
    mean, given = network.texts(pa.array(texts))
    for text, own, of in zip(texts, mean, given, strict=True):
        slow = np.array(_labelled_slowly(network, text))
        assert own == pytest.approx(slow.mean(0), abs=1e-5)
        assert sum(of) == len(text.encode()) and np.abs(of - np.bincount(slow.argmax(1), minlength=3)).max() <= 1


def test_labels_do_not_depend_on_other_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    network = language_id.fit(docs, F.lit(True))
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 150").select("doc_id", "text").collect()] + [(1000, "und die"), (1001, "je ne sais pas"), (1002, "the"), (1003, None)]
    alone = {i: language_id._labelled(network, pa.array([t])) for i, t in rows}
    for parts in (1, 7):
        found = language_id.identify(frame(spark, [(i, t, "en", "s") for i, t in rows]).repartition(parts), network).collect()
        for r in found:
            names, scores, _ = alone[r.doc_id]
            assert r.lang_pred == names[0] and r.score == pytest.approx(scores[0], abs=1e-5)


def test_languages_of_held_out_documents(spark):
    out = catalog.op4_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_languages_of_odd_texts(spark):
    rows = [(i, "the and of that is was with for this from " * 3, "en", "s") for i in range(40)] + [(100 + i, "der die das und ist nicht mit von auf ein " * 3, "de", "s") for i in range(40)]
    rows += [(500, None, None, "s"), (501, "", "en", "s"), (502, "123 !!", "en", "s"), (503, "und die " * 9000, None, "s"), (504, "x", None, None), (0, rows[0][1], "en", "s")]
    docs = frame(spark, rows)
    network = language_id.fit(docs, F.col("doc_id") < 500)
    out = {r.doc_id: r for r in language_id.identify(docs, network).collect()}
    assert [out[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert out[503].lang_pred == "de" and out[1].lang_pred == "en" and out[504].lang_pred in ("de", "en")
    assert sum(out[503].lang_bytes.values()) == len(rows[83][1])
    kept = language_id.keep_identified(docs, network)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in (500, 501, 502))
    none = language_id.fit(docs, F.lit(False))
    assert none is None and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), network).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_scores_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "B", "c", "dd", "é"]) for _ in range(rng.randrange(12))), "en", "s") for i in range(60)]
    rows += [(60, None, "en", "s"), (61, "", "en", "s"), (62, " \n ", "en", "s"), (None, "a b", "en", "s"), (1, rows[1][1], "en", "s"), (63, "a c " * 5000, "en", "s")]
    out = lm_score.score_texts(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, b, three = Counter(), Counter(), Counter()
    for i, t, _, _ in rows:
        if not held(i):
            own = [*words(t), None]
            c.update(own)
            b.update(zip(["<s>", *own], own, strict=False))
            three.update(zip(["<s>", *own], own, own[1:], strict=False))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    expected = Counter()
    for i, t, _, _ in rows:
        own, score = [*words(t), None], 0.0
        few, fewer = lm_score.PRIORS
        for at, (u, w) in enumerate(zip(["<s>", *own], own, strict=False)):
            before = c[None] if u == "<s>" else c[u]
            likely = (b[u, w] + few * p(w)) / (before + few)
            if at:
                before = ["<s>", *own][at - 1], u
                likely = (three[*before, w] + fewer * likely) / (b[before] + fewer)
            score += math.log10(likely)
        expected[i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10(p(w)) for w in own), 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out) == expected
    assert lm_score.score_texts(frame(spark, []), F.lit(False)).count() == 0
    untaught = lm_score.score_texts(frame(spark, rows[:5]), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in untaught)


# 6 ------------------------------------------------------------------------------------------------------------------


def _licences(text, templates, percent):
    """All passages of all templates, then the best in turn."""
    own = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    grams = list(zip(own, own[1:], strict=False))
    found = []
    for number, (name, notice) in enumerate(templates):
        told = [w for w in re.split(r"[\W_]+", notice.lower()) if w]
        template = Counter(zip(told, told[1:], strict=False))
        m = sum(template.values())
        at = [i for i, g in enumerate(grams) if g in template]
        for first in at:
            best = (0.0, 0)
            for last in (x for x in at if first <= x < first + m * (200 - percent) / percent):
                size = last - first + 1
                common = sum((Counter(grams[first : last + 1]) & template).values())
                best = min(best, (-2.0 * common / (size + m), size, common))
            if best[1] and 200 * best[2] >= percent * (best[1] + m):
                found.append((-best[2], best[0], first, best[1], name, number, m))
    kept = []
    for f in sorted(found):
        if not any(f[2] <= k[2] + k[3] and k[2] <= f[2] + f[3] for k in kept):
            kept.append(f)
    return {(first, size + 1, name, -gone, m) for gone, _, first, size, name, _, m in kept}


def test_licences_equal_brute_force(spark):
    texts = dict(license_scan.TEMPLATES[11:])
    near = "This work is licensed under the GNU General Public License version 3"
    rows = ["hello\n" + near + "\nbye", None, "", "MIT", "Copyright 2020 Foo. Released under the MIT License.", "# Licensed under the Apache\n# License, Version\n# 2.0.", "released under the mit license " * 3, "x y " * 20000 + near]
    rows += ["My file\n\n" + texts["MIT"] + "\n\n" + texts["BSD-2-Clause"], texts["BSD-3-Clause"].replace("DIRECT", "direkt").replace("\n", "\n * "), texts["GPL-3.0"][:300] + " and " + texts["Apache-2.0"], "licensed under cc by 4 0 licensed under cc by nc 4 0"]
    rng = random.Random(11)
    parts = " ".join(n for _, n in license_scan.TEMPLATES[:11]).split()
    rows += [" ".join(rng.choice(parts) if rng.random() < 0.3 else parts[(k + i) % len(parts)] for i in range(120)) for k in range(0, 40, 3)]
    found = {}
    for r in license_scan.scan_licenses(frame(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect():
        found.setdefault(r.doc_id, set()).add((r.start, r.n_words, r.license, r.common, r.n_template))
    for i, t in enumerate(rows):
        assert found.get(i, set()) == _licences(t, license_scan.TEMPLATES, 80), t
    assert [{x[2] for x in found[i]} for i in (4, 5, 8, 9)] == [{"MIT"}, {"Apache-2.0"}, {"MIT", "BSD-2-Clause"}, {"BSD-3-Clause"}]
    assert license_scan.scan_licenses(frame(spark, [(1, near, "en", "s")]), []).count() == 0
    twice = frame(spark, [(1, near, "en", "s"), (1, near, "en", "s"), (None, near, "en", "s")])
    assert Counter(r.doc_id for r in license_scan.scan_licenses(twice).collect()) == {1: 2, None: 1}
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


def _exact(ids, m, query, k=20):
    """The true neighbours of one row, and all scores."""
    s = m @ m[query]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[query]]
    return [ids[i] for i in order[:k]], dict(zip(ids, s, strict=True))


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.2]), (20, [1.0, 0.0]), (0, [1.0, 0.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, rank int")
    out = vector_tree.search(v, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 20), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert vector_tree.search(v.limit(0), F.lit(True)).count() == 0


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1500, 8)) + rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)] * 4
    m[300:700] = m[300]
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "vec_id long, embedding array<double>")
    out, hit = {}, 0
    for r in vector_tree.search(v, F.col("vec_id") % 20 == 0).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(out) == 75
    for q, own in out.items():
        s = m @ m[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(len(m)), -np.round(s, 9)))[:20]
        hit += len({v for v, _ in own.values()} & set(true.tolist()))
        assert sorted(own) == list(range(1, 21))
        assert all(score == pytest.approx(s[v]) for v, score in own.values())
    assert hit / (75 * 20) >= 0.9


def test_neighbours_of_the_table_reach_the_recall(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in rows if None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    ids, m = [i for i, _ in rows], np.array([x for _, x in rows], np.float64)
    found = {}
    for r in catalog.op7_vector_tree(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == sorted({i for i in ids if i % 20 == 0})
    hit = n = 0
    for query, own in found.items():
        true, scores = _exact(ids, m, ids.index(query))
        assert sorted(own) == list(range(1, len(true) + 1))
        assert all(score == pytest.approx(scores[v]) for v, score in own.values())
        hit, n = hit + len({v for v, _ in own.values()} & set(true)), n + len(true)
    assert hit / n >= 0.9


def test_queries_get_all_that_there_are(spark):
    rng = np.random.default_rng(9)
    m = np.concatenate([rng.normal(size=(600, 4)) * 0.01 + [50, 0, 0, 0], rng.normal(size=(5, 4)) * 0.01 + [0, 50, 0, 0]])
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "vec_id long, embedding array<float>")
    out = vector_tree.search(v, F.col("vec_id") % 20 == 0, k=300).groupBy("query_id").count().collect()
    assert {r["count"] for r in out} == {300} and len(out) == 31
    few = vector_tree.search(v.where("vec_id > 595"), F.col("vec_id") == 600, k=20).collect()
    assert sorted(r.vec_id for r in few) == [596, 597, 598, 599, 601, 602, 603, 604]
    with pytest.raises(ValueError, match="components"):
        vector_tree.search(v.union(v.select(F.lit(1), F.array(F.lit(1.0).cast("float")))), F.lit(True))


# 8, 10 --------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://example.com", "http://x.net/fr/1#a", "http://xnet/fr/1", "http://a.b/c/ads/d", "http://a.b/login", "http://EXAMPLE.com/EN/", "http://x.net/fr/1#a", "x://y.com/" + "a" * 50000]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, _rule string, _url int")
    rules = [url_filter.host_rule(*r) for r in catalog.URL_RULES] + [url_filter.pattern_rule(*r) for r in catalog.URL_PATTERNS]
    out = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(out) == len(urls)
    assert out[0] == out[1] == out[2] == ("", None, "allow")
    assert out[3] == ("a.example.com", "example.com/en/", "block")
    assert out[4] == ("www.example.com", "www.example.com/en/", "allow")
    assert out[5] == ("example.com", None, "allow")
    assert out[6] == out[11] == ("x.net", "net/fr/", "block")
    assert out[7] == ("xnet", None, "allow")
    assert out[8][1:] == out[9][1:] == (None, "block")
    assert out[10] == ("example.com", "com/", "allow")
    assert out[12][1:] == ("com/", "allow")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_chats_come_back_identical(spark):
    rng = random.Random(6)
    parts = [*chat_format.CONTROL, "&", "&lt;", "&amp;lt;", "\n", " ", "a", "é", "<", "|", "😀", "im_start", "&#10;"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for c in range(60) for t in range(rng.randrange(1, 5))]
    rows += [(None, 1, "user", "x"), (70, None, "assistant", "y"), (70, 1, "assistant", "z" * 100_000), (71, 1, "user", "same"), (71, 1, "user", "same")]
    turns = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = {r.conv_id: r for r in chat_format.format_chats(turns).withColumn("back", chat_format.parse(F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(b.role, b.text) for b in out[conv].back] == [(r[2] or "", r[3] or "") for r in own]
        bare = re.sub(r"<\|im_start\|>|<\|im_end\|>\n", "", out[conv].formatted)
        assert not any(c in bare for c in chat_format.CONTROL)
        assert len(out[conv].loss_spans) == sum(r[2] == "assistant" for r in own)
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------


def _joined(rows, width, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if rows[i][0] == rows[j][0] and sets[i] and sets[j] or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return Counter((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_joins_equal_brute_force(spark, width, percent):
    rng = random.Random(percent)
    pool = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x y " * 3000), (907, "x y " * 3000)]
    passage = " ".join(rng.choice(pool) for _ in range(60))
    for g in range(8):
        base = [rng.choice(pool) for _ in range(rng.choice([6, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = rng.choice(pool)
            rows.append((len(rows), " ".join(own) + (" " + passage if g % 3 == 0 else "")))
    rows += [(3, "entirely other words here for a repeated id"), rows[12]]
    out = ngram_join.join_ngrams(frame(spark, [(i, t, "en", "s") for i, t in rows]), width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == _joined(rows, width, percent)


def test_joins_and_scores_through_relays_are_the_same(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))), "en", "s") for i in range(80)]
    rows += [(i + 100, t + " x", lang, s) for i, t, lang, s in rows[:20]]
    docs = frame(spark, rows)

    def both():
        joined = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_ngrams(docs, 2, 80).collect())
        return joined, {r.doc_id: (r.n_known, r.train_tokens, round(r.score, 9)) for r in lm_score.score_texts(docs, F.col("doc_id") % 5 == 1, block_bytes=200).collect()}

    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 200)
    direct = both()
    monkeypatch.setattr(keycounts, "FAN", 2)
    assert both() == direct
    assert direct[0] == _joined([(i, t) for i, t, _, _ in rows], 2, 80)


def test_members_of_one_group_meet_without_its_first(spark):
    rows, least = [], set()
    for g in range(12):  # the class keys, and with them the first of a group, depend on the words
        p, x, y = ([f"{name}{g}n{i}" for i in range(100)] for name in "pxy")
        own = {"a": [*p, f"d{g}", *y], "b": [*x, f"b{g}", *p], "c": [*p, f"c{g}", *x]}
        texts = {name: " ".join(w) for name, w in own.items()}
        sets = ngram_join.shingle_sets(pa.array(texts.values()), 1)
        least.add(min(zip(map(ngram_join.class_key, sets), texts, strict=True))[1])
        for t in texts.values():
            rows.append((len(rows), t))
        for side in (x, y):  # x and y stand in six other documents, so that the words of p are the rarest
            for k in range(6):
                rows.append((len(rows), " ".join([*side, *(f"o{g}{side[0]}{k}w{i}" for i in range(60))])))
    assert least == {"a", "b", "c"}
    for width in (1, 3):
        out = ngram_join.join_ngrams(frame(spark, [(i, t, "en", "s") for i, t in rows]), width, 90).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == _joined(rows, width, 90)


def test_join_of_nothing_and_null_ids(spark):
    assert ngram_join.join_ngrams(frame(spark, [])).count() == 0
    rows = [(None, "a b c d", "en", "s"), (5, "a b c d", "en", "s"), (4, "a b c d", "en", "s")]
    assert {(r.doc_id, r.component_id) for r in ngram_join.join_ngrams(frame(spark, rows)).collect()} == {(None, None), (5, 4), (4, 4)}
    assert sorted(str(r.doc_id) for r in ngram_join.keep_first(frame(spark, rows)).collect()) == ["4", "None"]
    rows += [(4, "a b c d", "en", "s"), (7, "q r s t u v", "en", "s"), (7, "other words", "en", "s"), (8, "", "en", "s"), (8, "", "en", "s")]
    kept = ngram_join.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "7", "8", "8", "None"]


# queries ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(catalog.ORACLES[name]).df()
    found = catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert Counter(map(str, found[columns].astype(str).values.tolist())) == Counter(map(str, expected[columns].astype(str).values.tolist()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    from docloom.llm.base import written

    kept = written(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t0")
    joined = _joined([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    first = {i for i, _, c in joined if i == c}
    con = duckdb.connect()
    con.register("documents", kept.where(F.col("doc_id").isin(*first)).toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    leaked = set(con.execute(decontaminate.oracle_sql()).df().doc_id)
    assert {r.doc_id for r in out} == first - leaked
    mixed = mixing.mix_sources(docs.where(F.col("doc_id").isin(*(first - leaked))), catalog.MIX_WEIGHTS).orderBy("mix_position").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in mixed]


def _tables(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_of_odd_documents(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    english = "the and of that is was with for this from by on as at be or an are it not"
    rows = [(i, " ".join(random.Random(i).choices(english.split(), k=40)), "en", "src0" if i % 3 else None) for i in range(60)]
    german = "der die das und ist nicht mit von auf ein zu den im sich des dem als auch es an"
    rows += [(100 + i, " ".join(random.Random(i).choices(german.split(), k=40)), "de", "src1") for i in range(60)]
    leak = table(spark, SF, "benchmark").where("length(text) > 100").first().text
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "12 34", None, "s"), (None, rows[0][1] + " null id", "en", "s"), (203, rows[5][1], "en", "s"), (5, rows[5][1], "en", "s"), (204, rows[7][1] + " " + leak, "en", "s"), (205, english, None, None)]
    docs = frame(spark, rows).drop("n_chars").withColumn("mix_slot", F.lit(1)).withColumn("_leaked", F.lit(2)).withColumn("component_id", F.lit(3)).withColumn("shard", F.lit(4))
    out = corpus_pipeline.run(spark, _tables(spark, tmp_path, docs)).orderBy("start").collect()
    ids = [r.doc_id for r in out]
    # no text or no letter, copies of 5, and a benchmark passage
    assert set(ids) == {r[0] for r in rows} - {200, 201, 202, 203, 204} and len(ids) == len(set(ids))
    encode = Tokenizer.from_file(catalog.tokenizer_path()).encode
    texts = {i: t for i, t, _, _ in rows}
    at = 0
    for r in out:
        own = [*encode(texts[r.doc_id]).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, _tables(spark, tmp_path, frame(spark, []))).count() == 0
