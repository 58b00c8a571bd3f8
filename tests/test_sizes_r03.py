"""Steps of the third review whose memory or time grew too fast."""

from __future__ import annotations

import inspect
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom import catalog, session
from docloom.operators import language_profiles as lp
from docloom.functions import scalar as fn
from docloom.functions import textdiff, vectorized
from docloom.operators import document_analysis, search, templates, temporal, text_index, type_classifier
from docloom.session import checkpointed

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_found_without_a_row_for_each_pair(spark):
    draw = random.Random(1)
    keys = [draw.randrange(-60, 60) for _ in range(80)] + [None, 10**12, 10**12 + 7]
    rows = [(k, n) for n, k in enumerate(keys)]
    out = search.with_following(spark.createDataFrame(rows, "k long, n int"), "k", 20, "near", block=8)
    expected = [(k, n, sorted(m for j, m in rows if j is not None and k < j <= k + 20)) for k, n in rows if k is not None]
    assert sorted((r.k, r.n, sorted(c.n for c in r.near)) for r in out.collect()) == sorted(expected)
    near = F.transform("near", lambda c: F.struct(c["n"].alias("candidate"), F.lit(0.5).alias("score"), (c["n"] % 3).alias("adjusted")))
    best = {r.k: (r.candidate, r.adjusted) for r in search.best_candidates(out, "k", near).collect()}
    assert best == {k: (m, a) for k, n, found in expected if found for a, m in [max((m % 3, -m) for m in found)] for m in [-m]}
    plan = _plan(catalog.QUERIES["best_candidate"](spark, SF))
    assert "Join" not in plan and "Window" in plan


def test_grams_are_counted_where_their_texts_are(spark, monkeypatch):
    for step in (1 << 20, 4):
        monkeypatch.setattr(lp, "STEP", step)
        text = " aab éab дом 𐐨𐐨 aab "
        codes, n = lp._counts(np.concatenate([lp._chars(text), [lp.MARK], lp._chars(" b "), [lp.MARK], lp._chars("  ")]))
        expected = Counter(t[i : i + k] for t in (text, " b ") for k in (1, 2, 3) for i in range(len(t) - k + 1))
        del expected[" "]
        assert list(zip(lp._texts(codes), n.tolist(), strict=True)) == sorted(expected.items())
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "b c"), (None, "a"), (None, "-"), (3, None), (4, None), (4, "")], "_key int, _text string")
    rows = lp._own_grams(docs.select("_key", lp.only_letters(F.col("_text")).alias("_text")))
    found = {k: [(r.gram, r["size"]) for r in sorted(rows.collect(), key=lambda r: -1 if r["rank"] is None else r["rank"]) if r._key == k and r.gram] for k in (1, 2, 3, 4, None)}
    assert [g for g, _ in found[1]][:4] == [" b", " b ", "b", "b "] and {n for _, n in found[1]} == {len(found[1])}
    assert found[3] == found[4] == [] and {s for _, s in found[2]} == {len(found[2])} and [g for g, _ in found[None]] == [" a", " a ", "a", "a "]
    known = checkpointed(lp.profiles(docs.withColumn("lang", F.lit("x")), "lang", "_text"))
    out = lp.detected(docs, "_key", "_text", known)
    assert sorted(r._key or 0 for r in out.collect()) == [0, 1, 2, 3, 4]
    assert "MapInArrow" in _plan(lp.detected(docs, "_key", "_text", known)) and "MapInArrow" in _plan(lp.profiles(docs, "_key", "_text"))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(document_analysis, "checkpointed", lambda df: rounds.append(df) or checkpointed(df))
    rows = [(k, k // 100, k - 1 if k % 100 else None) for k in range(300)] + [(900, 9, 901), (901, 9, 902), (902, 9, 900)]
    docs = spark.createDataFrame(rows, "k long, lineage long, previous long")
    moved = spark.createDataFrame([(5,), (60,), (230,)], "k long")
    found = {r.k: r.root for r in document_analysis._later(docs, moved, "k").collect()}
    assert found == {**dict.fromkeys(range(5, 60), 5), **dict.fromkeys(range(60, 100), 60), **dict.fromkeys(range(230, 300), 230)} and len(rounds) <= 11


def test_pages_are_parsed_a_few_at_once(spark):
    batch = pa.RecordBatch.from_pydict({"k": list(range(200)), "url": ["http://a.b/c/"] * 199 + [None], "html": [None] + ["<title>t</title><a href='d'>x</a><a href='http://['>y</a>"] * 199})
    out = list(vectorized._linked(iter([batch])))
    assert max(map(len, out)) == vectorized.PAGES and sum(map(len, out)) == 200
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[0] == {"_key": 0, "text": "", "title": "", "links": []} and rows[1] == {"_key": 1, "text": "x y", "title": "t", "links": ["http://a.b/c/d", None]} and rows[199]["links"] == [None, None]
    assert _plan(catalog.QUERIES["html_text"](spark, SF)).count("Python") == 0


def test_scripts_are_arrow_columns(spark):
    rows = [(i, f"a b c{i}", "a c d") for i in range(150)] + [(900, None, "x"), (901, None, None)]
    df = spark.createDataFrame(rows, "k int, a string, b string").coalesce(1)
    found = {r.k: r.s for r in df.select("k", textdiff.changed_sections("a", "b").alias("s")).collect()}
    assert [(s.kind, s.text) for s in found[149]] == [(-1, "b c149"), (1, "c d")] and [s.text for s in found[900]] == ["x"] and found[901] == []
    assert "pandas" not in str(textdiff._compared.__code__.co_names) and not hasattr(textdiff, "pd")


def test_loads_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    at = "timestamp_ntz'2020-01-01'"
    old = spark.range(100).selectExpr("id", "'a' AS v", f"{at} AS start_date", "timestamp_ntz'2038-01-01' AS end_date")
    new = spark.range(50, 150).selectExpr("id", "if(id < 70, 'a', 'b') AS v")
    out = temporal.scd2_load(old, new, "id", ["v"], F.lit("2021-01-01").cast("timestamp_ntz"))
    assert _plan(out).count("Join") == 1 and re.search(r"RepartitionByExpression \[_key#\d+L?\], 20", _plan(out))
    found = sorted((r.id, r.v, r.start_date.year, r.end_date.year) for r in out.collect())
    expected = [(k, "a", 2020, 2038 if 50 <= k < 70 else 2021) for k in range(100)] + [(k, "b", 2021, 2038) for k in range(70, 150)]
    assert found == sorted(expected)


def test_names_are_written_out_once_by_several_tasks(spark):
    out = catalog.QUERIES["drug_names"](spark, SF)
    assert "RepartitionByExpression [p_partkey" in _plan(out)
    df = spark.createDataFrame([("x er 10/20mg",), ("y tabs",), (None,)], "t string")
    rows = df.select(fn.drug_names(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [["x extended release 10", "x extended release 20mg"], ["y tablet"], [""]]
    assert _plan(rows).count("suppos") < 20


def test_parts_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    facts = spark.range(100).selectExpr("id % 7 AS d", "id AS n", "id % 2 AS flag")
    part = templates.Part("T", "facts", "group", (("N", templates.Value("n")),), ("n",), by="flag")
    out = templates.rendered(spark.range(9).withColumnRenamed("id", "d"), "d", templates.Template((part,)), {"facts": facts})
    assert len(re.findall(r"RepartitionByExpression \[d#\d+L?\], 10", _plan(out))) == 2
    assert {r.d: r.html.count("<tr><td>") for r in out.collect()} == {d: len(range(d, 100, 7)) if d < 7 else 0 for d in range(9)}


def test_type_sums_are_those_of_a_dense_product():
    model = type_classifier.TypeModel(["a", "b", "c"], np.random.default_rng(4).normal(size=(3, 9)))
    words = pa.array([[0, 3, 7], [], [5], [1, 2, 3, 4]], pa.list_(pa.int32()))
    x = np.zeros((4, 9))
    for i, own in enumerate(words.to_pylist()):
        x[i, own] = 1 / np.sqrt(max(len(own), 1))
    x[:, 8] = 1
    told = np.exp(x @ model.weights.T)
    told /= told.sum(1, keepdims=True)
    assert np.allclose(model._probabilities(words), told)
    y = np.array([0, 1, 2, 1])
    batch = pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), words], names=["_y", "_w"])
    (out,) = type_classifier._gradients(model)(iter([batch]))
    found = np.zeros((3, 9))
    found[out["type"].to_numpy(), out["bucket"].to_numpy()] = out["g"].to_numpy()
    assert np.allclose(found, (told - np.eye(3)[y]).T @ x)
    assert "add" not in type_classifier.TypeModel._probabilities.__code__.co_names  # numpy's add.at goes element by element


def test_index_is_not_ordered_by_texts(spark):
    rows = spark.createDataFrame([("walked",), ("cities",), ("boxes",), ("walks",), ("bus",), ("été",), ("",), (None,)], "w string")
    assert [r.s for r in rows.select(text_index.stem(F.col("w")).alias("s")).collect()] == ["walk", "city", "box", "walk", "bus", "été", "", None]
    source = inspect.getsource(text_index.write_index)
    assert 'sortWithinPartitions("bucket", F.xxhash64("term"))' in source
