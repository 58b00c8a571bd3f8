"""Cases that the third review found."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import editscript, textdiff
from docloom.functions import scalar as fn
from docloom.functions.vectorized import plain_text
from docloom.operators import diff, document_analysis, lineage, nearest, set_join, tagging, temporal


def test_cut_references_stay_as_they_are():
    assert plain_text("<h1>and&amp</h1><p>Ly &amp;lt; &ampfoo; &#65;&eacute; &nosuch;") == "and&ampLy &lt; &ampfoo; Aé &nosuch;"


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(set_join, "ROWS", 60)
    monkeypatch.setattr(set_join, "PAIRS", 50)
    monkeypatch.setattr(set_join, "TILE", 20)
    draw = random.Random(5)
    rows = [(0, None, 5, [1, 2]), (1, "x", 5, []), (2, "x", 5, None), (3, "x", None, [1]), (None, "x", 5, [1])]
    for k in range(10, 250):
        base = draw.choice(rows[5:])[3] if k > 20 and draw.random() < 0.7 else draw.sample(range(60), draw.randint(1, 40))
        own = [t for t in base if draw.random() < 0.95] or base
        rows.append((k, draw.choice("xxy"), draw.choice([5, 9, 11]), own + ([draw.randint(60, 90)] if draw.random() < 0.3 else [])))
    df = spark.createDataFrame(rows, "k long, lang string, size int, w array<int>")
    sets = lineage.token_sets(df, "k", "w", ["lang", "size"])
    found = {(r.a, r.b): round(r.score, 9) for r in set_join.similar_pairs(sets, "k", ["lang"], "size", threshold).collect()}
    expected = {}
    for a, la, sa, x in rows[5:]:
        for b, lb, sb, y in rows[5:]:
            score = len({*x} & {*y}) / len({*x} | {*y})
            if a < b and la == lb and max(sa, sb) <= 2 * min(sa, sb) and score > threshold:
                expected[a, b] = round(score, 9)
    assert found == expected and len(found) > 100


def test_similar_pairs_are_not_joined_by_token(spark):
    rows = [(k, "x", 9, [*range(20), 100 + 3 * k, 101 + 3 * k, 102 + 3 * k]) for k in range(300)]
    sets = lineage.token_sets(spark.createDataFrame(rows, "k long, lang string, size int, w array<int>"), "k", "w", ["lang", "size"])
    pairs = set_join.similar_pairs(sets, "k", ["lang"], "size", 0.8)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 0 and "_t" not in plan


def test_near_pairs_hold_the_nearest(spark):
    draw = random.Random(3)
    rows = [(k, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for k in range(150)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, 2.0]), (204, [1.0, None, 2.0]), (205, [-1.0, -1.0])] + [(k, [1.0, 2.0, 2.0]) for k in range(300, 340)]
    v = spark.createDataFrame(rows, "id long, e array<double>")
    a, b = v.select(F.col("id").alias("a"), F.col("e").alias("x")), v.select(F.col("id").alias("b"), F.col("e").alias("y"))
    first = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    top = lambda pairs: {(r.a, r.b, r.r) for r in pairs.select("a", "b", fn.cosine(F.col("x"), F.col("y")).alias("s")).withColumn("r", F.row_number().over(first)).where("r <= 3").collect()}
    assert top(nearest.near_pairs(a, b, 3, 5)) == top(a.crossJoin(b).where("a <> b"))
    assert nearest.near_pairs(a, b, 3, 1).count() < 20 * len(rows)


def _nodes(df, name):
    """What the nodes of a plan get as columns, by the name of the node."""
    todo, found = [df._jdf.queryExecution().optimizedPlan()], []
    for node in todo:
        below = [node.children().apply(i) for i in range(node.children().size())]
        todo += below
        if node.nodeName() == name:
            found.append(",".join(b.output().mkString(",") for b in below))
    return found


def test_areas_are_ordered_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "xA1yA22"), (2, None)], "id int, text string")
    configs = spark.createDataFrame([(1, "a", "y", False), (1, "a", None, True), (1, None, "Y", False)], "id int, start string, end string, is_key boolean")
    out = tagging.focus_areas(docs, "id", "text", configs)
    windows = _nodes(out, "Window")
    assert len(windows) == 2 and not any(f",{c}#" in w for w in windows for c in ("_text", "_body", "_pattern"))
    assert sorted((r.is_key, r.at, r.end, r.section_end, r.key_text) for r in out.collect()) == [(False, 0, 3, 2, None), (False, 2, 3, 5, None), (False, 5, 7, 7, None), (True, 2, 7, 7, "1yA22")]


def test_tags_are_counted_once_by_page(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (1, None, "b"), (2, 1, "b")], "code int, page int, s string")
    out = diff.paired_tags(rows.where("s = 'a'"), rows.where("s = 'b'"), "code", "page")
    assert sum("_page" in columns for columns in _nodes(out, "Aggregate")) == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, 2), (2, 1, 0, 0)]


def test_short_intervals_are_one_row(spark):
    draw, day = random.Random(2), lambda n: datetime(1995, 1, 1) + timedelta(hours=n)
    points = [(i, draw.choice([1, 2, 3, None]), day(draw.randrange(30_000))) for i in range(200)] + [(900, 1, None), (901, 9, day(5))]
    spans = [(i, draw.choice([1, 2, 4, None]), day(s), day(s + draw.choice([0, -50, 24 * 20, 24 * 90, 24 * 130, 200_000]))) for i in range(150) for s in [draw.randrange(-9000, 30_000)]]
    spans += [(900, 1, None, day(9)), (901, 1, day(9), None), (902, 2, day(-900_000), day(900_000))]
    p, s = spark.createDataFrame(points, "p int, key int, at timestamp_ntz"), spark.createDataFrame(spans, "s int, key int, start timestamp_ntz, end timestamp_ntz")
    out = temporal.as_of_join(p, s, "key", "at", "start", "end")
    expected = [(i, j) for i, k, t in points for j, m, a, b in spans if k is not None and k == m and None not in (t, a, b) and a <= t < b]
    assert sorted((r.p, r.s) for r in out.collect()) == sorted(expected) and len(expected) > 100
    one = s.where("datediff(end, start) = 90")
    assert _joined(temporal.as_of_join(p, one, "key", "at", "start", "end")) <= one.count()


def _joined(df):
    """The rows of the right side of a plan's last join."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    jvm = df.sparkSession._jvm
    return getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(df.sparkSession._jsparkSession, node.children().apply(1)).count()


def test_words_are_counted_where_their_documents_are(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "id int, text string")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 2, 3)], "k int, old int, new int")
    out = diff.word_changes(diff.word_counts(docs.withColumnRenamed("id", "_doc"), "_doc", F.col("text")), pairs, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_doc#" in plan and not re.search(r"hashpartitioning\(_doc#\d+, word#", plan)
    assert sorted(map(tuple, out.collect())) == [(7, "a", -1), (7, "b", -1), (7, "c", 1), (8, "b", -1), (8, "c", -1)]


def test_tokens_of_one_text_alone_cost_no_row(monkeypatch):
    rows, step = [], editscript._next
    monkeypatch.setattr(editscript, "_next", lambda *row: rows.append(row) or step(*row))
    assert editscript.changes("abcabc", "xyzxyz") == [(0, 6, 0, 6)] and not rows
    assert editscript.changes("xaybz", "1a2b3") == [(0, 1, 0, 1), (2, 3, 2, 3), (4, 5, 4, 5)] and all(full == 3 for _, _, full in rows)


def test_noise_is_found_once_a_word():
    textdiff.is_noise.cache_clear()
    assert textdiff.without_noise("a ; a ;\n; b") == "a   a  \n  b" and textdiff.is_noise.cache_info().misses == 3


def test_texts_that_no_analysis_has_are_not_compared(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "en")], "id int, lang string")
    out = document_analysis.pair_features(spark.createDataFrame([(1, 2)], "a int, b int"), docs, "id")
    assert "EvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert len(out.first()["features"]) == len(document_analysis.feature_names())
