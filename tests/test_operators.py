"""Operators on small frames with known results."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import doc_types, vectorized
from docloom.functions import scalar as fn
from docloom.operators import diff, extraction, lifecycle, lineage, predicates, stats, tagging, temporal, views
from docloom.operators import table_query as tq
from docloom.sources import files
from docloom.streaming import heartbeats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def keys(df, name="id"):
    return sorted(r[name] for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "A", ["t1"], [("s1", 5)]), (2, "", ["t1", "t2"], []), (3, None, [], [("s2", 1), ("s1", 9)]), (4, "b form", None, None)]
    return spark.createDataFrame(rows, "id long, document_type string, tags array<string>, locations array<struct<site:string,n:int>>")


def test_filters_without_a_value(docs):
    f = lambda op, v=None: keys(tq.where_all(docs, [tq.Filter("document_type", op, value=v)]))
    assert f("notinlist") == [1, 2, 3, 4]
    assert f("neq") == [1, 2, 4] and f("neq", "") == [1, 2, 4]
    assert f("empty") == [2, 3] and f("notEmpty") == [1, 4]
    assert f("leq") == [2]
    assert f("contains") == [1, 2, 3, 4] and f("textcontains", None) == [1, 2, 3, 4]
    assert f("contains", "FORM") == [4] and f("notContains", "form") == [1, 2, 3]
    assert f("notinlist", ["A"]) == [2, 3, 4] and f("neq", ["A", ""]) == [3, 4]


def test_filters_on_arrays(docs):
    f = lambda name, op, v=None, kind="string": keys(tq.where_all(docs, [tq.Filter(name, op, kind, v)]))
    assert f("locations.site", "eq", "s1") == [1, 3]
    assert f("locations.site", "neq", "s1") == [2, 4]
    assert f("locations.n", "gt", 4, "number") == [1, 3]
    assert f("tags", "leq", ["t1", "t2"]) == [2] and f("tags", "eq", "t1") == [1, 2]
    with pytest.raises(ValueError):
        f("tags", "like", "x")


def test_predicates(docs):
    p = lambda q: keys(docs.where(predicates.compile_predicate(docs.schema, q)))
    assert p({}) == [1, 2, 3, 4]
    assert p({"document_type": None}) == [3] and p({"document_type": {"$in": [None, "A"]}}) == [1, 3]
    assert p({"document_type": {"$ne": "A"}}) == [2, 3, 4]
    assert p({"locations": {"$elemMatch": {"site": "s1", "n": {"$gt": 5}}}}) == [3]
    assert p({"locations": {"$not": {"$elemMatch": {"site": "s1"}}}}) == [2, 4]
    assert p({"locations": {"$not": {"$size": 0}}}) == [1, 3, 4]
    assert p({"$or": [{"id": 1}, {"$and": [{"id": {"$gte": 3}}, {"tags": {"$exists": True}}]}]}) == [1, 3]


def test_pages_and_sorts(docs):
    assert tq.sort_spec(["-a", "b"]) == [("a", -1), ("b", 1)]
    assert [r.id for r in tq.page(docs, [("document_type", 1), ("id", 0)], "id", 1, 2).collect()] == [2, 1]
    assert [r.id for r in tq.page(docs, [("tags", -1)], "id", limit=None).collect()][:2] == [2, 1]
    assert tq.total(docs, [tq.Filter("id", "inrange", "number", {"start": 2, "end": 3})]).first().total == 2


def test_views(spark, docs):
    rows = views.unwind_merge(docs.withColumn("n", F.lit(0)), "locations", lambda x: x["site"] == "s1").collect()
    assert sorted((r.id, r.n) for r in rows) == [(1, 5), (3, 9)]
    assert [(r.id, r.site) for r in views.single_element_view(docs, "locations", lambda x: x["n"] < 5).collect()] == [(3, "s2")]
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id long, previous long")
    assert keys(views.ancestors(chain, chain.where("id = 3"), "id", "previous")) == [1, 2, 3]


def test_valid_time(spark):
    day = lambda s: datetime.fromisoformat(s)
    rows = spark.createDataFrame([(1, day("2020-01-01"), day("2020-02-01")), (2, day("2020-02-01"), day("2038-01-01"))], "id int, start_date timestamp_ntz, end_date timestamp_ntz")
    assert keys(temporal.as_of(rows, F.lit("2020-02-01").cast("timestamp_ntz"))) == [2]
    facts = spark.createDataFrame([(1, "C", "medical", 100, True), (1, "C", "medical", 100, True), (1, "C", "pharmacy", 10, True), (2, "C", "medical", 5, False), (-1, "C", "medical", 9, True)], "controller_id int, channel string, benefit string, lives long, own boolean")
    out = temporal.lives_by_controller(facts, F.col("own")).collect()
    assert [(r.controller_id, r.medical_lives, r.pharmacy_lives, r.medical_total) for r in out] == [(1, 200, 10, 200)]
    current = spark.createDataFrame([(1, "a", day("1970-01-01"), day("2038-01-01")), (2, None, day("1970-01-01"), day("2038-01-01"))], "id int, v string, start_date timestamp_ntz, end_date timestamp_ntz")
    out = temporal.scd2_load(current, spark.createDataFrame([(2, None), (3, "c")], "id int, v string"), "id", ["v"], F.lit("2022-01-01").cast("timestamp_ntz"))
    assert sorted((r.id, str(r.start_date.date()), str(r.end_date.date())) for r in out.collect()) == [(1, "1970-01-01", "2022-01-01"), (2, "1970-01-01", "2038-01-01"), (3, "2022-01-01", "2038-01-01")]


def test_quarters(spark):
    told = {"in the 1st quarter of 2013": "2013-01-01", "Q4 2017 issue": "2017-10-01", "second quarter 2009": "2009-04-01", "quarterly": "None"}
    assert [str(one(spark, fn.quarter_start(F.lit(t)))) for t in told] == list(told.values())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fn.state_code(lit("list OR 7"))) == "OR" and one(spark, fn.state_code(lit("a_tx_b"))) == "TX" and one(spark, fn.state_code(lit("wander"))) is None
    assert one(spark, fn.state_name(lit("all of Rhode Island today"))) == "Rhode Island"
    assert one(spark, fn.year_part(lit("fees_2019_final.xlsx"))) == 2019
    assert one(spark, fn.month_part(lit("rate-11-new"))) == 11 and one(spark, fn.month_abbr(lit("by Aug at last"))) == "Aug"
    assert one(spark, fn.extension(lit("/a/b.PDF"))) == "pdf" and one(spark, fn.extension(lit("/a/b.pdf?x"))) == ""
    assert one(spark, fn.extension_of_type(lit("text/html; charset=utf-8"))) == "html"
    assert one(spark, fn.jaccard(F.array(lit("a"), lit("a")), F.array(lit("a")))) == 0.5
    when = lit("2020-01-01 12:00:00").cast("timestamp_ntz")
    assert [one(spark, fn.cron_matches(lit(c), when)) for c in ("* * * * *", "0 * * * 3", "0 12 * * *", "2 * * * 3", "x")] == [True, True, True, False, False]
    assert one(spark, fn.glob_match(lit("step 12 of (all)"), "step * of (all)")) == "12" and one(spark, fn.glob_match(lit("none"), "step *")) is None
    assert one(spark, fn.header_place(F.array(lit("Drug Name"), lit("Tier")), "tier")) == 1
    assert one(spark, fn.size_ratio(lit(0), lit(0))) == 1.0
    assert one(spark, doc_types.type_of(lit("2023 Drug-List for members"))) == "Formulary"
    got = one(spark, doc_types.classified({"link_text": lit("x"), "text": lit("the provider manual")}))
    assert (got.type, got.source, got.confidence) == ("Provider Guide", "text", 0.7)
    info = one(spark, files.metadata_map(lit("Title: a\n more\nPages: 3\nTitle: b")))
    assert info == {"Pages": "3", "Title": "b"}


def test_vectorized():
    assert vectorized.normal_form("Caf%C3%A9 &amp; Thé!") == "cafe the"
    text, title, links, base = vectorized.parsed_page('<html><head><title> T </title><base href="/b/"></head><body>a<script>x</script><p>b &amp; c<br></p><a href="d">e</a>')
    assert (text, title, links, base) == ("a b & c e", "T", ["d"], "/b/")
    assert vectorized.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert vectorized.jaro_winkler("abcdefgh", "abcxxxxx") == pytest.approx(0.583333, abs=1e-6)
    assert vectorized.token_set("a b c", "c b a d") == 100.0


def test_lineages(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    labels = lineage.component_labels(nodes, spark.createDataFrame([(1, 2), (2, 3), (6, 5)], "a long, b long"), "id")
    assert {r.id: r.lineage for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    chain = spark.createDataFrame([("A", 1, None), ("B", 1, "A"), ("C", 1, "B"), ("D", 2, None), ("E", 2, "D"), ("F", 2, "E")], "id string, lineage int, previous string")
    moved = lineage.insert_into_lineage(chain, spark.createDataFrame([("C", "F")], "id string, after string"), "id")
    out = {r.id: (r.lineage, r.previous, r.is_current) for r in lineage.current_versions(moved, "id").collect()}
    assert out["B"] == (1, "A", True) and out["C"] == (2, "F", True) and out["F"] == (2, "E", False)
    moved = lineage.insert_into_lineage(chain, spark.createDataFrame([("B", "D")], "id string, after string"), "id")
    assert {r.id: r.previous for r in moved.collect()} == {"A": None, "B": "D", "C": "A", "D": None, "E": "B", "F": "E"}


def test_long_chains_and_lineages_are_followed_to_their_ends(spark):
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 301)] + [(401, 402), (402, 403), (403, 401)], "id long, previous long")
    assert keys(views.ancestors(chain, chain.where("id = 300"), "id", "previous")) == list(range(1, 301))
    assert keys(views.ancestors(chain, chain.where("id IN (5, 250, 402)"), "id", "previous")) == [*range(1, 251), 401, 402, 403]
    path = [1, *range(160, 1, -1)]  # the least node beside the greatest, the others falling to the far end
    labels = lineage.component_labels(chain.where("id <= 160"), spark.createDataFrame(list(zip(path, path[1:])), "a long, b long"), "id")
    assert {r.lineage for r in labels.collect()} == {1}


def test_pairs_of_a_hot_token_meet_in_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr(lineage, "TILE", 5)
    rng = random.Random(3)
    rows = [(i, "en" if i % 5 else None, 100 + i % 7, ["hot", *(rng.choice("abcdefgh") for _ in range(rng.randrange(8)))] if i % 11 else None) for i in range(80)]
    rows.append((80, "en", 100, []))
    docs = spark.createDataFrame(rows, "id int, lang string, size int, tokens array<string>")
    sets = lineage.token_sets(docs, "id", "tokens", ["lang", "size"])
    out = {(r.a, r.b): r.score for r in lineage.scored_pairs(lineage.candidate_pairs(sets, "id", ["lang"], "size", 0.8), sets, "id").collect()}
    expected = {}
    for a, la, _, x in rows:
        for b, lb, _, y in rows:
            if a < b and la and la == lb and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > 0.8:
                expected[a, b] = len(set(x) & set(y)) / len(set(x) | set(y))
    assert {k: v for k, v in out.items() if v > 0.8} == pytest.approx(expected)


def test_areas_under_curves(spark):
    import random

    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(3000)]
    wins = sum((p > q) + 0.5 * (p == q) for lp, p in rows[:400] if lp for lq, q in rows[:400] if not lq)
    n = sum(label for label, _ in rows[:400])
    small = spark.createDataFrame([*rows[:400], (None, 0.5), (1, None)], "label int, score double")
    assert stats.auc(small, "label", "score").first().auc == pytest.approx(wins / (n * (400 - n)))
    assert stats.auc(small.where("label = 1"), "label", "score").first().auc is None
    assert stats.auc(small.limit(0), "label", "score").first().auc is None


def test_differences(spark):
    pages = [(1, [["a", "foot"], ["foot", "b"]]), (2, [["x"]]), (3, [["f", "f", "g", " "], ["f", "g", " "]]), (4, None), (5, []), (6, [["g"], []])]
    pages = spark.createDataFrame(pages, "id int, pages array<array<string>>")
    blanked = {r.id: r.text for r in diff.blank_footers(pages, "id", F.col("pages")).collect()}
    assert blanked == {1: "a\n    \f    \nb", 2: "x", 3: "f\nf\n \n \ff\n \n ", 4: None, 5: "", 6: "g\f"}
    texts = spark.createDataFrame([(1, "to be or not"), (2, "To be, to do"), (3, None)], "_doc int, text string")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 2, 3)], "id int, old int, new int")
    found = {(r.id, r.word, r.change) for r in diff.word_changes(diff.word_counts(texts, "_doc", F.col("text")), pairs, "id").collect()}
    assert found == {(7, "to", 1), (7, "do", 1), (7, "or", -1), (7, "not", -1), (8, "to", -2), (8, "be", -1), (8, "do", -1)}
    new = spark.createDataFrame([("c", 1), ("c", 1), ("c", 2), ("d", 1)], "code string, v int")
    old = spark.createDataFrame([("c", 1), ("c", 3), ("e", 1)], "code string, v int")
    assert {(r.code, r.status, r.n) for r in diff.row_delta(new, old, "code", ["code", "v"]).collect()} == {("c", "edit", 1), ("c", "add", 1), ("d", "add", 1), ("e", "remove", 1)}


def test_open_intervals_are_cut_no_further_than_points_go(spark):
    points = spark.createDataFrame([(1, "2020-03-05"), (1, "2019-01-01"), (2, "2020-01-01"), (None, "2020-01-01")], "k int, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    spans = spark.createDataFrame([(1, "a", "1970-01-01", "9999-01-01"), (1, "b", "2020-03-05", "2020-03-06"), (2, "c", "2021-01-01", "9999-01-01"), (2, "d", "2020-01-01", "2020-01-01")], "k int, n string, s string, e string")
    spans = spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("s", "e")})
    found = {(r["k"], str(r["d"].date()), r["n"]) for r in temporal.as_of_join(points, spans, "k", "d", "s", "e").collect()}
    assert found == {(1, "2020-03-05", "a"), (1, "2019-01-01", "a"), (1, "2020-03-05", "b")}
    assert temporal.as_of_join(points.limit(0), spans, "k", "d", "s", "e").count() == 0


@pytest.mark.parametrize("sent", [100_000, -1])
def test_terms_by_either_join(spark, monkeypatch, sent):
    monkeypatch.setattr(tagging, "BROADCAST_TERMS", sent)
    docs = spark.createDataFrame([(1, "Salt, no salt water; water no salt"), (2, None), (None, "water salt")], "id int, text string")
    terms = spark.createDataFrame([("s", "salt"), ("w", "Salt Water"), ("n", "no-salt"), ("x", "salt water fish"), ("s", "SALT")], "code string, term string")
    found = sorted((r.id or 0, r.code, r.at) for r in tagging.tag_terms(docs, "id", "text", terms).collect())
    assert found == [(0, "s", 1), (1, "n", 1), (1, "n", 5), (1, "s", 0), (1, "s", 2), (1, "s", 6), (1, "w", 2)]


def test_focus_does_not_depend_on_where_tags_are(spark):
    areas = spark.createDataFrame([(d, 100 * k, 100 * k + 60, k % 2 == 0) for d in range(20) for k in range(5)], "d int, at int, end int, is_key boolean")
    tags = spark.createDataFrame([(d, p, p + 5, f"t{p}", 0, "x") for d in range(20) for p in range(3, 500, 41)], "d int, at int, end int, text string, _p int, _kind string").drop("_p", "_kind")
    none = F.lit(None).cast("string")
    out = [tagging.focus_states(t, areas, "d", none, none, none) for t in (tags.coalesce(1), tags.repartition(7, "text"), tags.orderBy(F.rand(3)).repartition(3))]
    expected = {(d, p, p % 100 + 5 < 60 and (p // 100) % 2 == 0, p % 100 + 5 < 60) for d in range(20) for p in range(3, 500, 41)}
    for df in out:
        assert {(r["d"], r["at"], r["is_key"], r["focus"]) for r in df.collect()} == expected and df.count() == len(expected)
        assert "monotonically_increasing_id" not in df._jdf.queryExecution().toString()


def areas_of(text, start, end):
    """at, end and page of each area, one after another."""
    low, lowered, first = 0, text.lower(), True
    while True:
        if not start:
            begin = 0
        elif start == "\f" and first and not text.startswith("\f"):
            begin = 0
        else:
            found = lowered.find(start.lower(), low)
            if found < 0:
                return
            begin = found + len(start)
        stop = lowered.find(end.lower(), begin) if end else -1
        stop = stop if stop >= 0 else len(text)
        yield begin, stop, text[:begin].count("\f")
        low, first = stop, False
        if not start:
            return


def test_areas_between_separators(spark):
    rng = random.Random(8)
    texts = ["", "ab", "\fab\f", "A.b(E\\E)x"] + ["".join(rng.choice(["a", "B", "x", " ", "\f", ".", "(", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    configs = [("a", "b", True), ("A", None, False), ("\f", None, False), ("\f", "b", True), (None, "X", False), ("", "", True), ("(", ".", False), ("a", "a", False), (r"\E", ")", True), ("zz", "b", True)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None)], "id int, text string")
    rows = spark.createDataFrame([(i, *c) for i in [*range(len(texts)), 1000] for c in configs for _ in range(2)], "id int, start string, end string, is_key boolean")
    found = sorted((r["id"], r["is_key"], r["at"], r["end"], r["page"], r["key_text"] or "") for r in tagging.focus_areas(docs, "id", "text", rows).collect())
    expected = sorted((i, k, a, z, p, t[a:z] if k else "") for i, t in enumerate(texts) for s, e, k in configs for a, z, p in areas_of(t, s, e))
    assert found == expected
    one = tagging.focus_areas(docs, "id", "text", rows.where("start = 'a' AND end = 'b'")).where("id < 4").collect()
    assert [(r["id"], r["section_end"]) for r in sorted(one, key=lambda r: (r["id"], r["at"]))] == [(1, 2), (2, 4), (3, 9)]


def test_tags_are_paired_in_the_order_of_pages(spark):
    rng = random.Random(5)
    new, old = ([(rng.choice("abc"), rng.choice([None, 1, 1, 1, 2, 3])) for _ in range(60)] for _ in range(2))
    new += [("only", 1)]
    frame = lambda rows: spark.createDataFrame(rows, "code string, page int")
    found = {r["code"]: tuple(r)[1:] for r in diff.paired_tags(frame(new), frame(old), "code", "page").collect()}
    expected = {}
    for code in {c for c, _ in new + old}:
        a, b = (sorted((-1 if p is None else p) for c, p in rows if c == code) for rows in (new, old))
        expected[code] = (max(len(b) - len(a), 0), max(len(a) - len(b), 0), sum(x != y for x, y in zip(a, b, strict=False)))
    assert found == expected


def test_tags_and_sections(spark):
    docs = spark.createDataFrame([(1, "Take Foo bar, foo."), (2, None)], "id int, text string")
    terms = spark.createDataFrame([("a", "foo"), ("b", "Foo Bar"), ("c", "")], "code string, term string")
    assert {(r.id, r.code, r.at) for r in tagging.tag_terms(docs, "id", "text", terms).collect()} == {(1, "a", 1), (1, "b", 1), (1, "a", 3)}
    long = "one two three four five six seven eight nine"
    terms = spark.createDataFrame([("l", long), ("l", long.upper()), (None, "five")], "code string, term string")
    docs = spark.createDataFrame([(1, f"zero {long} ten"), (1, "five"), (None, "five")], "id int, text string")
    assert sorted(map(str, ((r.id, r.code, r.at) for r in tagging.tag_terms(docs, "id", "text", terms).collect()))) == ["(1, 'l', 1)", "(1, None, 0)", "(1, None, 5)", "(None, None, 0)"]
    assert tagging.tag_terms(docs, "id", "text", terms.limit(0)).count() == 0
    labels = spark.createDataFrame([("d1:2|55|Name",), ("d2|Other",), ("d3:1||N",), (None,)], "label string")
    out = [r.l for r in labels.select(tagging.therapy_label(F.col("label")).alias("l")).collect()]
    assert [tuple(x) for x in out] == [("d1", "55", "Name", 2), ("d2", None, "Other", 0), ("d3", None, "N", 1), (None, None, None, 0)]
    pages = spark.createDataFrame([(1, ["a Foo® bar", "the foo"], "see FOO here"), (2, None, None)], "id int, pages array<string>, link string")
    terms = spark.createDataFrame([("Foo", "x"), ("the", "y")], "term string, label string")
    found = tagging.tag_pages(pages, "id", F.col("pages"), terms, spark.createDataFrame([("The",)], "word string"))
    assert {(r.id, r.page, r.at, r.label) for r in found.collect()} == {(1, 0, 1, "x"), (1, 1, 1, "x")}
    assert [(r.id, r.page, r.term) for r in tagging.context_tags(found, pages, "id", "link").collect()] == [(1, -1, "Foo")]
    text = spark.createDataFrame([(1, "xxDrug aDRUG b")], "id int, text string")
    assert [(r.at, r.end) for r in tagging.sections(text, "id", "text", "drug").orderBy("at").collect()] == [(2, 8), (8, 14)]


def test_lifecycle(spark):
    now = F.lit("2023-01-01").cast("date")
    holds = lifecycle.hold_reasons(F.lit(0.2), F.lit(0.75), F.date_add(now, 700), F.lit(11), F.lit(0.9), now)
    assert one(spark, holds) == ["DOC_TYPE", "EFFECTIVE_DATE", "IDENTIFIED_DATES", "LINEAGE"]
    assert one(spark, lifecycle.assessed(F.lit("PENDING"), holds)) == "QUEUED" and one(spark, lifecycle.assessed(F.lit("APPROVED"), holds)) == "APPROVED"
    assert one(spark, lifecycle.overall(F.lit("APPROVED"), F.lit("PENDING"))) == "PENDING"
    review = lambda r: one(spark, lifecycle.needs_extraction_review(F.lit(0), F.lit(r), F.lit(0), F.lit(100)))
    assert review(100) and not review(4)
    tasks = spark.createDataFrame([(1, "IN_PROGRESS", 1), (2, "IN_PROGRESS", 5), (3, "CANCELING", 1)], "id int, status string, attempts int")
    assert {r.id: r.status for r in lifecycle.requeued(tasks).collect()} == {1: "QUEUED", 2: "FAILED", 3: "CANCELED"}


def test_extraction(spark):
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "start", "y", "end", "z"])], "id int, page int, text string")
    assert [r.page for r in extraction.page_window(pages, "id", "page", "text", "start", "end").orderBy("page").collect()] == [1, 2]
    rows = spark.createDataFrame([(1, 0, "A one"), (1, 1, "more"), (1, 2, "B two")], "id int, row int, text string")
    merged = extraction.merge_continued(rows, ["id"], "row", "text", F.col("text").rlike("^[A-Z] "))
    assert sorted((r.row, r.text) for r in merged.collect()) == [(0, "A one more"), (2, "B two")]
    spans = spark.createDataFrame([(1, 10.0, 5.0, "b"), (1, 10.9, 1.0, "a"), (1, 20.0, 1.0, "c")], "page int, y double, x double, text string")
    assert [(r.row, r.text) for r in files.layout_rows(spans, ["page"], "y", "x", "text").orderBy("row").collect()] == [(0, "a b"), (1, "c")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k|v\n1|x\\|y\n2|\n", encoding="latin-1")
    out = files.read_export(spark, str(tmp_path / "a.csv"), "k int, v string", sep="|").orderBy("k").collect()
    assert [(r.k, r.v) for r in out] == [(1, "x|y"), (2, None)] or out[0].k == 1
    (tmp_path / "t.txt").write_bytes("  é\n".encode("latin-1"))
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first().text.strip() == "é"
    texts = spark.createDataFrame([("a b",), ("ab",), ("c",)], "text string")
    store = files.add_texts(None, texts, "text")
    assert store.count() == 2 and files.add_texts(store, texts, "text").count() == 0


def test_statistics(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "y int, s double")
    assert stats.auc(scored, "y", "s").first().auc == pytest.approx(0.875)
    assert stats.best_f1(scored, "y", "s").first().f1 == pytest.approx(0.8)


def test_silent_tasks_are_told_once(spark, tmp_path):
    first = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:04:00")]
    second = [("a", "2024-01-01 00:08:00"), ("a", "2024-01-01 00:20:00")]
    schema = "task string, ts timestamp"
    for n, rows in enumerate((first, second, [("c", "2024-01-01 00:21:00")])):
        spark.createDataFrame(rows, "task string, ts string").select("task", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = heartbeats.hung_tasks(stream, "task", "ts").writeStream.format("memory").queryName("hung").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert "b" in {r.task for r in spark.table("hung").collect()}
