"""Functions on pages and texts against plainer ones on the same tables, and updates and searches on odd rows."""

from __future__ import annotations

import html
import re
import string
import unicodedata
from urllib.parse import unquote, urljoin

import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.operators import search, updates
from docloom.session import table

SF = "/root/testdata/sf0.001"


def test_normal_forms_of_texts(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in catalog.QUERIES["normalize_string"](spark, SF).collect():
        letters = [c for c in unicodedata.normalize("NFKD", texts[r.doc_id]) if c in string.printable or ord(c) < 128]
        assert r.ascii == "".join(letters)
        plain = unicodedata.normalize("NFKD", unquote(html.unescape(texts[r.doc_id])))
        kept = "".join(c.lower() if c in string.ascii_letters + string.digits else " " for c in plain if ord(c) < 128)
        assert r.normal == " ".join(kept.split())


def test_texts_and_links_of_pages(spark):
    pages = {r.page_id: (r.url, r.html) for r in table(spark, SF, "pages").collect()}
    found = {}
    for r in catalog.QUERIES["html_text"](spark, SF).collect():
        found.setdefault(r.page_id, (r.text, r.title, []))[2].append(r.link)
    for page, (url, source) in pages.items():
        seen = re.sub(r"(?s)<!--.*?-->", "", source)
        title = " ".join(t.strip() for t in re.findall(r"(?is)<title>(.*?)</title>", seen))
        hrefs = re.findall(r"""(?is)<a\s[^>]*?href=["']([^"']+)["']""", re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1>", "", seen))
        body = re.sub(r"(?is)<(script|style|noscript|template|head|title)\b.*?</\1>", "<x>", seen)
        pieces = [html.unescape(p).strip() for p in re.split(r"(?s)<[^>]*>", body)]
        assert found[page][0] == " ".join(p for p in pieces if p)
        assert found[page][1] == html.unescape(title)
        assert sorted(x for x in found[page][2] if x) == sorted(urljoin(url, html.unescape(h)) for h in hrefs)


def test_updates_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (2, 5, ["x"], None), (3, None, ["x", None, "y"], "b")], "k int, n int, tags array<string>, s string")
    out = updates.update(df, F.col("s") == "a", {"n": updates.increased(F.lit(2)), "tags": updates.pushed(F.lit("z"))})
    assert [(r.n, r.tags) for r in out.orderBy("k").collect()] == [(2, ["z"]), (5, ["x"]), (None, ["x", None, "y"])]
    out = updates.update(df, F.lit(True), {"tags": updates.added(F.lit("x")), "n": updates.greatest(F.lit(3)), "s": updates.unset()})
    assert [(r.n, r.tags, r.s) for r in out.orderBy("k").collect()] == [(3, ["x"], None), (5, ["x"], None), (3, ["x", None, "y"], None)]
    out = updates.update(df, F.lit(True), {"tags": updates.pulled(lambda x: x == "x")})
    assert [r.tags for r in out.orderBy("k").collect()] == [None, [], [None, "y"]]
    assert updates.update(df.limit(0), F.lit(True), {"n": updates.least(F.lit(1))}).count() == 0
    assert updates.without_references(df, "n", spark.createDataFrame([(5,), (5,), (None,)], "g int"), "g").where("n IS NULL").count() == 3
    done, told = updates.bulk_update(df, spark.createDataFrame([(1, 9), (2, 8), (4, 7)], "k int, n int"), "k", "n", F.col("s") == "a")
    assert [r.n for r in done.orderBy("k").collect()] == [9, 5, None]
    assert {r.k: r.result for r in told.collect()} == {1: "ok", 2: "refused", 4: "missing"}


def test_searches_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "Ab", "http://x"), (2, None, None), (3, "abc", "HTTPS://y")], "k int, name string, url string")
    assert [r.k for r in search.find(df, "AB", "k", "name").collect()] == [1, 3]
    assert [r.k for r in search.find(df, "2", "k", "name").collect()] == [2] and search.find(df, "http://x", "k", "name", "url").count() == 1
    assert [r.w for r in df.orderBy("k").select(search.is_web_url(F.col("url")).alias("w")).collect()] == [True, False, True]
    assert search.shown_filters([{"name": "n", "operator": "eq", "value": 0}, {"name": "n", "operator": "eq", "value": None}])[0].value == 0
    nested = spark.createDataFrame([(1, ([("p", 1)], "q")), (2, None)], "k int, s struct<l:array<struct<a:string,b:int>>,c:string>")
    out = search.project(nested, ["k", "s.l.a"]).orderBy("k").collect()
    assert out[0].s.l[0].asDict() == {"a": "p"} and out[1].s is None
    assert search.without_fields(nested, ["s.c"]).schema["s"].dataType.fieldNames() == ["l"]
    with pytest.raises(KeyError):
        search.shown_filters([{"operator": "eq", "value": 1}])
