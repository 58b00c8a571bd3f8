"""Extracted tables, focus of tags, templates and cleaned pages on small frames."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.functions import vectorized
from docloom.operators import extraction as ex
from docloom.operators import tagging

ROWS = "t long, row int, cells array<string>"


def test_tables_by_header(spark):
    rows = [(1, 0, ["Title"]), (1, 1, ["Drug Name", "Tier", None]), (1, 2, ["start"]), (1, 3, ["a", "1", "x"]), (1, 4, ["", "more", "y"]), (1, 5, ["b", "2"]), (1, 6, ["The END", ""]), (1, 7, ["c", "3"])]
    rows += [(2, 0, ["x"]), (2, 1, ["Phone", "Tier"]), (2, 2, ["a", "b"]), (3, 0, ["only"])]
    found = ex.with_header(spark.createDataFrame(rows, ROWS), ["t"], "row", "cells", skip=1)
    assert {r.t for r in found.collect()} == {1, 2}
    kept = ex.wanted_tables(found, required="drug", excluded="phone")
    kept = ex.between_texts(kept, ["t"], "row", "cells", start="start", end="the end").where("row > 2")
    assert [r.row for r in kept.orderBy("row").collect()] == [3, 4, 5]
    up = ex.merged_rows(kept, ["t"], "row", "cells", "drug").orderBy("row").collect()
    assert [(r.row, r.cells) for r in up] == [(3, ["a", "1 more", "x y"]), (5, ["b", "2"])]
    down = ex.merged_rows(kept, ["t"], "row", "cells", "drug", down=True).orderBy("row").collect()
    assert [(r.row, r.cells) for r in down] == [(3, ["a", "1", "x"]), (5, ["b", "more 2", "y"])]
    assert [r.c for r in kept.orderBy("row").select(ex.cell_of("cells", "TIER").alias("c")).collect()] == ["1", "more", "2"]
    assert ex.merged_rows(kept.limit(0), ["t"], "row", "cells", "drug").count() == 0


def test_codes_fan_out(spark):
    rows = [(1, ["b"], ["g", "h"], None), (2, ["b"], ["g"], "brand"), (3, ["b"], ["g"], "Generic"), (4, [], None, "both"), (5, ["b"], [], "generic")]
    df = spark.createDataFrame(rows, "k int, brands array<string>, generics array<string>, kind string")
    out = sorted((r.k, r.code or "") for r in ex.fanned_out(df, "brands", "generics", F.col("kind")).collect())
    assert out == [(1, "b"), (1, "g"), (1, "h"), (2, "b"), (3, "g"), (4, "")]


def test_focus_equals_comparison_with_every_area(spark):
    rng = random.Random(4)
    areas, tags = [], []
    for doc in range(5):
        for is_key in (True, False):
            at = 0
            while at < 300:
                at += rng.randrange(1, 40)
                end = at + rng.randrange(5, 60)
                areas.append((doc, at, end, is_key))
                at = end
        for _ in range(40):
            at = rng.randrange(320)
            tags.append((doc, at, at + rng.randrange(1, 20), rng.choice(["Url", "link", "none", "x"])))
    types = {0: "Formulary"}
    docs = spark.createDataFrame([(d, types.get(d), "a LINK here" if d % 2 else None, "http://url/x" if d > 2 else "") for d in range(5)], "d long, type string, link string, url string")
    own = spark.createDataFrame(tags, "d long, at int, end int, text string").join(docs, "d")
    out = tagging.focus_states(own, spark.createDataFrame(areas, "d long, at int, end int, is_key boolean"), "d", F.col("type"), F.col("link"), F.col("url")).collect()
    assert len(out) == len(tags)
    for r in out:
        def inside(kind, r=r):
            before = [a for a in areas if a[0] == r.d and a[3] == kind and a[1] <= r.at]
            return bool(before) and r.end < max(before, key=lambda a: a[1])[2]

        link, url = r.text.lower() in (r.link or "").lower(), r.text.lower() in r.url.lower()
        assert (r.is_key, r.in_link, r.in_url) == (inside(True), link, url)
        assert r.focus == (inside(True) or inside(False) or r.d == 0 or link or url)


def test_templates(spark):
    rows = [(1, 2, "B", "list", "x|y<"), (1, 1, "A & a", "text", "one"), (1, 3, "C", "date", "2020-01-31 00:00:00"), (1, 4, "D", "text", " "), (2, 1, "E", "date", "never")]
    out = {r.d: r.html for r in ex.rendered(spark.createDataFrame(rows, "d int, n int, title string, kind string, value string"), "d", ["n"], "title", "kind", "value").collect()}
    assert out == {1: "<html><body><h2>A &amp; a</h2><p>one</p><h2>B</h2><ul><li>x</li><li>y&lt;</li></ul><h2>C</h2><p>01/31/2020</p></body></html>"}


def test_pages_are_cleaned():
    page = '<div id="a"><p class="x y">gone <b>too</b></p>kept &amp; <br>here</div>'
    assert vectorized.clean_page(page, [("p", "class", "x")], "f<1") == '<html><body><b>Code: f&lt;1</b><div id="a">kept &amp; <br>here</div></body></html>'
    assert vectorized.clean_page("<html><p>x</p></html>", [("p", "id", None)]) == "<html><body><p>x</p></body></html>"
    assert vectorized.clean_page("<html><body>x</body></html>", []) == "<html><body>x</body></html>"
    assert vectorized.plain_text("<html><head><title>t</title></head><body> a<script>x<y</script>&lt;b <!-- c --><p>d</body>") == " a<b d"
