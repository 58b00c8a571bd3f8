"""Templates with nested parts, and dates as rows, on small frames."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.errors import AnalysisException

from docloom.functions import date_rows
from docloom.functions.dates import LABELS, extract_dates
from docloom.operators.templates import Lookup, Part, Template, Value, rendered


def test_every_kind_of_part(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "d long, _n string")
    facts = spark.createDataFrame([(1, "b", "2020-02-03", "u|<v>|", 2), (1, "a", "no day", None, 1), (3, "c", None, "w", 1), (None, "e", None, None, 1)], "d long, name string, day string, many string, n int")
    codes = spark.createDataFrame([("a", "Alpha & Co"), ("b", None)], "code string, told string")
    values = (("Name", Value("name")), ("Day", Value("day", "date")), ("Many", Value("many", "list")))
    parts = (
        Part("First", "facts", "values", (("Day", Value("day", "date", "on ")),), ("n",), single=True),
        Part("List", "facts", "list", (("Code", Value("name")), ("Told", Value("told"))), ("n",), (Lookup("codes", "name", "code"),)),
        Part("Table", "facts", "table", values, ("n",)),
        Part("Groups", "facts", "group", (("N", Value("n")),), ("n",), by="many"),
    )
    found = {r["d"]: r["html"] for r in rendered(docs, "d", Template(parts), {"facts": facts, "codes": codes}).collect()}
    assert found[2] == "<html><body>" + "".join(f"<h2>{p.title}</h2><p>N/A</p>" for p in parts) + "</body></html>"
    assert found[1] == (
        "<html><body><h2>First</h2><p>on N/A</p>"
        "<h2>List</h2><ul><li>a - Alpha &amp; Co</li><li>b - N/A</li></ul>"
        "<h2>Table</h2><table><thead><tr><th>Name</th><th>Day</th><th>Many</th></tr></thead><tbody>"
        "<tr><td>a</td><td>N/A</td><td>N/A</td></tr><tr><td>b</td><td>02/03/2020</td><td><ul><li>u</li><li>&lt;v&gt;</li></ul></td></tr></tbody></table>"
        "<h2>Groups</h2><h3>N/A</h3><table><thead><tr><th>N</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>"
        "<h3>u|&lt;v&gt;|</h3><table><thead><tr><th>N</th></tr></thead><tbody><tr><td>2</td></tr></tbody></table></body></html>"
    )
    assert set(found) == {1, 2}
    assert rendered(docs.limit(0), "d", Template(parts), {"facts": facts, "codes": codes}).count() == 0


def test_dates_as_rows_are_those_of_the_struct(spark):
    date_rows.register(spark)
    texts = ["revised 4/13/2016 and expires 5/6/2017", None, "", "two dates 1/2/2015, 3/4/2016"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {tuple(r) for r in spark.sql("SELECT k, label, day FROM {rows}, LATERAL labelled_dates(t, '2019-09-30')", rows=rows).collect()}
    expected = set()
    for k, t in enumerate(texts):
        own = extract_dates(t or "", date(2019, 9, 30))
        expected |= {(k, label, own[label]) for label in LABELS if own[label]} | {(k, "identified", d) for d in own["identified_dates"]}
    assert found == expected and (0, "end_date", date(2017, 5, 6)) in found
    wide = spark.sql("SELECT * FROM {rows}, LATERAL labelled_dates(t, '2019-09-30', true)", rows=rows)
    assert wide.columns == ["k", "t", *LABELS] and wide.count() == len(texts)
    assert wide.where("k = 0").first()["last_updated_date"] == date(2016, 4, 13)


def test_the_day_is_a_constant(spark):
    date_rows.register(spark)
    with pytest.raises(AnalysisException, match="constant"):
        spark.sql("SELECT * FROM VALUES ('a', '2019-01-01') AS v(t, d), LATERAL labelled_dates(t, d)").collect()
