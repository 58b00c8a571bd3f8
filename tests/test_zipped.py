"""Archives of delimited files, read by as many tasks as they have members."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import zipped


@pytest.fixture
def archives(spark, tmp_path):
    zipped.register(spark)
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"a{n}.zip", "w") as out:
            for m in range(3):
                lines = [f"{n}{m}{i}|caf\xe9 {i}\\|x|" for i in range(5000 if (n, m) == (0, 0) else 4)]
                out.writestr(f"in/t{m}.txt", "\n".join(["code|name|none", *lines]).encode("latin-1"))
            out.writestr("more.csv", "code,price\n1,2.50\n\"x,\ny\",\n7\n")
            out.writestr("empty.csv", "")
    return tmp_path


def test_members_are_tasks(spark, archives):
    df = spark.read.format("zipped_tables").option("members", "in/*.txt").option("sep", "|").option("escape", "\\").option("encoding", "latin-1").load(f"{archives}/*.zip")
    assert df.columns == ["code", "name", "none", "archive", "member"]
    assert df.rdd.getNumPartitions() == 6 and df.count() == 5000 + 5 * 4
    row = df.where("code = '123'").first()
    assert (row["name"], row["none"], row["member"]) == ("caf\xe9 3|x", None, "in/t2.txt") and row["archive"].endswith("a1.zip")
    assert {r["member"]: r["count"] for r in df.groupBy("member").count().collect()} == {"in/t0.txt": 5004, "in/t1.txt": 8, "in/t2.txt": 8}


def test_conditions_on_members_leave_the_others_closed(spark, archives):
    df = spark.read.format("zipped_tables").option("members", "in/*").option("sep", "|").option("escape", "\\").option("encoding", "latin-1").load(f"{archives}/*.zip")
    one = df.where(F.col("member") == "in/t1.txt")
    assert one.rdd.getNumPartitions() == 2 and one.count() == 8


def test_headers_quotes_and_given_columns(spark, archives):
    read = spark.read.format("zipped_tables").option("members", "*.csv")
    found = read.load(f"{archives}/a0.zip")
    assert found.columns == ["code", "price", "archive", "member"]
    assert sorted((r["code"], r["price"] or "") for r in found.collect()) == [("1", "2.50"), ("7", ""), ("x,\ny", "")]
    assert sorted(map(tuple, read.schema("price string, other string").load(f"{archives}/a0.zip").collect()), key=str) == sorted([("2.50", None), (None, None), (None, None)], key=str)
    with pytest.raises(Exception, match="no member"):
        spark.read.format("zipped_tables").option("members", "*.xml").load(f"{archives}/a0.zip").count()
