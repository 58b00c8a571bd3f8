"""The language of texts that the profiles have not seen, and of odd ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import language_profiles as lp
from docloom.session import checkpointed, table


def test_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("lang IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    known = checkpointed(lp.profiles(docs.where(~held), "lang", "text"))
    told = lp.detected(docs.where(held), "doc_id", "text", known).where("lang IS NOT NULL")
    pairs = told.join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").select("lang", "own").collect()
    assert len(pairs) > 50 and sum(a == b for a, b in pairs) / len(pairs) > 0.9


def test_odd_texts(spark):
    docs = spark.createDataFrame([("a", "the thing"), ("b", "zzz xyz"), (None, "qqq")], "lang string, text string")
    known = checkpointed(lp.profiles(docs, "lang", "text"))
    assert known.where("lang = 'b'").orderBy("rank").first()["gram"] == "z"
    rows = [(1, "THE thing!"), (2, None), (3, ""), (4, "12 - 3"), (5, "zz"), (6, "дом"), (None, "xyz zz"), (7, "thing " * 30_000)]
    found = {r["k"]: r["lang"] for r in lp.detected(spark.createDataFrame([(*r, 0, "x") for r in rows], "k int, text string, rank int, gram string"), "k", "text", known).collect()}
    assert found == {1: "a", 2: None, 3: None, 4: None, 5: "b", 6: None, None: "b", 7: "a"}
    assert lp.detected(docs.limit(0), "lang", "text", known).count() == 0
