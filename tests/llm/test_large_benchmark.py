"""Operator 1 with benchmarks that are too large to be sent to every task."""

from __future__ import annotations

from docloom.llm import decontaminate
from docloom.llm.base import table

SF = "/root/testdata/sf0.001"


def test_bitmaps_and_shuffles_find_what_broadcasts_do(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    sent = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sent and sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == sent
        monkeypatch.setattr(decontaminate, "BITMAP_TOKENS", 0)
        assert sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bitmaps_pass_every_key_and_few_others(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) AS k")
    bits = decontaminate.ROW_BITS
    bitmap = decontaminate._bitmap(keys, "k", bits)
    assert decontaminate._possible(keys, "k", bitmap, bits).count() == 2000
    others = spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS k", "id")
    passed = decontaminate._possible(others, "k", bitmap, bits)
    assert passed.columns == ["k", "id"] and passed.count() < 20_000 / 10
