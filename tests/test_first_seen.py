"""New urls and contents of a stream, in several orders of batches and over a restart, against the batch operator."""

from __future__ import annotations

import random
import time

import pytest

from docloom.operators.lifecycle import first_seen
from docloom.streaming.first_seen import first_seen_stream, once

SCHEMA = "page_id long, u string, h string, extra string"


def run(spark, path, days=None):
    """Reads what is in the input folder and has not been read, a file in a batch."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    told = first_seen_stream(stream, "u", "h", "page_id", days)
    trigger = {"availableNow": True} if days is None else {"once": True}  # with timeouts there is always one more batch
    query = told.writeStream.foreachBatch(lambda df, n: once(df, "page_id").write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(**trigger).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_tell_what_the_batch_does(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randrange(25)}", f"h{rng.randrange(25)}", "x") for i in range(90)]
    rng.shuffle(rows)
    parts = [rows[i : i + 30] for i in range(0, 90, 30)]
    for i, part in enumerate(parts):
        put(spark, tmp_path, part)
        if i:  # the first two batches in one run, the last after a restart from the checkpoint
            run(spark, tmp_path)
    found = sorted(r["page_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # as the batch operator, in order of batches and then of ids
    ordered = spark.createDataFrame([(1000 * i + r[0], *r) for i, part in enumerate(parts) for r in part], f"o long, {SCHEMA}")
    assert found == sorted(r["page_id"] for r in first_seen(ordered, "u", "h", "o").collect())


def test_states_expire(spark, tmp_path):
    put(spark, tmp_path, [(1, "u", "h", "x"), (2, None, None, "x")])
    run(spark, tmp_path, days=2 / 86_400)
    time.sleep(3)
    put(spark, tmp_path, [(3, "u", "h", "x")])
    run(spark, tmp_path, days=2 / 86_400)
    assert sorted(r["page_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3]
