"""Times the headline queries on the tables at $BENCH_SF_DIR and prints one JSON line: seconds by query, the median of warm runs."""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from docloom import catalog
from docloom.session import local_session

#: The queries that stand for the library's kinds of work.
HEADLINE = (
    "site_doc_table", "flt_any_element", "flt_text", "doc_view_denorm", "version_self_join", "lives_by_controller", "asof_range_join",
    "scd2_load", "daily_stats", "dup_checksum", "page_stats", "word_diff", "term_tagging", "footer_blank", "jaccard_pairs",
    "tag_compare_status", "extraction_delta", "extract_dates", "html_text",
)
WARM_RUNS = int(os.environ.get("BENCH_WARM_RUNS", "3"))


def timed(run, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")), shuffle_partitions=8, memory=os.environ.get("BENCH_MEMORY", "8g"))
    seconds = {}
    for name in HEADLINE:
        timed(catalog.QUERIES[name], spark, sf_dir)  # compiles
        seconds[name] = round(median(timed(catalog.QUERIES[name], spark, sf_dir) for _ in range(WARM_RUNS)), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
