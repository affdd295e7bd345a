"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written in full to the ``noop`` sink.  A query runs once as warm-up and is
then timed three times (the median counts); one whose warm-up takes over 20 seconds is
not repeated and its first time counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from concordis.plans.catalog import QUERIES  # noqa: E402
from concordis.session import build_session  # noqa: E402

HEADLINE = (
    "i3_record_hash", "t3_word_tokens", "r6_page_model_results", "p4_resume_worklist", "p6_running_balances",
    "g9_references", "v9_impossible_sequence", "e2_edit_counts", "e9_consensus_entropy", "e10_fused_text", "c1_scores",
)


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds = {}
    for name in names:
        run = lambda: QUERIES[name](spark, folder)
        first = timed(run)
        seconds[name] = round(first if first > 20 else statistics.median(timed(run) for _ in range(3)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
