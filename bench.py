"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs in
full into Spark's ``noop`` sink, once to warm up and then ``BENCH_RUNS`` times; the
median counts. ``--all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from obsframe.catalog import QUERIES
from obsframe.session import build_session

HEADLINE = [
    "sum_increase_by_code", "increase_by_series", "interval_rollup", "latest_sample", "target_up",
    "log_access_query", "log_troubleshoot", "tail_per_key", "route_match",
    "service_edges", "span_self_time", "span_performance", "trace_timeline",
    "turn_pairs", "prompt_payload", "agent_state_fold", "state_as_of", "idle_sessions", "pool_sessions",
    "rate_limit_by_key", "prompt_cache", "probe_state", "claims_audit",
    "benchmark_rollup", "duration_leaderboard", "validate_benchmark",
    "epoch_shuffle", "worker_shard", "build_vocab", "encode_fixed", "epoch_loss",
    "src_exposition", "src_md_matrix", "stream_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    seconds, failed = {}, {}
    for name in names:
        times = []
        try:
            for _ in range(runs + 1):
                start = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
        except Exception as error:  # the other queries are still timed
            failed[name] = f"{type(error).__name__}: {error}"[:200]
            continue
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "failed": failed, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
