"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and print one JSON line.

Each query is executed fully with the ``noop`` sink (no collect to the
driver); the reported time per query is the best of ``$BENCH_REPEAT``
runs (default 1) after one warm-up query.  ``value`` is the sum.  Times are
written to stderr as they come; a query that takes over ``$BENCH_LIMIT`` seconds
(default 120) is stopped and counts with that time, listed in ``timed_out``.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m2_training_set",          # J1 + J2 as-of + P3 + A4 + A5
    "j2_asof_metrics",
    "a4_features_hourly",
    "a7_latency_histogram",
    "a10_error_pct",
    "a16_histogram_p95",
    "j6_logs_spans",
    "j8_service_edges",
    "w1_smooth_cpu",
    "w3_success_rate_at_samples",
    "w5_inflight_at_arrival",
    "w6_cpu_gauge_ticks",
    "w7_uptime",
    "w8_global_index",
    "w9_breaker_intervals",
    "r2_weighted_round_robin",
    "r3_least_connections",
    "r5_model_pick",
    "m10_decision_snapshots",
    "s5_parse_logs",
    "s9_upsert_servers",
    "q2_duration_p95_by_server",
    "q4_active_connections",
]


class Limit(Exception):
    pass


def _stop(*_) -> None:
    raise Limit


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE

    from reqlens.plans import catalog
    from reqlens.session import get_session

    spark = get_session(f"local[{cpus}]", app="reqlens-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    catalog.run(spark, sf_dir, "a6_requests_total").write.format("noop").mode("overwrite").save()  # warm-up

    limit = float(os.environ.get("BENCH_LIMIT", "120"))
    signal.signal(signal.SIGALRM, _stop)
    times, late = {}, []
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            signal.setitimer(signal.ITIMER_REAL, limit)
            try:
                catalog.run(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
            except Limit:
                spark.sparkContext.cancelAllJobs()
                late.append(name)
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, **({"timed_out": late} if late else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
