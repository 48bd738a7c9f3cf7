"""Benchmark the headline queries; prints one JSON line.

``BENCH_RUNS`` (default 3) timed runs; each run forces the full result with a
``noop`` write.  Data: ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "station_availability",
    "trip_history",
    "dashboard_kpis",
    "recent_logs",
    "dq_fk",
    "wallet_topups",
    "cancel_trips",
    "audit_cancel_trips",
    "purchase_memberships",
    "report_and_assign",
    "book_rides",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    os.environ.setdefault("RIDEGRID_DRIVER_MEMORY", "16g")

    from ridegrid.plans.registry import queries
    from ridegrid.session import cleanup, get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for key in only or HEADLINE:
        fn = qs[key]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up
        timings[key] = round(statistics.median(once() for _ in range(runs)), 3)
        rows[key] = fn(spark, sf_dir).count()
        cleanup(spark)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "runs": runs,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
