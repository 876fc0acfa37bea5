"""Benchmark: one medallion batch run, the query catalogue on stored Gold,
and the streaming job draining the event log.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is built and run to completion with the ``noop`` sink (full
evaluation, no driver collect): the median of three runs after a warm-up. The
batch run and the stream run once; the value is the sum of all timed steps.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "category_revenue", "batch_kpis", "monthly_revenue", "top_products", "promo_performance",
    "profit_by_location", "payment_split", "order_status_funnel", "ctx_kpis", "ctx_top_products",
    "stream_kpis", "orders_per_minute", "live_revenue_category", "top_viewed_products", "stock_direction",
    "history", "category_forecast", "forecast", "forecast_vs_actual", "low_stock_alerts", "cart_pricing",
    "promo_validation", "catalog_listing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tidemart.session import build_session, checkpoint_dir
    spark = build_session(f"local[{cpus}]", app="tidemart-bench", shuffle_partitions=max(8, cpus * 2))
    checkpoint_dir(spark)
    scratch = os.path.join(checkpoint_dir(spark), f"bench-{uuid.uuid4().hex[:8]}")
    timings: dict[str, float] = {}

    from tidemart import registry
    from tidemart.plans.batch_run import run_batch
    registry.load_marts()

    def median_of(run, n=3):
        """Median seconds of n runs after one warm-up; building included."""
        run()
        took = []
        for _ in range(n):
            t0 = time.time()
            run()
            took.append(time.time() - t0)
        return sorted(took)[n // 2]

    t0 = time.time()
    counts = run_batch(spark, sf_dir, os.path.join(scratch, "lake"))   # the default layout
    timings["medallion_batch_run"] = time.time() - t0

    registry.use_stored(sf_dir, os.path.join(scratch, "lake"))
    for name in HEADLINE:
        timings[name] = median_of(lambda n=name: registry.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    registry.use_stored(sf_dir, None)

    from tidemart.plans.wiring import raw_files
    from tidemart.streaming import runner
    raw_dir = raw_files(spark, sf_dir)
    t0 = time.time()
    runner.run_files_available_now(spark, raw_dir, os.path.join(scratch, "stream"),
                                   os.path.join(scratch, "stream-ck"), max_files_per_trigger=2)
    timings["stream_all_topics"] = time.time() - t0

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()},
        "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus,
        "rows": {"fact_sales": counts.get("gold/fact_sales"), "fact_sales_stream": counts.get("gold/fact_sales_stream"),
                 "raw_events": counts.get("bronze/kafka_raw_events")},
        "stream_events_per_sec": round((counts.get("bronze/kafka_raw_events") or 0) / timings["stream_all_topics"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
