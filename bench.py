"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Groups follow the read path's budgets: lookups, paged lists and range scans; then imports and
quality reports. Each query runs once to warm up and is then timed; results go to a noop sink, so
all rows are computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from marquee.plans import catalog

QUERIES = [
    "event_detail", "search_upcoming_default", "search_by_genre", "search_all_facets", "search_sort_price_desc", "search_page_meta", "calendar_window",
    "agg02_quality_report", "quality_rollup", "coverage_baseline", "upsert_dedup", "stale_rows", "upsert_table", "association_diff_artists", "check_suspicious",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_sec", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
