"""Time the headline queries: one first run each, then the median of three.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Each query runs whole into the noop sink; queries that load
tables or files write them anew on every run.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from ratelake.plans.queries import registered

HEADLINE = (
    "clean_rates",
    "flatten_documents",
    "cdc_changes",
    "merge_snapshot",
    "rolling_metrics",
    "anomaly_flags",
    "monthly_summary",
    "coverage_report",
    "coverage_by_pair",
    "converted_transactions",
    "change_events",
    "load_merge_cdc",
    "two_batches_enriched",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    scratch = tempfile.mkdtemp(prefix="ratelake-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ratelake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    queries = registered()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first, median = {}, {}
    for name in names:
        first[name] = round(run(name), 3)
        # The table-loading queries are measured once more; the others three times.
        times = [run(name) for _ in range(1 if name.startswith("two_batches") else repeats)]
        median[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the median query times",
                "value": round(sum(median.values()), 3),
                "unit": "sec",
                "queries": median,
                "first_run": first,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
