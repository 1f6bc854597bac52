"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = (
    "retained_spans_error", "detect_first_reason_per_span", "first_reason_per_trace", "decisions", "cross_instance_retained", "detect_order_lines", "order_trace_verdicts",
    "policy_cmp", "baggage_parse", "segments_by_bytes", "watermark_sacrifice", "retained_by_segment", "chain_counters", "age_ratio_histogram",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from emberline.plans import catalogue

    spans = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        best = float("inf")
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    flagship = times.get(HEADLINE[0])
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "flagship_spans_per_s": round(spans / flagship) if flagship else None, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
