"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: each once cold, then the median of three; prints one JSON line with both."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINES = ["d7_finding_detail", "d1_count_over", "d8_near", "c21_ioc", "r7_rule_pack", "e2_dedupe_alerts", "g3_ancestors", "h4_verify_chain", "f1_search", "f2_page", "g4_process_tree"]
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from sentrylake.plans import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    took, cold = {}, {}
    for name in HEADLINES:
        each = []
        for _ in range(RUNS + 1):
            began = time.time()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name], cold[name] = round(median(each[1:]), 3), round(each[0], 3)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    rates = {k: round(events / v) for k, v in took.items()}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "events_per_s": rates, "cold": cold, "cold_total": round(sum(cold.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
