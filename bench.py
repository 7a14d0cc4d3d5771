"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line {"metric", "value", "unit", "queries", "sf"}.

Every query is executed in full with the ``noop`` sink (all rows are
produced, none are collected).  A warm-up pass on the smallest data set
(JVM start, code generation) is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from custspark.plans import catalog  # noqa: E402
from custspark.session import get_spark  # noqa: E402

HEADLINE = [
    "customer_360", "preferred_department", "customer_rollup", "order_product_department",
    "dense_ids", "stratified_split", "numeric_profile", "iqr_outliers", "correlation_long",
    "frequent_itemsets", "association_rules", "reordered_baskets", "quality_report",
    "whatif_scenario", "whatif_findings", "segment_stats", "eco_strength", "roc_auc",
    "classification_report", "audit_filtered", "kmeans_segments", "top_drivers",
]


def run_one(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    catalog.load_all()
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for n in ("customer_360", "association_rules"):
            run_one(spark, n, warm_dir)
    times = {}
    for n in names:
        times[n] = round(run_one(spark, n, sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
