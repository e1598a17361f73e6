"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from orderloom import session
from orderloom.plans import registry

HEADLINES = (
    "otr_profile", "volume_profile", "spread_profile", "depth_profile", "contract_stats", "product_stats_daily", "front_month_volume", "cross_market_summary",
    "ofi_buckets_nearest", "ofi_ic_daily", "volume_bars", "vpin_range", "modify_reconstitution", "delete_resolution", "validate_structural", "mbp1_rebuild",
    "unique_key_match", "spread_percentiles", "fingerprint_metrics", "log_fit",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", "bench", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
