"""Seconds of the headline queries; one line of JSON. BENCH_SF_DIR and BENCH_CPUS say where and on how many cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from questrel.plans import catalog  # noqa: E402

HEADLINE = [
    "discover_new_items", "dedup_anti_known", "dedup_bitmap", "dedup_bitmap_filter", "items_insert_ignore", "items_upsert_results", "items_lifecycle",
    "nassign_n1", "nassign_n_divides_w", "nassign_fold", "nassign_uneven", "nassign_quota", "session_ttl_split", "deliver_batch", "ack_results",
    "results_union", "rate_limit", "microbatch_metrics", "token_mac", "token_auth_ladder", "cache_ttl_lru", "stream_discover", "stream_results", "stream_nassign",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["discover_new_items"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    took, rows = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    for name in ("nassign_n1", "nassign_uneven"):
        rows[name] = catalog.QUERIES[name](spark, sf_dir).count()
    rate = {f"{n}_assignments_per_sec": round(rows[n] / took[n]) for n in rows}
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name, "cpus": int(cpus)} | rate))


if __name__ == "__main__":
    main()
