"""Time the headline queries.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from punctual.queries import QUERIES

HEADLINE = [
    "prev_period_features", "prev_period_rows", "asof_backward_tolerance", "asof_two_sided", "prior_mean_features",
    "prior_count_in_hour", "previous_leg", "modeling_table", "feature_frame", "rate_by_hour", "top_origins_by_volume",
    "temporal_split_counts", "temporal_folds_counts", "quality_report", "dataset_summary", "exact_quantiles",
    "pairwise_corr", "dedupe_keep_first", "clean_obs", "local_to_utc", "resolve_entities", "roc_auc_exact",
    "average_precision_exact", "threshold_sweep", "calibration_bins", "binned_mi", "prompt_texts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("punctual-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
