"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "dct_high_frequency_ratio", "dct_region_energy", "region_channel_stats", "region_entropy16", "histogram50", "moments_kurtosis", "gradient4", "local_var3x3", "sobel_mag", "gradient_nms",
    "wavelet97_level", "flood_fill", "iou_pairs", "nms_keep", "single_face_gate", "best_detection", "first_feasible", "rules_join_gate", "ledger_closure", "ledger_full_join", "payload_by_subband",
    "prefix_intervals", "rd_hull", "lambda_argmax", "json_extract", "corpus_expectation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from portrel import catalog

    plans = catalog.queries()
    plans["region_channel_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
