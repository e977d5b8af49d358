"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from presentia.queries import evaluation, galleries, ingest, serving

HEADLINE = {
    "d8_evaluate": evaluation.d8_evaluate,
    "d4_roc": evaluation.d4_roc,
    "d9_evaluate_test": evaluation.d9_evaluate_test,
    "c1_identify": galleries.c1_identify,
    "c2_pair_similarities": galleries.c2_pair_similarities,
    "d18_calibrate_threshold": galleries.d18_calibrate_threshold,
    "e2_group_split": ingest.e2_group_split,
    "k1_quarantine": ingest.k1_quarantine,
    "d22_nms": serving.d22_nms,
    "c3_recognize": serving.c3_recognize,
    "d19_latency_stats": serving.d19_latency_stats,
    "e3_score_history": serving.e3_score_history,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in HEADLINE.items():
        query(spark, sf).write.format("noop").mode("overwrite").save()  # code is compiled, files are cached
        began = time.time()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, second run", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
