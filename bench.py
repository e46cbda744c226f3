"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ("tokens_pos", "normalize_width", "char_shape", "chunk_spans", "head_func", "chunk_features", "pair_features", "shift_reduce_links", "format_tree", "format_conll", "crf_features", "viterbi_bi", "eval_dep", "kernel_score", "pke_score", "flagship")


def main() -> None:
    from pyspark.sql import SparkSession

    from kakari.plans.queries import queries

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").write.format("noop").mode("overwrite").save()  # starts the JVM's readers
    took = {}
    for name in names:
        began = time.time()
        queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
