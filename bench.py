"""Time headline queries: one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tessera import catalogue  # noqa: E402

NAMES = ["tpch_q1", "tpch_q3", "tpch_q5", "tpch_q6", "tpch_q8", "tpch_q10", "tpch_q14", "tpch_q17", "tpch_q18", "join_multiway", "agg_distinct", "win_rank_family", "win_rows_frame", "win_groups", "topk_orders", "vec_knn", "fts_bm25", "cdc_diff", "ivm_join_delta"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in NAMES:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, best of two runs, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
