"""Headline queries on one table set; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = {
    "scan_filter": "filter_expr",
    "range_filter": "filter_lte",
    "regex_scan": "filter_bare_regex",
    "group_sum_avg": "acc_avg",
    "flagship_join_group": "flagship",
    "lookup_equality": "lookup_equality",
    "lookup_correlated": "lookup_correlated",
    "sort_limit": "stage_sort_skip_limit",
    "unwind_nested": "stage_unwind",
    "elem_match_nested": "nested_elem_match",
    "positional_update": "update_positional",
    "vector_top_k": "vector_top_k",
    "search_ranked": "search_ranked",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from docloom.plans import catalogue

    known, took = catalogue.queries(), {}
    for name, query in QUERIES.items():
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            known[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total of the better of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
