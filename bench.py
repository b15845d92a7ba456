"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillstone.plans import catalog

HEADLINE = ["bm25_topk", "bm25_batch_topk", "bm25_scoped", "vector_batch_topk", "hybrid_recall", "hybrid_expand_related", "rrf_fuse3_recency", "near_dup_join", "term_freq", "chunk_windows", "oplog_summary", "oplog_top_served", "oplog_never_recalled", "vacuum_graph_edges", "stats_by_agent"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, took = catalog.queries(), {}
    for warm in (True, False):
        for name in HEADLINE:
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if not warm:
                took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
