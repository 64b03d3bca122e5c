"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from mdlake.plans import catalog

HEADLINE = {
    "parse": "all_blocks", "block_filter": "blocks_heading_level", "bm25_top_10": "bm25_top_k", "fts_phrase": "fts_phrase", "hash_embed": "hash_embed", "knn_top_10": "knn_top_k",
    "semantic_search": "semantic_search", "pagerank_20": "pagerank_20", "components": "components", "store_versions": "snapshot_read", "mql_select": "mql_select",
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    found = {}
    for name, query in HEADLINE.items():
        run = lambda: catalog.QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()  # warm-up
        times = []
        for _ in range(repeats):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
