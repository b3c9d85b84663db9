"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   tables to read   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores      (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    # corpus build
    "split_pages", "auto_resolve", "clean_stats", "parse_sections", "pack_chunks", "token_quantiles",
    "embed_points", "index_signature",
    # retrieval
    "dense_topk", "sparse_topk", "rrf_fusion", "hybrid_search", "filtered_search", "read_context",
    # registration, maintenance, catalog
    "distinct_files", "unique_key", "free_slots", "article_spans", "offset_vote",
    "upsert_points", "migrate_upsert", "catalog_summary", "status_rollup", "history_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())

    from checks.queries import QUERIES
    from quire.session import session

    names = sys.argv[1:] or (list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = session("bench", **{
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed run starts the workers and compiles the shared text expressions
    QUERIES["pack_chunks"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
