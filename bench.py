"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lodestar.plans import registry, relational, shapes, spatial, storage, timeseries  # noqa: F401
from lodestar.session import get_session

HEADLINE = [
    "count_scan", "count_where", "filter_between_in", "agg_all", "group_sorted", "group_having", "order_limit", "index_view", "window_1h", "window_5m",
    "tick_cube_1h", "tick_cube_1d", "range_intersect", "vector_topk", "overlap_join", "geo_within_join",
    "geo_distance", "geo_intersect", "geo_overlay", "geo_hulls",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", f"local[{os.environ.get('BENCH_CPUS', '8')}]", spark__sql__shuffle__partitions="16", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry.table(spark, folder, "nation").count()  # starts the executors
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
