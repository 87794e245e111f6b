"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from placelab.session import local_session
from workload.queries import queries

HEADLINE = [
    "place_assemble", "place_dedup_global", "search_places", "harvest_links", "summary_overview", "task_outcomes",
    "coord_clean", "coord_reject_counts", "neighbor_counts", "neighbor_pairs", "dense_merchants",
    "poi_dbscan_summary", "poi_adaptive", "poi_kmeans", "poi_sweep",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    known, spent = queries(), {}
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark.read.parquet(f"{folder}/customer.parquet").write.format("noop").mode("overwrite").save()  # start-up
    for name in wanted:
        start = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
