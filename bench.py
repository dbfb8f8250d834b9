"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from hazardline.session import build_session
from proofs import catalog, registry

HEADLINE = [
    "build_feature_table", "pivot_mean", "agg_entropy", "set_interaction", "top_n_values", "text_contains_flags",
    "stratified_split", "kfold_assign", "kaplan_meier", "ipcw_weights", "ipcw_cindex", "evaluate_by_cluster",
    "survival_forest_fit", "extra_survival_trees_fit", "survival_forest_score", "cox_ph", "kmeans_clusters",
    "knn_graph", "propagate_neighbors", "permutation_importance", "grid_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    catalog.load()
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small run first, so that the figures show the queries and not the start of the engine
    registry.QUERIES["agg_count"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
