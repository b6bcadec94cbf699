"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from waymark import registry

QUERIES = [
    "join_near_duplicates", "top_search", "top_discovery", "top_discover", "win_interleave_lanes", "gov_publication", "gov_record_rules", "safety_temporal_status", "export_gate",
    "join_nearest_nodes", "join_knn_connectors", "join_access_point", "join_shared_gateway", "join_road_geometry", "join_overpass_features", "corridor_candidates", "top_corridor_tiers", "lunch_candidates",
    "win_route_reference", "win_detour_budget", "win_load_curve", "agg_segment_metrics", "agg_infer_intent", "status_projection", "join_asof_weather", "plan_connection_ok", "val_entity_common",
    "fn_haversine", "fn_cell_cover", "fn_norm_text", "graph_components", "graph_shortest_paths",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tmp)
        .config("spark.checkpoint.dir", f"file://{tmp}/shared")
        .config("spark.sql.warehouse.dir", f"{tmp}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # starts the engine
    for name in QUERIES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
