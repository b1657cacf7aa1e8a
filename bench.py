"""Times the headline queries; prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from kinweave.plans import catalog

HEADLINE = [
    "top_buyers", "shared_identifiers", "entity_person_summary", "person_list_page", "connections_all", "graph_3hop", "merge_canonical", "crm_metrics", "golden_profile", "scd2_activation", "candidate_generation",
    "heuristic_score", "best_match", "pair_audit", "retro_labels", "pit_features", "temporal_folds", "binary_metrics", "vehicle_match", "person_sales_history", "authority_ledger", "normalize_email", "review_queue",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries["top_buyers"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
