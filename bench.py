"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import time

from flowlake import plans
from flowlake.session import build_session

HEADLINE = (
    "split_temporal_report",
    "split_stratified",
    "partition_exponential",
    "rank_by_time",
    "clean_forward_fill",
    "clean_deduplicate",
    "encode_categories",
    "numeric_stats",
    "correlation_pairs",
    "mutual_information",
    "flow_features",
    "standard_scale",
    "sample_weights",
    "weighted_scores",
    "log_loss",
    "roc_auc",
    "aggregate_metrics",
    "average_parameters",
    "boost_predict",
    "federated_bagging",
    "mlp_federated",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    # start the executors and their Python workers before the clock
    plans.QUERIES["class_counts"](spark, folder).collect()
    plans.QUERIES["mlp_gradient"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        started = time.time()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
