"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from panelspark.plans import catalog
from panelspark.session import local_session

HEADLINE = [
    "w01_rolling_calendar_windows", "w02_feature_windows", "w05_kimber_trajectory", "w06_equivalent_day_trajectory",
    "w08_equivalent_day_panel_labels", "m11_training_matrix", "m13_best_parameters", "j11_greedy_match",
    "a04_failure_modes", "d04_threshold_sweep", "j12_neighbor_features", "a29_dissolve_union_area",
    "d02_recommend_arrays", "a08_distribution_summary", "a18_roc_auc_lineitem", "a20_spearman",
    "s05_weather_payload", "a11_dataset_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "panelspark-bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
