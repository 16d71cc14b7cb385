"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")

from epochfold.plans import registry
from epochfold.session import get_spark

HEADLINE = [
    "label_blocks", "tumbling_windows", "sliding_windows", "event_epochs_range_join", "clip_thresholds_by_fold", "band_power", "band_power_welch_multi_segment",
    "regional_summary", "class_covariance", "splits_loso", "splits_expanding_group", "fold_scaler_stats", "dummy_stratified_hash", "fold_metrics",
    "pooled_vs_fold_metrics", "roc_auc_by_group", "per_split_baselines", "loso_centroid_end_to_end", "bootstrap_ci_hash", "within_group_permutation",
    "lag_autocorr_time_aligned", "loso_logreg", "loro_logreg", "loso_csp_lda",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    run = lambda name: found[name](spark, sf).write.format("noop").mode("overwrite").save()
    run("fold_metrics")  # compiles and starts workers
    run("band_power")
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
