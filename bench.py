"""Times every catalogue query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import catalog

HEAD = ["ols_multioutput_metrics", "coverage_curve", "calibration_area", "error_histogram", "zscore_histogram", "model_comparison_rmse", "group_mean_surrogate", "residual_trend", "pearson_matrix", "spearman_matrix", "ks_two_sample", "bootstrap_ols", "kfold_select_best", "multifidelity_ols", "knn_regression_std", "stump_regression", "bias_metrics", "ts_metrics", "pca_2col", "shap_linear"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    queries[HEAD[0]](spark, sf).collect()
    for name in HEAD:
        runs = []
        for _ in range(3):
            began = time.time()
            queries[name](spark, sf).collect()
            runs.append(time.time() - began)
        times[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "total of median warm seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
