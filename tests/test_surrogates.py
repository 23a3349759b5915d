import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.quantiles import beta_quantile, gamma_quantile
from tessera.operators import design, explain, forecast, frames, metrics, models
from tests import exact_models
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
FAST = ["auto_detect_closed", "knn_metrics", "uq_flexible", "spearman_all", "silhouette_score", "nn_entropy", "pca_projection", "pdp_general", "shap_exact", "forecast_context", "bootstrap_ols", "ordered_intervals", "ks_two_sample", "ols_multioutput_metrics", "coverage_curve", "calibration_area", "error_histogram", "kfold_select_best", "stump_regression", "knn_regression_std", "pca_2col", "ts_metrics", "spearman_matrix", "bias_metrics", "maximin"]


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, [tuple(None if pd.isna(v) else float(v) + 0.0 if isinstance(v, float) else getattr(v, "item", lambda v=v: v)() for v in r) for r in df[cols].itertuples(index=False)]))


@pytest.mark.parametrize("name", FAST)
def test_matches_independent_engine(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "nation", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_rule_table(spark):
    # fixed values: one row on each side of the thresholds
    t = spark.createDataFrame([(0.01, 0.9, 1.0, "Grid"), (0.3, 0.2, 2.5, "Random"), (0.1, 0.5, 1.5, "Sobol"), (0.1, 0.5, 2.5, "LHS"), (0.18, 0.4, 1.5, "Uncertain")], "a double, b double, c double, want string")
    assert t.where(design.sampling_rule(F.col("a"), F.col("b"), F.col("c")) != F.col("want")).count() == 0


def test_bias_of_a_table_with_copies(spark):
    t = spark.createDataFrame([(3, 9, 4.5), (3, 9, 4.5), (7, 2, 4.5), (1, 8, 4.5), (3, 9, 4.5)], "a int, b int, c double")
    got = design.bias_metrics(t).first()
    assert got["duplicate_rate"] == pytest.approx(2 / 5) and got["min_variance"] == 0 and got["duplicate_alert"]


def test_series_metrics_by_hand(spark):
    y, f = [2.0, 4.0, 8.0, 6.0], [2.0, 5.0, 7.0, 6.0]
    got = forecast.series_metrics(spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(zip(y, f))], "series_id string, t int, value double, forecast double")).first()
    assert got["mae"] == pytest.approx(0.5) and got["mase"] == pytest.approx(0.5 / (8 / 3)) and got["smape"] == pytest.approx(100 * np.mean([0, 2 / 9, 2 / 15, 0]), abs=1e-6)
    with pytest.raises(RuntimeError):
        forecast.Forecaster().predict(3)


def test_folds_are_contiguous_and_even(spark):
    got = frames.kfold(spark.range(11).withColumnRenamed("id", "k"), "k", 3).orderBy("k").toPandas()["fold"].tolist()
    assert got == [0] * 4 + [1] * 4 + [2] * 3


def test_gaussian_process_interpolates_and_shap_adds_up():
    x = np.array([[0.0], [1.0], [2.0]])
    mean, std = exact_models.GaussianProcess().fit(x, np.array([0.0, 1.0, 0.0])).predict(x)
    assert np.allclose(mean, [0, 1, 0], atol=1e-3) and (std < 1e-2).all()
    rng = np.random.default_rng(0)
    a, b = rng.random((4, 3)), rng.random((5, 3))
    f = lambda z: z[:, 0] * z[:, 1] + z[:, 2]
    assert np.allclose(explain.exact_shap(f, a, b).sum(1), f(a) - f(b).mean())


def test_quantiles_of_gamma_and_beta():
    assert gamma_quantile(0.5, 1.0)[0] == pytest.approx(np.log(2), abs=1e-6)
    assert beta_quantile(0.25, 1.0, 1.0)[0] == pytest.approx(0.25, abs=1e-6)


def test_coverage_grows_with_level(spark):
    got = metrics.coverage(catalog.line_predictions(spark, SF)).orderBy("output", "level").toPandas()
    assert all(g["empirical"].is_monotonic_increasing for _, g in got.groupby("output"))
