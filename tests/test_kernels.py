"""Gaussian processes and support vectors on all rows against exact models in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels
from tests import exact_models


def rows_of(spark, n=90, d=2, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-2, 2, (n, d)), 3)
    targets = {"wave": np.sin(2 * x[:, 0]) + 0.5 * x[:, -1], "plane": 3 + x[:, 0] - 2 * x[:, -1]}
    names = [f"x{j}" for j in range(d)]
    df = spark.createDataFrame([(i, o, *map(float, x[i]), float(y[i])) for o, y in targets.items() for i in range(n)], ["row_id", "output", *names, "y_true"]).repartition(3)
    return df, x, targets, names


@pytest.mark.parametrize("matern,scale", [(False, None), (True, 1.3), (False, 0.7)])
def test_process_equals_the_exact_one_where_all_rows_are_inducing(spark, matern, scale):
    df, x, targets, names = rows_of(spark)
    model = kernels.GaussianProcess(1e-2, matern, scale).fit(df, names)
    got = {(r["output"], r["row_id"]): (r["y_pred"], r["y_std"]) for r in model.predict(df.withColumn("x0", F.col("x0") + 0.1)).collect()}
    for o, y in targets.items():
        exact = exact_models.GaussianProcess(1e-2, matern, model.scales[o] if scale is None else scale)
        exact.fit(x, y)
        mean, std = exact.predict(x + np.array([0.1, 0.0]))
        assert np.allclose([got[o, i][0] for i in range(len(x))], mean, atol=1e-5)
        if scale is not None:
            assert np.allclose([got[o, i][1] for i in range(len(x))], std, atol=1e-4)


def test_likeliest_scale_is_the_exact_processs(spark):
    df, x, targets, names = rows_of(spark, 40)
    model = kernels.GaussianProcess(1e-2, inducing=100).fit(df, names)
    for o, y in targets.items():
        exact = exact_models.GaussianProcess(1e-2).fit(x, y)
        ratio = model.scales[o] / exact.scale
        assert 0.5 < ratio < 2.0
        # the likeliest variance: deviations of both are alike up to the grids' step
        assert np.median(model._of(o, x + 0.3)[1]) == pytest.approx(np.median(exact.predict(x + 0.3)[1]), rel=1.0)


def test_few_inducing_points_see_all_rows(spark):
    """Twelve points and 600 rows: the error is that of the noise, and rows that repeat change nothing but their count."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 6, 600)
    df = spark.createDataFrame([(i, "y", float(v), float(np.sin(v) + 0.1 * rng.normal())) for i, v in enumerate(x)] + [(-1, "y", None, 1.0), (-2, "y", 1.0, None)], "row_id long, output string, x double, y_true double").repartition(4)
    model = kernels.GaussianProcess(1e-2, inducing=12).fit(df, ["x"])
    p = model.predict(df.where("row_id >= 0"))
    assert p.agg(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))).first()[0] < 0.015
    odd = {r["row_id"]: r["y_pred"] for r in model.predict(df.where("row_id < 0")).collect()}
    assert odd[-1] is None and odd[-2] is not None
    assert model.predict(df.withColumn("output", F.lit("other"))).count() == 0


def test_support_vectors_reach_the_optimum_within_the_gap(spark):
    df, x, targets, names = rows_of(spark, 80)
    model = kernels.SupportVectors(2.0, "scale", 0.05, directions=20, gap=0.005).fit(df, names)
    assert all(g <= 0.005 for g in model.gaps.values())
    for o, y in targets.items():
        phi, r = model._phi(o, x), y - model.centre[o]
        objective = lambda w: 0.5 * w @ w + 2.0 * np.maximum(np.abs(r - phi @ w) - 0.05, 0).sum()  # noqa: B023, E731
        beta, w = np.zeros(len(x)), np.zeros(phi.shape[1])
        for _ in range(3000):  # dual coordinates one by one, until nothing moves
            for i in range(len(x)):
                free, step = beta[i] + (r[i] - phi[i] @ w) / (phi[i] @ phi[i]), 0.05 / (phi[i] @ phi[i])
                new = float(np.clip(np.sign(free) * max(abs(free) - step, 0), -2.0, 2.0))
                w, beta[i] = w + (new - beta[i]) * phi[i], new
        assert objective(w) * (1 - 1e-3) <= objective(model.weights[o]) <= objective(w) / (1 - 0.005) + 1e-9


def test_features_approximate_the_kernel(spark):
    df, x, _, names = rows_of(spark, 50)
    model = kernels.SupportVectors(1.0, 0.4, directions=4000, rounds=0).fit(df.where("output = 'plane'"), names)
    phi = model._phi("plane", x)[:, :-1]
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(phi @ phi.T - exact).max() < 0.09


def test_support_rows_are_merged_and_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A table in one file is fitted by several tasks; equal rows are kept once and weigh as often as they stand."""
    rng = np.random.default_rng(2)
    rows = [(i, "y", float(i % 30), float(np.sin(i % 30) + (i % 7) * 0.1)) for i in range(400)] + [(1000 + i, "y", float(v), 0.5) for i, v in enumerate(rng.uniform(0, 30, 200))]
    spark.createDataFrame(rows, "row_id long, output string, x double, y_true double").coalesce(1).write.parquet(f"{tmp_path}/once")
    seen = []
    monkeypatch.setattr(kernels, "written", lambda df, name, f=kernels.written: seen.append(f(df, name)) or seen[-1])
    monkeypatch.setattr(kernels, "dropped", lambda df: None)
    one = spark.read.parquet(f"{tmp_path}/once")
    fits = [kernels.SupportVectors(2.0, 0.2, 0.05, directions=12, gap=0.002).fit(t, ["x"]) for t in (one, one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))))]
    first = seen[0]
    assert first.count() == 210 + 200 and first.agg(F.sum("n")).first()[0] == 600 and first.rdd.getNumPartitions() > 1
    by_hand = kernels.SupportVectors(10.0, 0.2, 0.05, directions=12, gap=0.002).fit(one, ["x"])  # five times a row is five times the cost
    assert all(g <= 0.002 for m in (*fits, by_hand) for g in m.gaps.values())
    x = np.linspace(0, 29, 30)[:, None]
    assert np.abs(fits[1]._of("y", x)[0] - by_hand._of("y", x)[0]).max() < 0.05
