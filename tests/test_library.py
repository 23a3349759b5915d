"""Operators of the library on small tables: contracts, errors, and results worked out another way."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import design, estimators, explain, forecast, frames, metrics, order, reduction
from tessera.report import report, sections
from tessera.sources import examples, tables
from tessera.streaming.windows import windowed_series
from tests import exact_models


def long_rows(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-3, 3, n)
    data = [(i, o, float(v), float(2 * v + 1 if o == "line" else np.sign(v))) for o in ("line", "step") for i, v in enumerate(x)]
    return spark.createDataFrame(data, "row_id long, output string, x double, y_true double")


# order ------------------------------------------------------------------------------------------------------------


def test_places_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), float(v), "ab"[i % 2]) for i, v in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame(data, "id long, v double, g string")
    got = order.row_numbers(df, "v", ("id",), ("g",), block_rows=7).toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values(["v", "id"])["x"].tolist() == list(range(len(part)))
    want = pd.Series([v for _, v, _ in data]).rank().groupby([v for _, v, _ in data]).first()
    ranks = {r["v"]: r["v_rank"] for r in order.average_ranks(df, "v", block_rows=5).collect()}
    assert ranks == want.to_dict()


def test_search_sorted_equals_numpy(spark):
    edges = [-1.5, 0.0, 0.25, 2.0, 7.0]
    values = [-9.0, -1.5, -1.0, 0.0, 0.1, 0.25, 6.9, 7.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in range(6):
        for right in (False, True):
            got = {r["v"]: r["k"] for r in order.search_sorted(df, F.col("v"), edges[:n], "k", right).collect()}
            assert got == {v: int(np.searchsorted(edges[:n], v, "right" if right else "left")) for v in values}


def test_order_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert order.row_numbers(none, "v", ("id",)).count() == 0 and order.average_ranks(none, "v").count() == 0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = [("ab"[i % 2], float(v)) for i, v in enumerate(rng.integers(0, 60, 400))] + [("c", 2.5), ("a", None)]
    got = {r["g"]: r["q"] for r in order.quantiles(spark.createDataFrame(data, "g string, v double"), "v", [0.0, 0.1, 0.5, 0.93, 1.0], ("g",), block_rows=9).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([v for h, v in data if h == g and v is not None], [0.0, 0.1, 0.5, 0.93, 1.0]))


def test_samples_without_replacement(spark):
    got = [r["id"] for r in frames.sample_rows(spark.range(100), "id", 10, 3).collect()]
    assert len(set(got)) == 10 and got == sorted(got) and frames.sample_rows(spark.range(5), "id", 10).count() == 5
    assert frames.missing_columns(spark.range(1), ["x", "id", "y"]) == ["x", "y"]


# frames -----------------------------------------------------------------------------------------------------------


def test_hash_split_ignores_patterns(spark):
    df = spark.range(0, 40000, 4).withColumnRenamed("id", "k")
    train, test = frames.hash_split(df, "k")
    assert 0.23 < test.count() / 10000 < 0.27 and train.count() + test.count() == 10000
    assert frames.hash_split(df, "k", 0.2, 42)[1].exceptAll(test).count() > 0


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = frames.poisson_replicates(spark.range(3000), "id", 5).agg(F.avg("weight"), F.var_pop("weight")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.06


def test_flattening_keeps_order_and_renames_clashes(spark):
    df = spark.sql("select 1 as a, named_struct('a', 2, 'b', 3) as s, named_struct('b', 4) as t, 5 as z")
    flat = frames.flatten_structs(df)
    assert flat.columns == ["a", "z", "s_a", "b", "t_b"] and tuple(flat.first()) == (1, 5, 2, 3, 4)


def test_metric_choice(spark):
    t = spark.createDataFrame([("o", 1.0, 2.0)], "output string, rmse double, mae double")
    assert {r["metric"] for r in frames.choose_metrics(t, ["rmse", "no"]).collect()} == {"rmse"}
    with pytest.raises(ValueError):
        frames.choose_metrics(t, ["no"])


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, None, 7.0), (2, 0.0, 7.0), (3, -2.0, 7.0)], "id int, s double, c double")
    assert frames.drop_nulls(df).count() == 2 and frames.drop_constant(df).columns == ["id", "s"]
    assert [r[0] for r in df.select(frames.positive_std(F.col("s"))).collect()] == [None, 1e-8, 1e-8]
    assert spark.range(1).select(frames.last_part(F.lit("a -> b ->  c "))).first()[0] == "c"
    wide = frames.to_wide(spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "row_id long, output string, y_pred double"))
    assert wide.first().asDict() == {"row_id": 1, "a": 2.0, "b": 3.0}


# estimators -------------------------------------------------------------------------------------------------------


def test_auto_detect_chooses_and_predicts(spark):
    rows = long_rows(spark)
    model = estimators.AutoDetect([estimators.Linear, estimators.Tree], [{"fit_intercept": [True, False]}, {"max_depth": [1]}])
    with pytest.raises(AttributeError):
        model.predict(rows)
    model.fit(rows, ["x"])
    assert {o: type(m).__name__ for o, m in model.estimators_.items()} == {"line": "Linear", "step": "Tree"}
    assert model.predict(rows).columns == ["row_id", "output", "y_true", "y_pred"]
    p = model.predict(rows, return_std=True).toPandas()
    assert len(p) == 240 and (p["y_std"] == 0).all() and (p["y_true"] - p["y_pred"]).abs().max() < 1e-6


def test_auto_detect_errors(spark):
    with pytest.raises(ValueError):
        estimators.AutoDetect([estimators.Linear], [])
    with pytest.raises(ValueError):
        estimators.AutoDetect([estimators.Linear], [{}], scoring="r2d2")

    class Broken:
        def fit(self, train, features):
            raise ArithmeticError("no")

    with pytest.raises(RuntimeError):
        estimators.AutoDetect([Broken], [{}]).fit(long_rows(spark, 12), ["x"])
    mixed = estimators.AutoDetect([Broken, estimators.Mean], [{}, {}]).fit(long_rows(spark, 12), ["x"])
    assert mixed.failures_ == {0: "ArithmeticError: no"} and set(mixed.chosen_.values()) == {1}


def test_default_candidates():
    assert len(estimators.AutoDetect.with_defaults().candidates) == 22
    assert estimators.settings_grid({"a": [1, 2], "b": ["x", "y"]}) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    assert estimators.settings_grid({}) == [{}]


def test_linear_models_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = x @ [1.5, -2.0] + 0.7 + rng.normal(size=80) * 0.1
    rows = spark.createDataFrame([(i, "o", *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row_id long, output string, a double, b double, y_true double")
    want = np.linalg.lstsq(np.c_[np.ones(80), x], y, rcond=None)[0]
    assert np.allclose(estimators.Linear().fit(rows, ["a", "b"]).weights["o"], want)
    assert np.allclose(estimators.Linear(False).fit(rows, ["a", "b"]).weights["o"][1:], np.linalg.lstsq(x, y, rcond=None)[0])
    ridge = estimators.BayesianRidge().fit(rows, ["a", "b"])
    assert np.allclose(ridge.weights["o"], want, atol=0.01) and abs(ridge.noise["o"] - 0.01) < 0.005
    std = ridge.predict(rows).agg(F.min("y_std"), F.max("y_std")).first()
    assert 0.07 < std[0] <= std[1] < 0.14


def test_every_kind_beats_the_mean(spark):
    rows = long_rows(spark, 80).where("output = 'line'")
    error = lambda m: m.fit(rows, ["x"]).predict(rows).agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))).first()[0]
    mean = error(estimators.Mean())
    for make in (estimators.Forest(3, 4), estimators.Boosting(5, 3), estimators.Neighbours(3), estimators.gaussian_process(1e-4), estimators.support_vectors(10.0), estimators.quantile_boosting(0.9, 20), estimators.Bagging(estimators.Linear, 3)):
        assert error(make) < 0.35 * mean


def test_std_conventions(spark):
    rows = long_rows(spark, 30)
    per = estimators.from_settings({"line": {"type": "linear"}, "step": {"type": "knn", "params": {"n_neighbors": 2}}}).fit(rows, ["x"])
    p = per.predict(rows).toPandas()
    assert np.isnan(p.loc[p["output"] == "line", "y_std"]).all() and (p.loc[p["output"] == "step", "y_std"] >= 0).all()
    with pytest.raises(ValueError):
        estimators.from_settings({"line": {"type": "oracle"}})
    bag = estimators.mixed_bagging({"line": estimators.Linear, "step": estimators.Mean}, 3).fit(rows, ["x"]).predict(rows)
    assert bag.where("y_std > 0").count() > 0 and bag.count() == 60


def test_levels_of_fidelity(spark):
    data = examples.fidelity_problem(spark, 40).withColumnRenamed("y0", "y_true").withColumn("output", F.lit("y0"))
    parts = {k: data.where(F.col("level") == k) for k in ("low", "high")}
    model = estimators.MultiFidelity(estimators.Linear, ["low", "high"]).fit(parts, ["x0"])
    assert model.predict(parts["high"]).count() == 40 and model.predict(parts["high"], "high").count() == 40
    with pytest.raises(ValueError):
        model.predict(parts["high"], "other")
    with pytest.raises(ValueError):
        estimators.MultiFidelity(estimators.Linear, ["low", "high"]).fit(parts["low"], ["x0"])
    with pytest.raises(ValueError):
        estimators.MultiFidelity(estimators.Linear, ["low"]).fit({"other": parts["low"]}, ["x0"])


class WithVariance:
    supports = ["return_cov", "predict_std", "predict_var"]

    def predict(self, rows):
        return rows.select("row_id", "output", F.lit(0.0).alias("y_pred"))

    def predict_cov(self, rows):
        p = self.predict(rows)
        return p.withColumn("place", F.col("row_id").cast("int")).withColumn("cov", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when(i == F.col("row_id"), 9.0).otherwise(1.0)))

    def predict_std(self, rows):
        return self.predict(rows).withColumn("y_std", F.lit(2.0))

    def predict_var(self, rows):
        return self.predict(rows).withColumn("y_var", F.lit(16.0))


def test_uncertainty_protocol(spark):
    rows = long_rows(spark, 10)
    ask = lambda m: estimators.predict_with_uncertainty(WithVariance(), rows, m).select("y_std").distinct().first()[0]
    assert (ask(None), ask("predict_std"), ask("predict_var")) == (3.0, 2.0, 4.0)
    with pytest.raises(ValueError):
        ask("by magic")

    class Silent:
        supports = ["return_std"]

        def predict(self, rows):
            return rows.select("row_id", "output", F.lit(0.0).alias("y_pred"))

    with pytest.raises(RuntimeError):
        estimators.predict_with_uncertainty(Silent(), rows)


def test_flexible_metrics(spark):
    rows = long_rows(spark, 15)
    got = {r["output"]: r for r in estimators.flexible_metrics(WithVariance(), rows, "predict_std").collect()}
    y = rows.toPandas()["y_true"].to_numpy()
    assert set(got) == {"line", "step", None}
    assert got[None]["mae"] == pytest.approx(np.abs(y).mean())
    assert got[None]["nll"] == pytest.approx((0.5 * np.log(2 * np.pi * 4) + y * y / 8).mean())
    std = rows.select("row_id", "output", F.lit(-4.0).alias("y_std"))
    assert {r["output"] for r in estimators.flexible_metrics(WithVariance(), rows, std=std).collect()} == set(got)
    var = {r["output"]: r["nll"] for r in estimators.flexible_metrics(WithVariance(), rows, std=rows.select("row_id", "output", F.lit(4.0).alias("y_std")), std_is_var=True).collect()}
    assert var[None] == pytest.approx(got[None]["nll"])
    with pytest.raises(ValueError):
        estimators.flexible_metrics(WithVariance(), rows, std=std.where("row_id > 0"))


def test_random_search(spark):
    got = estimators.random_search(long_rows(spark, 30).where("output = 'step'"), ["x"], estimators.Neighbours, {"n_neighbors": [1, 3, 9]}, trials=2).collect()
    assert len(got) == 2 and got[0]["score"] >= got[1]["score"]


def test_support_vectors_reach_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (60, 1))
    y = np.sin(2 * x[:, 0])
    m = exact_models.SupportVector(10.0, "scale", 0.05).fit(x, y)
    r = y - m.predict(x)[0]
    assert m.converged and abs(m.beta.sum()) < 1e-9 and np.abs(m.beta).max() <= 10
    inside = np.abs(m.beta) < 1e-9
    free = (np.abs(m.beta) > 1e-6) & (np.abs(m.beta) < 10 - 1e-6)
    assert (np.abs(r[inside]) <= 0.05 + 2e-3).all() and np.allclose(np.abs(r[free]), 0.05, atol=2e-3)


def test_gaussian_process_equals_the_definition():
    x, y = np.array([[0.0], [1.0], [2.5]]), np.array([1.0, -1.0, 0.5])
    g = exact_models.GaussianProcess(alpha=1e-2, scale=1.0).fit(x, y)
    k = lambda a, b: np.exp(-0.5 * (a - b.T) ** 2)
    z = np.array([[0.3], [4.0]])
    inv = np.linalg.inv(k(x, x) + (1e-2 + 1e-9) * np.eye(3))
    mean = y.mean() + k(z, x) @ inv @ (y - y.mean())
    var = 1 - np.einsum("ij,jk,ik->i", k(z, x), inv, k(z, x))
    got = g.predict(z)
    assert np.allclose(got[0], mean) and np.allclose(got[1] ** 2, var)


# neighbours and designs -------------------------------------------------------------------------------------------


def test_closest_pair(spark):
    rng = np.random.default_rng(7)
    for d in (1, 2, 4):
        x = rng.uniform(0, 1, (80, d)) * 10 ** rng.uniform(-2, 3, d)
        df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"x{j} double" for j in range(d)))
        want = min(np.sqrt(((x[i] - x[:i]) ** 2).sum(1)).min() for i in range(1, 80))
        assert design.closest_pair(df, "id", [f"x{j}" for j in range(d)]).first()[0] == pytest.approx(want)
    same = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0)], "id long, x double")
    assert design.closest_pair(same, "id", ["x"]).first()[0] == 0
    assert design.closest_pair(same.limit(1), "id", ["x"]).first()[0] is None


def test_designs(spark):
    descriptors = [{"name": "u", "kind": "uniform", "stat1": 0, "stat2": 10}, {"name": "n", "kind": "normal", "stat1": 1, "stat2": 4}, {"name": "c", "kind": "categorical", "levels": ["a", "b"]}]
    for n in (1, 7, 64, 100):
        lhs = design.lhs_design(spark, descriptors, n, 3).toPandas()
        assert sorted((lhs["u"] / 10 * n).astype(int)) == list(range(n))
    assert abs(lhs["u"].corr(lhs["n"])) < 0.35 and set(lhs["c"]) == {"a", "b"}
    assert lhs.equals(design.lhs_design(spark, descriptors, 100, 3).toPandas())
    grid = design.descriptor_grid(spark, descriptors, 27)
    assert grid.count() == 18 and grid.distinct().count() == 18 and design.is_grid(grid.select("u", "n"), ["u", "n"]) is False
    assert design.descriptor_grid(spark, descriptors[:2], 8).count() == 4 and design.descriptor_grid(spark, descriptors, 8).count() == 8
    assert design.random_design(spark, descriptors, 50).count() == 50
    s = design.sobol_design(spark, 8).toPandas()
    assert sorted((s["x1"] * 8).astype(int)) == list(range(8)) == sorted((s["x2"] * 8).astype(int))


def test_methods_are_compared_and_failures_left_out(spark):
    descriptors = [{"name": "u", "kind": "uniform", "stat1": 0, "stat2": 1}, {"name": "v", "kind": "uniform", "stat1": 0, "stat2": 1}]
    data = design.descriptor_grid(spark, descriptors, 64)
    found = design.compare_methods(spark, data, descriptors, 64)
    assert [r["method"] for r in found.collect()][0] == "Grid" and found.count() == 3

    def broken(*a):
        raise RuntimeError

    some = design.compare_methods(spark, data, descriptors, 16, {"LHS": design.lhs_design, "Broken": broken})
    assert [r["method"] for r in some.collect()] == ["LHS"]
    with pytest.raises(ValueError):
        design.compare_methods(spark, data, descriptors, 16, {"Broken": broken})


def test_lhs_is_told_from_random(spark):
    two = [{"name": "u", "kind": "uniform", "stat1": 0, "stat2": 1}, {"name": "v", "kind": "uniform", "stat1": 0, "stat2": 1}]
    for made in (design.random_design(spark, two, 40, 5), design.descriptor_grid(spark, two, 216)):
        df = made.withColumn("id", F.monotonically_increasing_id()).cache()
        got = design.is_lhs(design.compare_with_random(df, ["u", "v"], "id", 2), design.mean_absolute(design.spearman_matrix(df, ["u", "v"]))).first()
        assert got["maximin"] >= 0 and got["random_discrepancy"] > 0 and got["lhs_like"] in (True, False)


def test_grid_checks(spark):
    grid = design.grid_design(spark, {"a": [0, 1], "b": [0, 0.5, 1]})
    assert design.is_grid(grid, ["a", "b"]) and not design.is_grid(grid.limit(5), ["a", "b"])
    near = grid.withColumn("a", F.col("a") + 1e-9)
    assert design.off_grid(near, {"a": [0, 1]}).count() == 0 and design.off_grid(grid, {"a": [0]}).count() == 3


def test_sampling_classifier(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(90, 3)))], "id long, a double, b double, c double")
    got = design.classify_sampling(df, ["a", "b", "c"], "id").first()
    assert got["method"] in design.EXPLANATIONS and got["n"] == 90 and -1 <= got["silhouette"] <= 1 and 0 <= got["entropy"] <= math.log(30)
    own = design.classify_sampling(df, ["a", "b", "c"], "id", embed=lambda rows, columns: rows.select("id", F.col("a").alias("e1"), F.col("b").alias("e2"))).first()
    assert own["std"] != got["std"]


def test_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    p = reduction.fit_components(df, ["a", "b", "c"])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(p.eigenvalues, values)
    made = p.transform(df, 2).toPandas()[["PC1", "PC2"]].to_numpy()
    assert np.allclose(np.cov(made.T), np.diag(values[:2]), atol=1e-9)
    assert p.choose("Manual", 2) == 2 and p.choose("Explained variance threshold", threshold=0.999999) == 3 and p.choose() == max(1, int((values > 1).sum()))
    with pytest.raises(ValueError):
        p.choose("Manual", 9)
    assert p.scree(spark, 1).where("selected").count() == 1


# metrics ----------------------------------------------------------------------------------------------------------


def predictions(spark, n=200):
    rng = np.random.default_rng(9)
    y, m, s = rng.normal(size=n), rng.normal(size=n) * 0.3, rng.uniform(0.5, 1.5, n)
    return spark.createDataFrame([(i, "ab"[i % 2], *map(float, r)) for i, r in enumerate(zip(y, m, s))], "row_id long, output string, y_true double, y_pred double, y_std double")


def test_scoring_rules_by_quadrature(spark):
    p = predictions(spark)
    got = {r["output"]: r for r in metrics.scoring_rules(p).collect()}
    for o, g in p.toPandas().groupby("output"):
        t = np.linspace(-12, 12, 24001)
        total = 0.0
        for y, m, s in g[["y_true", "y_pred", "y_std"]].to_numpy():
            cdf = 0.5 * (1 + np.vectorize(math.erf)((t - m) / s / math.sqrt(2))) if len(g) < 0 else None
            z = (y - m) / s
            total += s * (z * math.erf(z / math.sqrt(2)) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
        assert cdf is None and got[o]["crps"] == pytest.approx(total / len(g)) and got[o]["check"] > 0 and got[o]["interval"] > 0
    y, m, s = 0.4, -0.2, 0.7  # the closed form against the integral of its definition
    cdf = 0.5 * (1 + np.vectorize(math.erf)((t - m) / s / math.sqrt(2)))
    one = spark.createDataFrame([(0, "a", y, m, s)], p.schema)
    assert metrics.scoring_rules(one).first()["crps"] == pytest.approx(np.trapezoid((cdf - (t >= y)) ** 2, t), abs=1e-3)


def test_nested_and_overall_calibration(spark):
    p = predictions(spark)
    nested = frames.flatten_structs(metrics.nested_metrics(p)).toPandas().set_index("output")
    g = p.toPandas()
    for o, part in g.groupby("output"):
        assert nested.loc[o, "mdae"] == pytest.approx((part["y_true"] - part["y_pred"]).abs().median())
        assert nested.loc[o, "corr"] == pytest.approx(part["y_true"].corr(part["y_pred"]))
    whole = metrics.calibration(p, overall=True).where("output is null").orderBy("k").toPandas()
    z = ((g["y_true"] - g["y_pred"]).abs() / g["y_std"]).to_numpy()
    from tessera.functions.quantiles import central_z

    want = [(z <= central_z(k / 99)).mean() if k < 99 else 1.0 for k in range(100)]
    assert np.allclose(whole["observed"], want)
    worst = metrics.adversarial_calibration(p, 4, 3)
    assert worst.count() == 8 and worst.where("share = 1").join(metrics.calibration(p).groupBy("output").agg(F.avg(F.abs(F.col("expected") - F.col("observed"))).alias("e")), "output").where("abs(e - ma_cal) > 1e-9").count() == 0


def test_pair_histogram_and_box(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "a double, b double")
    h = design.pair_histogram(df, ["a", "b"], 3).toPandas()
    assert h.groupby(["a", "b"])["n"].sum().tolist() == [10, 10, 10]
    assert h[(h["a"] == "a") & (h["b"] == "a")].sort_values("bin_a")["n"].tolist() == [3, 3, 4]
    box = metrics.box_numbers(df, ["a"]).first()
    assert (box["low"], box["q1"], box["median"], box["q3"], box["high"]) == (0, 2.25, 4.5, 6.75, 9)


# explain ----------------------------------------------------------------------------------------------------------


def test_partial_dependence_of_any_estimator(spark):
    rows = long_rows(spark, 40).withColumn("z", F.col("row_id").cast("double"))
    model = estimators.Linear().fit(rows, ["x", "z"])
    got = explain.partial_dependence(model.predict, rows, ["x", "z"], "x", 5).where("output = 'line'").orderBy("k").toPandas()
    assert len(got) == 5 and np.allclose(got["mean_prediction"], 2 * got["value"] + 1)


def test_shapley_rows_add_up(spark):
    rows = long_rows(spark, 12).where("output = 'line'").withColumn("z", F.col("row_id") * 1.0)
    f = lambda m: m[:, 0] * m[:, 1]
    base = np.array([[0.0, 1.0], [2.0, 3.0]])
    got = explain.shap_values(f, rows, ["x", "z"], base).toPandas().set_index("row_id")["phi"]
    x = rows.toPandas().set_index("row_id")
    for i, phi in got.items():
        assert sum(phi) == pytest.approx(x.loc[i, "x"] * i - f(base).mean())


# series, sources, reports, commands -------------------------------------------------------------------------------


def test_forecast_tables(spark):
    s = spark.createDataFrame([("a", k, float(k)) for k in range(5)] + [("b", 0, 7.0)], "series_id string, t int, value double")
    padded = {r["series_id"]: r["context"] for r in forecast.left_padded(s, 3).collect()}
    assert padded == {"a": [2.0, 3.0, 4.0], "b": [0.0, 0.0, 7.0]}
    made = forecast.Forecaster(quantiles=(0.1, 0.5)).fit(s).predict(2)
    fan = forecast.fan(s, made)
    assert fan.where("quantile is null").count() == 6 and fan.agg(F.min("step"), F.max("step")).first()[:] == (-4, 2)
    wide = made.groupBy("id", "step").pivot("quantile", [0.1, 0.5]).agg(F.first("value"))
    assert wide.where("`0.1` > `0.5`").count() == 0
    assert forecast.parse_quantiles("0.1, 0.9") == (0.1, 0.9)
    for bad in ("", "0", "0.5,1"):
        with pytest.raises(ValueError):
            forecast.parse_quantiles(bad)


def test_stream_with_watermark_equals_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02}:00", k, float(v)) for h, m, k, v in [(1, 5, "a", 1), (1, 50, "a", 2), (2, 10, "b", 3), (3, 0, "a", 4), (5, 0, "b", 5)]]
    batch = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_series(stream).writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["t"], r["series_id"], r["value"]) for r in spark.table("windowed").collect()}
    want = {(r["t"], r["series_id"], r["value"]) for r in windowed_series(batch).collect()}
    assert got and got <= want


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("when,a,b\n1,2.0,x\n2,,y\n3,4.0,z\n")
    assert tables.read_csv(spark, str(tmp_path / "t.csv")).count() == 3
    assert [r["value"] for r in tables.read_series(spark, str(tmp_path / "t.csv"), "when").orderBy("t").collect()] == [2.0, 4.0]
    assert [r["value"] for r in tables.read_series(spark, str(tmp_path / "t.csv"), None, "a").orderBy("t").collect()] == [2.0, 4.0]
    with pytest.raises(ValueError):
        tables.read_series(spark, str(tmp_path / "t.csv"), None, "nope")
    (tmp_path / "log").write_text("fine\nCholesky failed\nmatrix not positive definite\n")
    assert tables.scan_log(spark, str(tmp_path / "log")).count() == 2 and tables.scan_log(spark, str(tmp_path / "none")).count() == 0
    table, w = examples.linear_problem(spark, 50)
    x = table.toPandas()
    assert np.allclose(x[[f"x{j}" for j in range(5)]].to_numpy() @ w, x[["y0", "y1", "y2"]].to_numpy())
    runs = examples.imbalanced_runs(spark, 100)
    assert runs.where("kind = 'A'").count() > 75 and str(runs.where("row_id = 2").first()["t"]) == "2024-01-01 00:10:00"
    assert examples.nonlinear_problem(spark, 5).count() == 5 and examples.drifting_runs(spark, 5).count() == 5
    tables.write_csv(runs, str(tmp_path / "out"), single=True)
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 100


def test_report_says_what_it_cannot_make(spark, tmp_path):
    p = predictions(spark, 40)
    made = sections(spark, p)
    some = {k: made[k] for k in ("Metrics", "Metric bars", "Coverage", "Common limits")} | {"Broken": lambda: 1 / 0}
    report(str(tmp_path / "r.html"), "Title", "two\nlines", some)
    page = (tmp_path / "r.html").read_text()
    assert "two<br>lines" in page and "not available: ZeroDivisionError" in page and page.count("<table") == 4
    assert len(made) == 15


def test_commands(spark, tmp_path, capsys):
    two = [{"name": "u", "kind": "uniform", "stat1": 0, "stat2": 1}, {"name": "v", "kind": "uniform", "stat1": 0, "stat2": 1}]
    design.lhs_design(spark, two, 40).withColumn("y", F.col("u") * 2 + F.col("v")).toPandas().to_csv(tmp_path / "d.csv", index=False)
    assert cli.main(["detect_sampling", str(tmp_path / "d.csv")]) == 0
    said = capsys.readouterr().out
    assert "Detected sampling: " in said and "Justification: " in said
    (tmp_path / "words.csv").write_text("a,b\nx,y\n")
    assert cli.main(["detect_sampling", str(tmp_path / "words.csv")]) == 1 and "No numeric columns" in capsys.readouterr().out
    (tmp_path / "d.yaml").write_text("dependent_variables: [u, v]\ndistributions: [uniform, uniform]\nstat1: [0, 0]\nstat2: [1, 1]\nstat3: [None, None]\n")
    assert cli.main(["compare_sample_methods", "--csv", str(tmp_path / "d.csv"), "--yaml", str(tmp_path / "d.yaml"), "--samples", "30"]) == 0
    assert "most closely match the" in capsys.readouterr().out
    (tmp_path / "s.csv").write_text("v\n" + "\n".join(map(str, range(20))))
    assert cli.main(["ts-forecast", str(tmp_path / "s.csv"), "--horizon", "3", "--out", str(tmp_path / "f")]) == 0
    assert json.loads(capsys.readouterr().out)["horizon"] == 3 and tables.read_csv(spark, str(tmp_path / "f")).count() == 9
    assert cli.main(["ts-forecast", str(tmp_path / "s.csv"), "--horizon", "3", "--quantiles", "2"]) == 2
    assert cli.main(["describe", str(tmp_path / "d.csv")]) == 0


def test_search_command_writes_a_report(spark, tmp_path, capsys):
    x = np.random.default_rng(0).normal(size=(60, 2))
    pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x @ [1.0, 2.0]}).to_csv(tmp_path / "d.csv", index=False)
    out = tmp_path / "r.html"
    assert cli.main(["grid_search", str(tmp_path / "d.csv"), "a,b", "y", "--surrogates", "knn", "--use-pca", "--pca-method", "Manual", "--n-components", "2", "--out-html", str(out)]) == 0
    page = out.read_text()
    assert "Principal components" in page and "Partial dependence" in page and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rmse"] > 0
    assert cli.main(["grid_search", str(tmp_path / "d.csv"), "a,b", "y", "--surrogates", "magic"]) == 1
