"""Shapley values of trees against all coalitions, for every kind of model."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import estimators, tree_shap


def by_coalitions(nodes, weights, x, d):
    """Shapley values of one row by listing coalitions; absent features follow both branches in proportion to training rows."""

    def reach(tree, at, inside):
        r = nodes[tree, at]
        if r["left"] < 0:
            return r["prediction"]
        left, right = nodes[tree, r["left"]], nodes[tree, r["right"]]
        if r["feature"] in inside:
            return reach(tree, r["left"] if x[r["feature"]] <= r["threshold"] else r["right"], inside)
        return (left["n"] * reach(tree, r["left"], inside) + right["n"] * reach(tree, r["right"], inside)) / r["n"]

    value = {s: sum(w * reach(t, 0, set(s)) for t, w in enumerate(weights)) for k in range(d + 1) for s in combinations(range(d), k)}
    phi = [sum(factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (value[tuple(sorted((*s, j)))] - value[s]) for s in value if j not in s) for j in range(d)]
    return np.array(phi), value[()]


def training(spark, d, n=300):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = x[:, 0] * (x[:, 1] > 0) + np.abs(x[:, min(2, d - 1)]) + 0.3 * x[:, d - 1] * x[:, 0]
    names = [f"x{j}" for j in range(d)]
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], ["row_id", *names, "y_true"])
    return x, names, VectorAssembler(inputCols=names, outputCol="f").transform(df)


@pytest.mark.parametrize("make,d", [(lambda: DecisionTreeRegressor(maxDepth=6, minInstancesPerNode=3), 10), (lambda: RandomForestRegressor(numTrees=4, maxDepth=5, seed=1), 6), (lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=1), 5)])
def test_values_equal_all_coalitions(spark, make, d):
    x, names, df = training(spark, d)
    model = make().setFeaturesCol("f").setLabelCol("y_true").fit(df)
    rows = df.where("row_id % 60 = 0")
    nodes = {(r["tree"], r["node"]): r for r in tree_shap.node_table(model, spark).collect()}
    trees = len({t for t, _ in nodes})
    weights = [1 / trees] * trees if isinstance(make(), RandomForestRegressor) else list(getattr(model, "treeWeights", [1.0]))
    got = {r["row_id"]: r for r in tree_shap.tree_shap(model, rows, names).collect()}
    said = {r["row_id"]: r["prediction"] for r in model.transform(rows).collect()}
    assert len(got) == 5
    for i, r in got.items():
        phi, expected = by_coalitions(nodes, weights, x[i], d)
        assert np.allclose(r["phi"], phi) and np.isclose(r["expected"], expected)
        assert np.isclose(sum(r["phi"]) + r["expected"], said[i])


def test_many_features_deep_trees_and_nan(spark):
    """Thirty features and a path of twelve cuts: values add up to the prediction, also where a feature is NaN."""
    x, names, df = training(spark, 30)
    model = DecisionTreeRegressor(maxDepth=12, featuresCol="f", labelCol="y_true").fit(df)
    paths = tree_shap.Paths(model, spark)
    x[3, 0] = x[5, :] = np.nan
    phi = paths.values(x)
    said = []
    nodes = {r["node"]: r for r in tree_shap.node_table(model, spark).collect()}
    for row in x:
        at = 0
        while nodes[at]["left"] >= 0:
            at = nodes[at]["left"] if row[nodes[at]["feature"]] <= nodes[at]["threshold"] else nodes[at]["right"]
        said.append(nodes[at]["prediction"])
    assert np.allclose(phi.sum(1) + paths.expected, said)
    whole, tree_shap._BLOCK = tree_shap._BLOCK, 500
    try:
        assert np.allclose(paths.values(x), phi)
    finally:
        tree_shap._BLOCK = whole


def test_estimators_of_several_outputs(spark):
    _, names, df = training(spark, 3, 120)
    long_ = df.select("row_id", *names, F.lit("a").alias("output"), "y_true").unionByName(df.select("row_id", *names, F.lit("flat").alias("output"), F.lit(2.0).alias("y_true")))
    model = estimators.Forest(3, 4).fit(long_, names)
    values = tree_shap.estimator_shap(model, long_)
    bars = {(r["output"], r["feature"]): r["mean_abs_shap"] for r in tree_shap.mean_absolute_by_output(values, names).collect()}
    assert len(bars) == 6 and all(bars["flat", c] == 0 for c in names) and bars["a", "x0"] > 0
    both = values.withColumn("total", F.aggregate("phi", F.col("expected"), lambda s, v: s + v)).join(model.predict(long_), ["row_id", "output"])
    assert both.where("abs(total - y_pred) > 1e-9").count() == 0 and both.count() == 240


def test_values_of_a_batch_are_taken_once_a_cell(spark):
    """Equal values as one row at a time gives, also on a cut, between cuts and for NaN; 50 copies of a row cost one."""
    x, names, df = training(spark, 3)
    model = RandomForestRegressor(numTrees=3, maxDepth=4, seed=1, featuresCol="f", labelCol="y_true").fit(df)
    paths = tree_shap.Paths(model, spark)
    cuts = [paths.cuts(j) for j in range(3)]
    odd = np.array([[cuts[0][0], cuts[1][-1], cuts[2][0]], [np.nextafter(cuts[0][0], np.inf), np.nan, np.inf], [np.nan, -np.inf, np.nan]])
    x = np.concatenate([x, odd])
    sizes, taken = [], paths._values
    paths._values = lambda part: sizes.append(len(part)) or taken(part)
    many = paths.values(np.concatenate([x] * 50))
    assert np.array_equal(many, np.concatenate([np.concatenate([taken(r[None]) for r in x])] * 50))
    assert sizes == [len({tuple(np.searchsorted(c, v) for c, v in zip(cuts, r)) for r in x})] and sizes[0] <= len(x)


def test_means_over_rows_come_from_cells(spark):
    """Means equal those of all rows' values; copies of rows add nothing to the rows that reach Python; nulls count as NaN."""
    x, names, df = training(spark, 3, 120)
    long_ = df.select("row_id", *names, F.lit("a").alias("output"), "y_true").unionByName(df.select("row_id", *names, F.lit("b").alias("output"), (F.col("x0") * 2).alias("y_true")))
    model = estimators.Forest(3, 4).fit(long_, names)
    odd = spark.createDataFrame([(1000, None, 0.5, 0.1, "a", 0.0), (1001, float("nan"), -0.5, None, "a", 0.0)], long_.schema)
    rows = long_.where("output = 'a'").unionByName(odd)
    copies = rows.crossJoin(spark.range(30)).drop("id")
    for some, outputs in ((copies, {"a"}), (long_, {"a", "b"})):
        by_rows = {(r["output"], r["feature"]): r["mean_abs_shap"] for r in tree_shap.mean_absolute_by_output(tree_shap.estimator_shap(model, some), names).collect()}
        by_cells = {(r["output"], r["feature"]): r["mean_abs_shap"] for r in tree_shap.mean_absolute_shap(model, some).collect()}
        assert by_cells.keys() == by_rows.keys() and {o for o, _ in by_cells} == outputs
        assert all(np.isclose(v, by_rows[k]) for k, v in by_cells.items())
    paths = tree_shap.Paths(model.fitted["a"], spark)
    once, often = (tree_shap.cell_counts(paths, d, names).collect() for d in (rows, copies))
    assert len(once) == len(often) <= 122 and sum(r["n"] for r in often) == 30 * sum(r["n"] for r in once) == 30 * 122


def test_forests_are_those_of_assembled_vectors(spark):
    """The fit's vectors come from arrays: same trees as from the assembler, zeros and whole numbers included, and an error at NaN and null."""
    _, names, df = training(spark, 3)
    rows = df.select("row_id", F.lit("a").alias("output"), "x0", F.lit(0.0).alias("x1"), F.col("row_id").cast("int").alias("x2"), "y_true")
    made = estimators.Forest(3, 4).fit(rows, names).fitted["a"]
    assembled = VectorAssembler(inputCols=names, outputCol="_features").transform(rows)
    plain = RandomForestRegressor(numTrees=3, maxDepth=4, featureSubsetStrategy="all", seed=0, featuresCol="_features", labelCol="y_true").fit(assembled)
    assert made.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    for bad in (F.lit(float("nan")), F.lit(None).cast("double")):
        with pytest.raises(Exception, match="null or NaN in x1"):
            estimators.Forest(3, 4).fit(rows.withColumn("x1", F.when(F.col("row_id") == 7, bad).otherwise(0.0)), names)
