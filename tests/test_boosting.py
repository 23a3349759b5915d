"""Quantile boosting over all rows against a plain version that grows one tree at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting


def lowest(values, level):
    """The least value with at least level of all values at or below it."""
    return np.sort(values)[max(math.ceil(level * len(values)), 1) - 1]


def inner_edges(x, bins):
    values = np.unique(x)
    return (values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(x, [k / bins for k in range(1, bins)]))


def plain(x, y, level, rounds, depth, rate, bins, least):
    """Predictions of every row after so many rounds."""
    edges = [inner_edges(x[:, j], bins) for j in range(x.shape[1])]
    f = np.full(len(y), lowest(y, level))

    def grow(rows, left):
        g = np.where(y[rows] > f[rows], level, level - 1)
        best = (1e-9, None)
        for j in range(x.shape[1]):
            for e in edges[j]:
                low = x[rows, j] <= e
                if min(low.sum(), (~low).sum()) >= least:
                    gain = g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum() - g.sum() ** 2 / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, low)
        if not left or best[1] is None:
            step[rows] = lowest(y[rows] - f[rows], level)
            return
        grow(rows[best[1]], left - 1)
        grow(rows[~best[1]], left - 1)

    for _ in range(rounds):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        f = f + rate * step
    return f


@pytest.mark.parametrize("bins,refresh,partitions", [(64, 10, 1), (8, 2, 5)])
def test_boosting_equals_the_plain_version(spark, bins, refresh, partitions):
    rng = np.random.default_rng(bins)
    n = 160
    x = np.column_stack([rng.integers(0, 6, n), rng.normal(size=n), rng.integers(0, 40, n)]).astype(float)
    targets = {"a": x[:, 0] + 0.3 * rng.normal(size=n), "b": np.round(np.abs(x[:, 1]) + 0.1 * x[:, 2] * rng.random(n), 3)}
    rows = [(i, o, *map(float, x[i]), float(y[i])) for o, y in targets.items() for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, output string, u double, v double, w double, y_true double").repartition(partitions)
    model = boosting.QuantileBoosting(0.9, 5, 3, 0.3, bins, 4, refresh).fit(df, ["u", "v", "w"])
    got = {(r["output"], r["row_id"]): (r["lower"], r["middle"], r["upper"]) for r in model.predict_quantiles(df).collect()}
    for o, y in targets.items():
        want = np.column_stack([plain(x, y, q, 5, 3, 0.3, bins, 4) for q in (0.1, 0.5, 0.9)])
        assert np.allclose([got[o, i] for i in range(n)], want), o


def test_quantiles_hold_their_shares_and_std_is_never_negative(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, 400)
    df = spark.createDataFrame([(i, "y", float(v), float(v + 0.2 * rng.normal())) for i, v in enumerate(x)], "row_id long, output string, x double, y_true double")
    model = boosting.QuantileBoosting(0.9, 20).fit(df, ["x"])
    shares = model.predict_quantiles(df).agg(*[F.avg((F.col("y_true") < F.col(c)).cast("double")) for c in ("lower", "middle", "upper")]).first()
    assert shares[0] < 0.2 < shares[1] < 0.8 < shares[2]
    assert model.predict(df).where("y_std < 0 or y_std is null").count() == 0


def test_odd_rows(spark):
    """Null targets are left out, null and NaN features go left, outputs that were not fitted get no rows, constant features are never cut."""
    rows = [(i, "y", float(i % 5) if i % 7 else None, 1.0, float(i % 5)) for i in range(60)] + [(90, "y", float("nan"), 1.0, 0.0), (91, "y", 3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "row_id long, output string, x double, c double, y_true double")
    model = boosting.QuantileBoosting(0.8, 3).fit(df, ["x", "c"])
    assert all((t.feature < 1).all() for t in model.trees)
    got = model.predict(df.unionByName(df.limit(1).withColumn("output", F.lit("other")))).collect()
    assert len(got) == 62 and all(np.isfinite(r["y_pred"]) for r in got)
    assert len({r["y_pred"] for r in got if r["row_id"] in (90, 7, 14)}) == 1
    flat = boosting.QuantileBoosting(0.8, 3).fit(df, [])
    assert flat.predict(df).agg(F.count_distinct("y_pred")).first()[0] == 1
    none = boosting.QuantileBoosting(0.8, 3).fit(df.limit(0), ["x"])
    assert none.outputs == [] and none.predict(df).count() == 0


def test_best_cut_takes_the_first_of_equals():
    n = np.array([[2, 2, 0, 2], [2, 2, 2, 0]])
    up = np.array([[2, 0, 0, 2], [0, 0, 2, 2 * 0]])
    feature, cut = boosting.best_cut(n, np.minimum(up, n), 0.5, 1)
    assert (feature, cut) == (1, 1)
    assert boosting.best_cut(n[:, :1], up[:, :1], 0.5, 1) == (None, None)
