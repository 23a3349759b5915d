"""Partial dependence and Shapley values."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import quantiles


def linear_shap(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean absolute Shapley value of each feature of a linear model: |w| times the mean absolute distance from the mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    wide = df.agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - means[c]))).alias(c) for c, w in weights.items()])
    return wide.unpivot([], list(weights), "feature", "mean_abs_shap")


def linear_pdp(df: DataFrame, intercept: float, weights: dict[str, float], feature: str, points: int = 100) -> DataFrame:
    """Mean prediction with feature set to each of points values between its 5th and 95th percentile; linear, so means suffice."""
    s = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    low, high = quantiles(df, feature, [0.05, 0.95]).first()["q"]
    rest = intercept + sum(w * s[c] for c, w in weights.items() if c != feature)
    grid = F.lit(low) + F.col("id") * ((high - low) / (points - 1))
    return df.sparkSession.range(points).select(F.lit(feature).alias("feature"), F.col("id").alias("k"), grid.alias("value"), (rest + weights[feature] * grid).alias("mean_prediction"))


def partial_dependence(predict, df: DataFrame, features: list[str], feature: str, points: int = 100, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """output, feature, k, value, mean_prediction: predictions of all rows with feature set to each value of a grid between two quantiles.

    predict takes a long table (row_id, output, features) and gives y_pred; a feature of few values has these as its grid.
    """
    spark = df.sparkSession
    ends = df.agg(F.percentile_approx(F.col(feature).cast("double"), [low, high], 10_000).alias("q"), F.count_distinct(feature).alias("n")).first()
    if ends["n"] <= points:
        values = sorted(float(r[0]) for r in df.select(feature).where(F.col(feature).isNotNull()).distinct().collect())  # at most points
    else:
        values = np.linspace(*[float(v) for v in ends["q"]], points).tolist()
    grid = F.broadcast(spark.createDataFrame(list(enumerate(values)), "k long, value double"))
    # every row at every value, by definition; the key holds the value's number, so nothing is joined back by row
    wide = df.select(F.col("row_id").alias("_row"), "output", *[c for c in features if c != feature]).crossJoin(grid).withColumn(feature, F.col("value"))
    numbered = wide.select((F.col("_row") * len(values) + F.col("k")).alias("row_id"), "output", *features)
    k = F.pmod(F.col("row_id"), F.lit(max(len(values), 1))).alias("k")
    means = predict(numbered).groupBy("output", k).agg(F.avg("y_pred").alias("mean_prediction"))
    return means.join(grid, "k").withColumn("feature", F.lit(feature))


def background_rows(df: DataFrame, features: list[str], key: str = "row_id", most: int = 100) -> np.ndarray:
    """The features of at most `most` rows, those of the least md5 of key (then key): a bounded background that repeats on every run."""
    picked = df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).na.drop("any").orderBy(F.md5(F.col(key).cast("string")), key).limit(most)
    return picked.toPandas()[features].to_numpy(float)


def shap_values(predict, rows: DataFrame, features: list[str], background: np.ndarray) -> DataFrame:
    """row_id and phi (one number a feature): exact Shapley values of every row by all coalitions against a small background.

    predict maps a numpy matrix to predictions; at most ten features.
    """
    if len(features) > 10:
        raise ValueError("more than ten features")
    base = np.asarray(background, float)

    def run(batches):
        for b in batches:
            if len(b):
                phi = exact_shap(predict, b[features].to_numpy(float), base)
                yield b[["row_id"]].assign(phi=list(phi))

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.select("row_id", *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, f"row_id {kind}, phi array<double>")


def mean_absolute_shap(values: DataFrame, features: list[str]) -> DataFrame:
    """feature and the mean absolute Shapley value over rows."""
    wide = values.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(c) for i, c in enumerate(features)])
    return wide.unpivot([], features, "feature", "mean_abs_shap")


def exact_shap(predict, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Shapley values by all coalitions of features (at most ten), absent ones averaged over the background."""
    d = x.shape[1]
    if d > 10:
        raise ValueError("more than ten features")
    value = {}
    for r in range(d + 1):
        for s in combinations(range(d), r):
            mixed = np.repeat(background[None], len(x), 0)
            mixed[:, :, list(s)] = x[:, None, list(s)]
            value[s] = predict(mixed.reshape(-1, d)).reshape(len(x), -1).mean(1)
    out = np.zeros_like(x, dtype=float)
    for j in range(d):
        for s in value:
            if j not in s:
                out[:, j] += factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (value[tuple(sorted((*s, j)))] - value[s])
    return out
