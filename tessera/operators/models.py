"""Surrogate models in closed form: aggregates over all rows. estimators.py gives them one interface with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import nearest
from tessera.operators.order import prefix_sums


def ols_fit(train: DataFrame, x: str = "x", y: str = "y_true", by: tuple[str, ...] = ("output",)) -> DataFrame:
    """Slope, intercept and residual deviation of each group; partial sums are combined before the shuffle."""
    s = F.sqrt(F.greatest(F.regr_syy(y, x) / F.count("*") * (1 - F.regr_r2(y, x)), F.lit(0.0)))
    return train.groupBy(*by).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), s.alias("s"))


def ols_predict(rows: DataFrame, fit: DataFrame, x: str = "x", by: tuple[str, ...] = ("output",)) -> DataFrame:
    """fit has one row a group, so it is broadcast."""
    return rows.join(F.broadcast(fit), list(by)).withColumn("y_pred", F.col("a") + F.col("b") * F.col(x)).withColumn("y_std", F.col("s")).drop("a", "b", "s")


def ensemble(members: DataFrame) -> DataFrame:
    """Mean and population deviation over the members' predictions of each row."""
    return members.groupBy("row_id", "output").agg(F.avg("y_pred").alias("y_pred"), F.stddev_pop("y_pred").alias("y_std"))


def bootstrap_ols(train: DataFrame, rows: DataFrame, replicates: DataFrame) -> DataFrame:
    """Weighted least squares for each replicate in closed form, then the ensemble. replicates: row_id, output, x, y_true, replicate, weight."""
    w, x, y = F.col("weight"), F.col("x"), F.col("y_true")
    s = replicates.groupBy("output", "replicate").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    b = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / (F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    fits = s.withColumn("b", b).select("output", "replicate", "b", ((F.col("wy") - F.col("b") * F.col("wx")) / F.col("w")).alias("a"))
    return ensemble(rows.join(F.broadcast(fits), "output").withColumn("y_pred", F.col("a") + F.col("b") * F.col("x")))  # outputs x replicates rows


def stump(train: DataFrame, x: str = "x", y: str = "y_true", by: str = "output") -> DataFrame:
    """Best single split of each output by squared error, over prefix sums of distinct x."""
    g = train.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    total = g.groupBy(by).agg(F.sum("n").alias("nt"), F.sum("s").alias("st"))
    placed = prefix_sums(g, x, {"nb": F.col("n"), "sb": F.col("s"), "place": F.lit(1).cast("long")}, by=(by,))
    left = placed.select(by, F.col(x).alias("lo"), (F.col("nb") + F.col("n")).alias("nl"), (F.col("sb") + F.col("s")).alias("sl"), "place")
    right = placed.select(by, F.col(x).alias("hi"), (F.col("place") - 1).alias("place"))
    cut = left.join(right, [by, "place"]).join(F.broadcast(total), by)  # one row an output
    gain = F.col("sl") * F.col("sl") / F.col("nl") + F.pow(F.col("st") - F.col("sl"), 2) / (F.col("nt") - F.col("nl"))
    best = cut.withColumn("gain", gain).groupBy(by).agg(F.max_by(F.struct(((F.col("lo") + F.col("hi")) / 2).alias("threshold"), (F.col("sl") / F.col("nl")).alias("left_mean"), ((F.col("st") - F.col("sl")) / (F.col("nt") - F.col("nl"))).alias("right_mean")), F.struct(F.round("gain", 6), -F.col("lo"))).alias("m"))
    return best.select(by, "m.threshold", "m.left_mean", "m.right_mean")


def knn(train: DataFrame, queries: DataFrame, features: list[str], y: str, k: int, id_col: str) -> DataFrame:
    """Mean and population deviation of the k nearest training rows of each query, in bounded sets of queries against all rows."""
    near = nearest(train, queries, id_col, features, k, y)
    return near.groupBy("row_id").agg(F.avg("payload").alias("y_pred"), F.stddev_pop("payload").alias("y_std"))
