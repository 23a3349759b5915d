"""Accuracy and uncertainty metrics of long prediction tables, each in one aggregate over one scan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.quantiles import central_z
from tessera.operators.frames import STD_FLOOR, clip_std, hash_unit
from tessera.operators.order import quantiles, row_numbers, search_sorted

LEVELS = (0.5, 0.68, 0.8, 0.9, 0.95, 0.99)


def _residual():
    return F.col("y_true") - F.col("y_pred")


def metric_columns():
    r = _residual()
    z = r / clip_std(F.col("y_std"))
    nll = 0.5 * F.ln(2 * math.pi * F.pow(clip_std(F.col("y_std")), 2)) + 0.5 * z * z
    return [
        F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"),
        (1 - F.sum(r * r) / (F.var_pop("y_true") * F.count("*"))).alias("r2"), F.avg(nll).alias("nll"),
        F.sqrt(F.avg(F.col("y_std") * F.col("y_std"))).alias("sharpness"), F.avg("y_std").alias("mean_predicted_std"),
    ]


def uq_metrics(predictions: DataFrame) -> DataFrame:
    """One row an output and one, with output null, over all."""
    return predictions.groupingSets([["output"], []], "output").agg(*metric_columns())


def coverage(predictions: DataFrame, levels=LEVELS) -> DataFrame:
    """output, level, empirical: the share of rows inside pred +- z std, one pass with a column a level."""
    z = F.abs(_residual()) / clip_std(F.col("y_std"))
    wide = predictions.groupBy("output").agg(*[F.avg((z <= central_z(p)).cast("double")).alias(f"p{i}") for i, p in enumerate(levels)])
    return wide.select("output", F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"p{i}").alias("empirical")) for i, p in enumerate(levels)])).alias("c")).select("output", "c.level", "c.empirical")


def calibration(predictions: DataFrame, n: int = 100, overall: bool = False) -> DataFrame:
    """output, k, expected, observed over n levels; with overall also over all rows, with output null.

    Rows are counted once, at the first level that holds them (binary search over the levels); the rest is sums over
    n counts an output, so the predictions are read and computed in one pass.
    """
    z = F.abs(_residual()) / clip_std(F.col("y_std"))
    placed = search_sorted(predictions.select("output", z.alias("_z")), F.col("_z"), [central_z(k / (n - 1)) for k in range(n - 1)], "k")
    counts = placed.groupBy("output", "k").agg(F.count("*").alias("c"))
    if overall:
        counts = counts.groupingSets([["output", "k"], ["k"]], "output", "k").agg(F.sum("c").alias("c"))
    levels = counts.groupBy("output").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"), F.sum("c").alias("total"))
    up_to = F.expr(f"transform(sequence(0, {n - 1}), k -> aggregate(sequence(0, k), 0L, (s, j) -> s + coalesce(m[j], 0L)))")
    curve = levels.select("output", "total", F.posexplode(up_to).alias("k", "c"))
    return curve.select("output", "k", (F.col("k") / (n - 1)).alias("expected"), (F.col("c") / F.col("total")).alias("observed"))


def miscalibration_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area between the curve and the diagonal."""
    w = Window.partitionBy("output").orderBy("k")
    gap = F.abs(F.col("expected") - F.col("observed"))
    step = (F.lead("expected").over(w) - F.col("expected")) * (F.lead(gap).over(w) + gap) / 2
    return curve.select("output", step.alias("a")).groupBy("output").agg(F.sum("a").alias("miscal_area"))


def flat_metrics(predictions: DataFrame) -> DataFrame:
    """output, rmse, mae, nll, miscal_area of each output, and over all rows with output null."""
    parts = uq_metrics(predictions).select("output", "rmse", "mae", "nll")
    area = miscalibration_area(calibration(predictions, overall=True)).withColumnRenamed("output", "_o")
    return parts.join(area, F.col("output").eqNullSafe(F.col("_o"))).drop("_o")


def nested_metrics(predictions: DataFrame) -> DataFrame:
    """output and the groups accuracy (rmse, mae, mdae, marpd, r2, corr), avg_calibration (rms_cal, ma_cal, miscal_area), sharpness (sharp) and scoring_rule (nll, crps, check, interval)."""
    r, s = _residual(), clip_std(F.col("y_std"))
    marpd = F.abs(2 * r / (F.abs(F.col("y_true")) + F.abs(F.col("y_pred")))) * 100
    z = r / s
    base = predictions.groupBy("output").agg(
        F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), (1 - F.sum(r * r) / (F.var_pop("y_true") * F.count("*"))).alias("r2"), F.corr("y_true", "y_pred").alias("corr"),
        F.struct(F.sqrt(F.avg(s * s)).alias("sharp")).alias("sharpness"),
        F.avg(0.5 * F.ln(2 * math.pi * s * s) + 0.5 * z * z).alias("_nll"),
    )
    middle = lambda v, name: quantiles(predictions.select("output", v.alias("e")), "e", [0.5], ("output",)).select("output", F.col("q")[0].alias(name))
    base = base.join(middle(F.abs(r), "mdae"), "output").join(middle(marpd, "marpd"), "output")
    base = base.withColumn("accuracy", F.struct("rmse", "mae", "mdae", "marpd", "r2", "corr"))
    curve = calibration(predictions)
    gap = F.col("expected") - F.col("observed")
    cal = curve.groupBy("output").agg(F.sqrt(F.avg(gap * gap)).alias("rms_cal"), F.avg(F.abs(gap)).alias("ma_cal"))
    cal = cal.join(miscalibration_area(curve), "output").select("output", F.struct("rms_cal", "ma_cal", "miscal_area").alias("avg_calibration"))
    scores = scoring_rules(predictions).withColumnRenamed("n", "_n")
    out = base.join(cal, "output").join(scores, "output")  # one row an output
    return out.select("output", "accuracy", "avg_calibration", "sharpness", F.struct(F.col("_nll").alias("nll"), "crps", "check", "interval").alias("scoring_rule"))


def scoring_rules(predictions: DataFrame, levels: int = 99) -> DataFrame:
    """output, n, crps, check and interval score of normal predictions; the latter two are means over levels 0.01 to 0.99.

    Every batch gives sums for each output; only these are shuffled.
    """
    import numpy as np
    import pandas as pd

    p = np.linspace(0.01, 0.99, levels)
    half = np.array([central_z(q) for q in p])
    quantile = np.array([central_z(abs(2 * q - 1)) * (1 if q >= 0.5 else -1) for q in p])
    erf = np.vectorize(math.erf, otypes=[float])

    def run(batches):
        for b in batches:
            for o, g in b.groupby("output", dropna=False):
                y, m, s = (g[c].to_numpy(float) for c in ("y_true", "y_pred", "y_std"))
                s = np.maximum(np.abs(s), STD_FLOOR)
                z = (y - m) / s
                crps = s * (z * erf(z / math.sqrt(2)) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
                check, interval = np.zeros(len(y)), np.zeros(len(y))
                for q, a, h in zip(p, quantile, half):
                    d = y - (m + a * s)
                    check += np.maximum(q * d, (q - 1) * d)
                    low, high = m - h * s, m + h * s
                    interval += (high - low) + 2 / (1 - q) * (np.maximum(low - y, 0) + np.maximum(y - high, 0))
                yield pd.DataFrame({"output": [o], "n": [len(y)], "crps": [crps.sum()], "check": [check.sum() / levels], "interval": [interval.sum() / levels]})

    sums = predictions.select("output", "y_true", "y_pred", "y_std").mapInPandas(run, "output string, n long, crps double, check double, interval double")
    return sums.groupBy("output").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("crps", "check", "interval")])


def adversarial_calibration(predictions: DataFrame, sizes: int = 10, draws: int = 10, n: int = 100) -> DataFrame:
    """output, share, ma_cal: the worst mean absolute calibration error of draws random groups of each share of the rows.

    A group holds the rows whose hash of row_id and draw lies below the share; levels are counted as in calibration().
    """
    z = F.abs(_residual()) / clip_std(F.col("y_std"))
    placed = search_sorted(predictions.select("row_id", "output", z.alias("_z")), F.col("_z"), [central_z(k / (n - 1)) for k in range(n - 1)], "k")
    # how many shares hold the row in a draw: groups are nested, so each row counts once a draw
    u = hash_unit(F.concat_ws("#", F.col("row_id").cast("string"), F.col("draw").cast("string")))
    drawn = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("size", F.least(F.lit(sizes), F.floor(u * sizes) + 1).cast("int"))
    counts = drawn.groupBy("output", "draw", "size", "k").agg(F.count("*").alias("c"))
    wide = counts.select("output", "draw", "k", "c", F.explode(F.sequence(F.col("size"), F.lit(sizes))).alias("size")).groupBy("output", "draw", "size", "k").agg(F.sum("c").alias("c"))
    levels = wide.groupBy("output", "draw", "size").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"), F.sum("c").alias("total"))  # n levels
    error = F.expr(f"aggregate(transform(sequence(0, {n - 1}), k -> abs(k / {n - 1} - aggregate(sequence(0, k), 0L, (s, j) -> s + coalesce(m[j], 0L)) / total)), 0D, (s, x) -> s + x) / {n}")
    return levels.select("output", (F.col("size") / sizes).alias("share"), error.alias("e")).groupBy("output", "share").agg(F.max("e").alias("ma_cal"))


def histogram(values: DataFrame, column: str, bins: int, by: str = "output") -> DataFrame:
    """Equal bins from least to greatest, the last one closed; empty bins have count 0."""
    ends = values.groupBy(by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(column) - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(0)).cast("int"))  # one value alone: the first bin
    counts = values.join(F.broadcast(ends), by).groupBy(by, "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"))  # one row a group
    tall = counts.groupBy(by, "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    spread = tall.select(by, "lo", "hi", F.col("m"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spread.select(by, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"), F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).cast("long").alias("n"))


def box_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, low, q1, median, q3, high: ends and exact quartiles."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    q = quantiles(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ("feature",))
    return q.select("feature", *[F.col("q")[i].alias(name) for i, name in enumerate(("low", "q1", "median", "q3", "high"))])


def compare_rmse(predictions: DataFrame, models: dict[str, str]) -> DataFrame:
    """output and the root mean squared error of each column of predictions that models names, in one aggregate."""
    return predictions.groupBy("output").agg(*[F.sqrt(F.avg(F.pow(F.col("y_true") - F.col(c), 2))).alias(name) for name, c in models.items()])


def plot_limits(predictions: DataFrame, k: float = 0.0) -> DataFrame:
    """Common limits over all rows: floor of the least and ceiling of the greatest prediction, k deviations out."""
    return predictions.agg(F.floor(F.min(F.col("y_pred") - k * F.col("y_std"))).alias("low"), F.ceil(F.max(F.col("y_pred") + k * F.col("y_std"))).alias("high"))


def residual_trend(predictions: DataFrame) -> DataFrame:
    """Least-squares line of residual on prediction, and padded limits."""
    t = predictions.select("output", "y_pred", _residual().alias("r"))
    pad = 0.1 * (F.max("r") - F.min("r") + 1e-8)
    return t.groupBy("output").agg(F.regr_slope("r", "y_pred").alias("slope"), F.regr_intercept("r", "y_pred").alias("intercept"), (F.min("r") - pad).alias("low"), (F.max("r") + pad).alias("high"), F.floor(F.min("y_pred")).alias("x_low"), F.ceil(F.max("y_pred")).alias("x_high"))


def intervals(predictions: DataFrame, alpha: float = 0.05) -> DataFrame:
    z = central_z(1 - alpha)
    return predictions.select("row_id", "output", "y_true", "y_pred", (F.col("y_pred") - z * F.col("y_std")).alias("lower"), (F.col("y_pred") + z * F.col("y_std")).alias("upper"))


def ordered_intervals(predictions: DataFrame, order_by: str = "y_true", k: float = 2.0) -> DataFrame:
    placed = row_numbers(predictions.select("output", "row_id", "y_true", "y_pred", "y_std"), order_by, ("row_id",), ("output",))
    return placed.select("output", F.col("x").cast("long").alias("x"), "row_id", "y_true", "y_pred", (F.col("y_pred") - k * F.col("y_std")).alias("lower"), (F.col("y_pred") + k * F.col("y_std")).alias("upper"))


def pinball(actual: str, forecast: str, q: str = "q"):
    d = F.col(actual) - F.col(forecast)
    return F.greatest(F.col(q) * d, (F.col(q) - 1) * d)


def pinball(rows: DataFrame, levels: dict[float, str]) -> DataFrame:
    """level, n and pinball: the mean quantile loss of each predicted quantile (level to column) against y_true."""
    loss = lambda q, c: F.avg(F.when(F.col("y_true") >= F.col(c), q * (F.col("y_true") - F.col(c))).otherwise((q - 1) * (F.col("y_true") - F.col(c))))
    wide = rows.agg(F.count("*").alias("n"), *[loss(q, c).alias(f"p{i}") for i, (q, c) in enumerate(levels.items())])
    each = F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col("n"), F.col(f"p{i}").alias("pinball")) for i, q in enumerate(levels)])
    return wide.select(F.explode(each).alias("x")).select("x.*")
