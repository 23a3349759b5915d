"""Quantile forecasts of series (series_id, t, value) and their metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import pinball
from tessera.operators.order import quantiles, row_numbers


def check_quantiles(values) -> tuple[float, ...]:
    """Quantile levels as numbers; an error if there are none or one lies outside (0, 1)."""
    out = tuple(float(v) for v in values)
    if not out:
        raise ValueError("give at least one quantile, such as 0.1,0.5,0.9")
    for q in out:
        if not 0 < q < 1:
            raise ValueError(f"quantiles must lie between 0 and 1; got {q}")
    return out


def parse_quantiles(text: str) -> tuple[float, ...]:
    return check_quantiles(x.strip() for x in text.split(",") if x.strip())


def left_padded(series: DataFrame, length: int) -> DataFrame:
    """series_id and context: the last length values of each series in order of t, with zeros before a shorter one."""
    listed = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))  # one series
    values = F.transform(F.slice("s", F.greatest(F.lit(1), F.size("s") - length + 1), length), lambda x: x["value"])
    return listed.select("series_id", F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(values))), values).alias("context"))


def seasonal_bootstrap(y: np.ndarray, horizon: int, quantiles: tuple[float, ...], samples: int, season: int = 1) -> np.ndarray:
    """The last season repeated, plus sums of drawn seasonal differences."""
    m = season if len(y) > season else 1
    base = np.resize(y[-m:], horizon) if len(y) else np.zeros(horizon)
    steps = y[m:] - y[:-m] if len(y) > m else np.zeros(1)
    drawn = np.random.default_rng(len(y)).choice(steps - steps.mean(), (samples, horizon))
    return np.quantile(base + np.cumsum(drawn, 1), quantiles, axis=0)


class Forecaster:
    """fit keeps the series, predict gives id, step, quantile, value; the backend forecasts one series in one task."""

    def __init__(self, backend: Callable = seasonal_bootstrap, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)):
        self.backend, self.quantiles, self.series = backend, quantiles, None

    def fit(self, series: DataFrame) -> Forecaster:
        self.series = series
        return self

    def predict(self, horizon: int, quantiles: tuple[float, ...] | None = None, samples: int = 200) -> DataFrame:
        if self.series is None:
            raise RuntimeError("fit the forecaster first")
        check_quantiles(quantiles or self.quantiles)
        q, backend = tuple(quantiles or self.quantiles), self.backend

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            y = rows.sort_values("t")["value"].dropna().to_numpy(float)
            cube = backend(y, horizon, q, samples)
            step = np.tile(np.arange(1, horizon + 1), len(q))
            return pd.DataFrame({"id": str(rows["series_id"].iloc[0]), "step": step, "quantile": np.repeat(q, horizon), "value": cube.ravel()})

        return self.series.groupBy("series_id").applyInPandas(run, "id string, step int, quantile double, value double")


def median_forecast(forecast: DataFrame) -> DataFrame:
    """The 0.5 quantile, or the mean of all where there is none."""
    return forecast.groupBy("id", "step").agg(F.coalesce(F.max(F.when(F.col("quantile") == 0.5, F.col("value"))), F.avg("value")).alias("median"))


def fan(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """id, step, quantile, value: the history (steps up to 0, no quantile) and what is forecast after it."""
    placed = row_numbers(history.select(F.col("series_id").alias("id"), "t", "value").withColumn("_t", F.col("t").cast("double")), "_t", (), ("id",))
    total = history.groupBy(F.col("series_id").alias("id")).agg(F.count("*").alias("_n"))
    before = placed.join(total, "id").select("id", (F.col("x") - F.col("_n") + 1).cast("int").alias("step"), F.lit(None).cast("double").alias("quantile"), "value")
    return before.unionByName(forecast.select("id", "step", "quantile", "value"))


def residual_quantiles(rows: DataFrame, levels: tuple[float, ...] = (0.1, 0.5, 0.9), by: str = "series_id") -> DataFrame:
    """by and q10, q50 ...: exact quantiles of value - forecast."""
    q = quantiles(rows.select(by, (F.col("value") - F.col("forecast")).alias("e")), "e", list(levels), (by,))
    return q.select(by, *[F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(levels)])


def series_metrics(rows: DataFrame, season: int = 1) -> DataFrame:
    """smape, mase and mae of each series of rows (series_id, t, value, forecast)."""
    w = Window.partitionBy("series_id").orderBy("t")
    lagged = rows.withColumn("d", F.abs(F.col("value") - F.lag("value", season).over(w)))
    e = F.abs(F.col("value") - F.col("forecast"))
    return lagged.groupBy("series_id").agg(F.avg(e).alias("mae"), (100 * F.avg(2 * e / (F.abs("value") + F.abs("forecast") + 1e-8))).alias("smape"), (F.avg(e) / (F.avg("d") + 1e-12)).alias("mase"))


def quantile_loss(rows: DataFrame) -> DataFrame:
    """Mean pinball loss of each quantile of rows (value, forecast, q)."""
    return rows.groupBy("q").agg(F.avg(pinball("value", "forecast")).alias("loss"))
