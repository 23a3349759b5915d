"""The model report: one small table a section, computed from one table of predictions and rendered as HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import design, metrics
from tessera.operators.frames import choose_metrics
from tessera.sources.tables import write_report


def sections(spark: SparkSession, predictions: DataFrame, train: DataFrame | None = None, features: list[str] | None = None, scores: DataFrame | None = None, components=None, selected: int | None = None, dependence: Callable | None = None, shap: Callable | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Name and maker of each section's table; predictions are long (row_id, output, y_true, y_pred, y_std), train has the features."""
    out: dict[str, Callable[[], DataFrame]] = {
        "Metrics": lambda: metrics.flat_metrics(predictions),
        "Metric bars": lambda: choose_metrics(metrics.flat_metrics(predictions).where("output is not null"), ["rmse", "mae", "nll", "miscal_area"]),
        "Uncertainty metrics": lambda: metrics.uq_metrics(predictions),
        "Scoring rules": lambda: metrics.scoring_rules(predictions),
        "Coverage": lambda: metrics.coverage(predictions),
        "Calibration curve": lambda: metrics.calibration(predictions),
        "Calibration area": lambda: metrics.miscalibration_area(metrics.calibration(predictions)),
        "Worst group calibration": lambda: metrics.adversarial_calibration(predictions),
        "Predictions and truth": lambda: metrics.intervals(predictions),
        "Common limits": lambda: metrics.plot_limits(predictions, 2.0),
        "Intervals in order": lambda: metrics.ordered_intervals(predictions),
        "Residuals": lambda: predictions.select("row_id", "output", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual")),
        "Residual trend": lambda: metrics.residual_trend(predictions),
        "Error histogram": lambda: metrics.histogram(predictions.withColumn("e", F.col("y_pred") - F.col("y_true")), "e", 20),
        "Residuals across outputs": lambda: design.pair_histogram(predictions.groupBy("row_id").pivot("output").agg(F.first(F.col("y_true") - F.col("y_pred"))).drop("row_id"), sorted(r[0] for r in predictions.select("output").distinct().collect())),
    }
    if train is not None and features:
        out |= {
            "Inputs": lambda: metrics.box_numbers(train, features),
            "Input pairs": lambda: design.pair_histogram(train, features),
            "Correlation of inputs": lambda: design.correlation_matrix(train, features),
            "Rank correlation of inputs": lambda: design.spearman_matrix(train, features),
            "Missing values": lambda: design.missing_counts(train),
            "Bias of the sample": lambda: design.bias_metrics(train.select(*features)),
            "Sampling method": lambda: design.classify_sampling(train, features, "row_id"),
        }
    if scores is not None:
        out["Search"] = lambda: scores.orderBy("output", F.desc("score"))
    if components is not None:
        out["Principal components"] = lambda: components.scree(spark, selected)
    if dependence is not None:
        out["Partial dependence"] = dependence
    if shap is not None:
        out["Shapley values"] = shap
    return out


def report(path: str, title: str, description: str, made: dict[str, Callable[[], DataFrame]]) -> None:
    """Writes the page; a section that can't be made says why in place of its table."""
    write_report(path, title, description, made)
