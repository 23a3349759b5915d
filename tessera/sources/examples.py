"""Made tables: regression problems and sampling designs; each row's numbers come from hashes of its number, so runs repeat."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.frames import hash_unit


def uniform(*salt) -> Column:
    return hash_unit(F.concat_ws(":", F.col("id"), *[F.lit(str(s)) for s in salt]))


def normal(*salt) -> Column:
    """Two uniform numbers make one normal number."""
    return F.sqrt(-2 * F.ln(F.greatest(uniform(*salt, "a"), F.lit(1e-12)))) * F.cos(2 * math.pi * uniform(*salt, "b"))


def linear_problem(spark: SparkSession, rows: int = 200, features: int = 5, targets: int = 3, noise: float = 0.0, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """row_id, x0 .., y0 ..: normal features and targets x @ w + noise; also w (features x targets)."""
    w = np.random.default_rng(seed).uniform(0, 100, (features, targets))
    x = spark.range(rows).select("id", *[normal(seed, "x", j).alias(f"x{j}") for j in range(features)])
    y = []
    for t in range(targets):
        total = F.lit(0.0)
        for j in range(features):
            total = total + F.col(f"x{j}") * float(w[j, t])
        y.append((total + float(noise) * normal(seed, "noise", t)).alias(f"y{t}"))
    return x.select(F.col("id").alias("row_id"), *[f"x{j}" for j in range(features)], *y), w


def nonlinear_problem(spark: SparkSession, rows: int = 200, seed: int = 0) -> DataFrame:
    x = spark.range(rows).select("id", uniform(seed, 0).alias("x0"), uniform(seed, 1).alias("x1"))
    return x.select(F.col("id").alias("row_id"), "x0", "x1", (F.sin(2 * math.pi * F.col("x0")) + F.col("x1") ** 2).alias("y0"), (F.cos(2 * math.pi * F.col("x1")) * F.col("x0")).alias("y1"))


def fidelity_problem(spark: SparkSession, rows: int = 100, levels: tuple[str, ...] = ("low", "medium", "high"), seed: int = 0) -> DataFrame:
    """level, row_id, x0, y0: the same curve with less error at each level."""
    out = None
    for k, level in enumerate(levels):
        x = spark.range(rows).select("id", uniform(seed, k).alias("x0"))
        part = x.select(F.lit(level).alias("level"), F.col("id").alias("row_id"), "x0", (F.sin(6 * F.col("x0")) + normal(seed, "e", k) * (0.3 / (k + 1) ** 2)).alias("y0"))
        out = part if out is None else out.unionByName(part)
    return out


def imbalanced_runs(spark: SparkSession, rows: int = 300, share: float = 0.9, minutes: int = 5, start: str = "2024-01-01 00:00:00", seed: int = 0) -> DataFrame:
    """row_id, t (a step of minutes), kind (A for a share of rows, else B), x0, y0."""
    t = F.lit(start).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * minutes).cast("int"))
    return spark.range(rows).select(F.col("id").alias("row_id"), t.alias("t"), F.when(uniform(seed, "k") < share, "A").otherwise("B").alias("kind"), uniform(seed, 0).alias("x0"), normal(seed, 1).alias("y0"))


def drifting_runs(spark: SparkSession, rows: int = 300, drift: float = 2.0, seed: int = 0) -> DataFrame:
    """row_id, x0, y0: the mean of y0 moves by drift from the first row to the last."""
    return spark.range(rows).select(F.col("id").alias("row_id"), uniform(seed, 0).alias("x0"), (normal(seed, 1) + F.col("id") * (drift / max(rows - 1, 1))).alias("y0"))


def square_grid(spark: SparkSession, side: int = 10) -> DataFrame:
    """row_id, x0, x1 on a grid over [0, 1], with their product and squares."""
    at = lambda c: c.cast("double") / max(side - 1, 1)
    x = spark.range(side * side).select(F.col("id").alias("row_id"), at(F.floor(F.col("id") / side)).alias("x0"), at(F.pmod("id", F.lit(side))).alias("x1"))
    return x.select("*", (F.col("x0") * F.col("x1")).alias("x0_x1"), (F.col("x0") ** 2).alias("x0_squared"), (F.col("x1") ** 2).alias("x1_squared"))
