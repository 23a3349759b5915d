"""Shapley values of Spark ML trees, forests and boosted trees, without a bound on features.

The game is the usual one of trees alone: a coalition's value is the mean of the leaves that a row can reach when the
features outside the coalition follow both branches, in proportion to the training rows there.

A model is read as a flat table of nodes and turned into one table of paths: for each leaf and each feature on its way,
the interval of values that stay on the way and the share of training rows that do. A leaf's part in a feature's value is
an integral over [0, 1] of a polynomial, the product of z (1 - t) + o t over the leaf's other features (z: the share, o:
whether the row stays); it is taken exactly at Gauss-Legendre points, for a batch of rows at a time. The cost is rows times
leaves times the square of the depth, and no coalition is listed.

A model's cuts part the rows into cells whose rows have the same values: a batch's cells are taken once each, and means over
all rows (``mean_absolute_shap``) count the rows of each cell in Spark and take values of cells alone.

Values of all features and the expected value add up to the prediction. A NaN goes right at every cut, as in prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import search_sorted
from tessera.operators.written import shared_folder

#: Numbers that one numpy pass over a batch holds.
_BLOCK = 2_000_000


def node_table(model, spark) -> DataFrame:
    """tree, node, prediction, n (training rows), left, right (-1 in leaves), feature and threshold of a fitted regressor."""
    path = f"{shared_folder(spark)}/tessera/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in stored.columns else ""
    tree = F.col("treeID") if "treeID" in stored.columns else F.lit(0)
    split = f"{node}split"
    return stored.select(
        tree.alias("tree"), F.col(f"{node}id").alias("node"), F.col(f"{node}prediction").alias("prediction"), F.col(f"{node}rawCount").alias("n"), F.col(f"{node}leftChild").alias("left"), F.col(f"{node}rightChild").alias("right"),
        F.col(f"{split}.featureIndex").alias("feature"), F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), (F.col(f"{split}.numCategories") >= 0).alias("categorical"),
    )


class Paths:
    """Leaves of a model: value (times the tree's weight) and, for each feature of its way, low, high (the row stays where low < x <= high) and share."""

    def __init__(self, model, spark):
        weights = list(getattr(model, "treeWeights", [1.0]))
        forest = type(model).__name__.startswith("RandomForest")
        nodes = {(r["tree"], r["node"]): r for r in node_table(model, spark).collect()}  # the model's nodes
        if any(r["categorical"] and r["left"] >= 0 for r in nodes.values()):
            raise ValueError("cuts between categories are not supported")
        self.leaves: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for tree in sorted({t for t, _ in nodes}):
            scale = 1 / len(weights) if forest else weights[tree]
            stack = [(0, {})]
            while stack:
                at, way = stack.pop()
                r = nodes[tree, at]
                if r["left"] < 0:
                    f = sorted(way)
                    self.leaves.append((scale * r["prediction"], np.array(f, int), *(np.array([way[k][i] for k in f], float) for i in range(3))))
                    continue
                low, high, share = way.get(r["feature"], (-np.inf, np.inf, 1.0))
                for child, ends in ((r["left"], (low, min(high, r["threshold"]))), (r["right"], (max(low, r["threshold"]), high))):
                    stack.append((child, way | {r["feature"]: (*ends, share * nodes[tree, child]["n"] / r["n"])}))
        self.expected = float(sum(v * s.prod() for v, _, _, _, s in self.leaves))

    def cuts(self, feature: int) -> np.ndarray:
        """The model's thresholds of a feature, ascending: rows between the same two of every feature have the same values."""
        ends = [x[f == feature] for _, f, low, high, _ in self.leaves for x in (low, high)]
        found = np.unique(np.concatenate([np.zeros(0), *ends]))
        return found[np.isfinite(found)]

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row and feature."""
        cuts = [self.cuts(j) for j in range(x.shape[1])]
        shape = [len(c) + 1 for c in cuts]
        if not len(x) or prod(shape) >= 1 << 62:
            return self._values(x)
        cells = np.ravel_multi_index([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], shape)
        _, first, cell = np.unique(cells, return_index=True, return_inverse=True)
        return self._values(x[first])[cell]

    def _values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        deepest = max((len(f) for _, f, *_ in self.leaves), default=1) or 1
        for at in range(0, len(x), max(1, _BLOCK // (deepest * deepest))):
            rows = slice(at, at + max(1, _BLOCK // (deepest * deepest)))
            part = x[rows]
            for value, f, low, high, share in self.leaves:
                if not len(f):
                    continue
                points, weights = _gauss((len(f) + 1) // 2)
                there = part[:, f]
                stays = (~(there <= low) & ((there <= high) | np.isinf(high))).astype(float)
                factor = share[None, None] * (1 - points)[None, :, None] + stays[:, None, :] * points[None, :, None]
                whole = factor.prod(axis=2, keepdims=True) * weights[None, :, None]
                out[rows, f] += value * (stays - share) * (whole / factor).sum(axis=1)
        return out


def _gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [0, 1] that integrate polynomials up to degree 2n - 1 exactly."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def tree_shap(model, rows: DataFrame, features: list[str], key: list[str] | None = None) -> DataFrame:
    """key (default: row_id), phi (one number a feature) and expected (the value without any feature) of every row, for a fitted Spark ML regressor of trees."""
    return _path_shap(Paths(model, rows.sparkSession), rows, features, key or ["row_id"])


def _path_shap(paths: Paths, rows: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(paths)  # as large as the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f"x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))], axis=1)
            phi = shared.value.values(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features)), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), lists, pa.array(np.full(len(x), shared.value.expected))], [*key, "phi", "expected"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    some = rows.select(*key, *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    return some.mapInArrow(run, f"{kinds}, phi array<double>, expected double")


def estimator_shap(estimator, rows: DataFrame) -> DataFrame:
    """row_id, output, phi and expected of the rows of each output of a fitted tree estimator (estimators.Tree, Forest or Boosting)."""
    out = None
    for output, model in estimator.fitted.items():
        part = tree_shap(model, rows.where(F.col("output") == output), estimator.assembler.getInputCols(), ["row_id", "output"])
        out = part if out is None else out.unionByName(part)
    return out


def cell_counts(paths: Paths, rows: DataFrame, features: list[str]) -> DataFrame:
    """The features of one row of each cell that rows have, and n, the cell's number of rows. A null counts as NaN, right of every cut."""
    cells = [f"_cell{j}" for j in range(len(features))]
    x = rows.select([F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in features])
    for j, (c, cell) in enumerate(zip(features, cells)):
        x = search_sorted(x, F.col(c), paths.cuts(j).tolist(), cell)
    return x.groupBy(cells).agg(*[F.min(c).alias(c) for c in features], F.count("*").alias("n")).drop(*cells)


def mean_absolute_shap(estimator, rows: DataFrame) -> DataFrame:
    """mean_absolute_by_output of estimator_shap, from the values of cells and their numbers of rows: no row goes through Python."""
    out, features = None, estimator.assembler.getInputCols()
    for output, model in estimator.fitted.items():
        paths = Paths(model, rows.sparkSession)
        values = _path_shap(paths, cell_counts(paths, rows.where(F.col("output") == output), features), features, ["n"])
        means = values.groupBy(F.lit(output).alias("output")).agg(*[(F.sum(F.abs(F.get("phi", F.lit(j))) * F.col("n")) / F.sum("n")).alias(c) for j, c in enumerate(features)])
        part = means.unpivot(["output"], features, "feature", "mean_abs_shap")
        out = part if out is None else out.unionByName(part)
    return out


def mean_absolute_by_output(values: DataFrame, features: list[str]) -> DataFrame:
    """output, feature and mean_abs_shap: the mean absolute value over each output's rows."""
    wide = values.groupBy("output").agg(*[F.avg(F.abs(F.get("phi", F.lit(i)))).alias(c) for i, c in enumerate(features)])
    return wide.unpivot(["output"], features, "feature", "mean_abs_shap")
