"""Quantile gradient boosting over all rows: histograms of binned features, a level of every tree at a time.

All outputs and all three quantiles grow together. A level is one aggregate: tasks count rows and positive residuals by
tree, node, feature and bin (whole numbers, so the sums do not depend on how rows are dealt), Spark adds the counts up,
and the best cut of each node is found where its counts meet. Leaves get a quantile of their residuals by a mergeable
sketch (exact up to about ACCURACY rows a leaf, within 1 / ACCURACY of the rank beyond). To the driver come one row a
node and one a leaf. Predictions so far are carried along in a written table, which is renewed every few rounds.

A row without a target is left out; a feature that is null or NaN falls into the lowest bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import quantiles
from tessera.operators.written import dropped, written

#: Rank error of a leaf's sketch is one part in so many.
ACCURACY = 100_000
_LEAST_GAIN = 1e-12


def bin_edges(train: DataFrame, features: list[str], bins: int) -> dict[str, list[np.ndarray]]:
    """Ascending inner edges of each output's features: between all neighbouring values where there are no more than bins, else at exact quantiles."""
    out: dict[str, list[np.ndarray]] = {}
    for r in train.select("output").distinct().collect():  # the outputs
        out[r["output"]] = [np.zeros(0)] * len(features)
    for j, c in enumerate(features):
        rows = train.select("output", F.col(c).cast("double").alias("v")).where("v is not null and not isnan(v)")
        counts = {r["output"]: r["n"] for r in rows.groupBy("output").agg(F.approx_count_distinct("v", 0.02).alias("n")).collect()}
        few = [o for o, n in counts.items() if n <= bins * 1.1]
        got: dict[str, list[float]] = {}
        if few:  # some more than bins values an output at most
            for r in rows.where(F.col("output").isin(few)).groupBy("output").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():
                if len(r["v"]) <= bins:
                    values = np.array(r["v"])
                    out[r["output"]][j] = (values[1:] + values[:-1]) / 2
                    got[r["output"]] = r["v"]
        many = [o for o in counts if o not in got]
        if many:
            for r in quantiles(rows.where(F.col("output").isin(many)), "v", [k / bins for k in range(1, bins)], ("output",)).collect():
                out[r["output"]][j] = np.unique(np.array(r["q"], float))
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """How many edges lie below each value (NaN: none)."""
    out = np.zeros(x.shape, np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left"))
    return out


class Trees:
    """One tree for each of several groups (an output and a quantile), as arrays in the order of a heap."""

    def __init__(self, groups: int, depth: int):
        self.feature = np.full((groups, 2 ** (depth + 1) - 1), -1, np.int32)
        self.cut = np.zeros((groups, 2 ** (depth + 1) - 1), np.int32)
        self.value = np.zeros((groups, 2 ** (depth + 1) - 1))
        self.depth = depth

    def leaf(self, group: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; rows whose bin is at most the cut go left."""
        node, row = np.zeros(len(group), np.int64), np.arange(len(group))
        for _ in range(self.depth):
            f = self.feature[group, node]
            right = bins[row, np.maximum(f, 0)] > self.cut[group, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


class QuantileBoosting:
    """Boosted trees for the quantiles 1 - alpha, 1/2 and alpha of each output; y_pred is the middle one, y_std half the distance of the others, never negative."""

    def __init__(self, alpha: float = 0.95, n_estimators: int = 50, max_depth: int = 3, learning_rate: float = 0.1, max_bins: int = 64, min_rows: int = 2, refresh: int = 10):
        if not 2 <= max_bins <= 4096 or not 0.5 < alpha < 1:
            raise ValueError("max_bins must be 2 to 4096 and alpha between 1/2 and 1")
        self.levels = (round(1 - alpha, 12), 0.5, alpha)
        self.rounds, self.depth, self.rate, self.bins, self.min_rows, self.refresh = n_estimators, max_depth, learning_rate, max_bins, min_rows, refresh

    # fitting

    def fit(self, train: DataFrame, features: list[str]) -> QuantileBoosting:
        self.features, self.trees = features, []
        rows = train.select("output", F.col("y_true").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).where("y is not null and not isnan(y)")
        sketch = F.percentile_approx("y", list(self.levels), ACCURACY)
        base = {r["output"]: r["q"] for r in rows.groupBy("output").agg(sketch.alias("q")).collect()}  # one row an output
        self.outputs = sorted(base, key=lambda o: (o is None, o))
        self.base = np.array([base[o] for o in self.outputs], float).reshape(len(self.outputs), 3)
        edges = bin_edges(rows, features, self.bins)
        self.edges = [edges[o] for o in self.outputs]
        state = written(self._binned_rows(rows), "binned-rows")
        fresh = 0  # trees before this one are counted in the state's predictions
        for t in range(self.rounds):
            if t - fresh == self.refresh:
                newer = written(self._advanced(state, self.trees[fresh:]), "binned-rows")
                dropped(state)
                state, fresh = newer, t
            trees, since = Trees(3 * len(self.outputs), self.depth), self.trees[fresh:]
            for level in range(self.depth):
                cuts = self._cuts(state, since, trees, level)
                for r in cuts:
                    trees.feature[r["tree"], r["node"]], trees.cut[r["tree"], r["node"]] = r["feature"], r["cut"]
                if not cuts:
                    break
            for r in self._leaves(state, since, trees):
                trees.value[r["tree"], r["leaf"]] = r["q"][r["tree"] % 3]
            self.trees.append(trees)
        dropped(state)
        return self

    def _fields(self) -> list[str]:
        return [f"b{j}" for j in range(len(self.features))]

    def _binned_rows(self, rows: DataFrame) -> DataFrame:
        outputs, edges, base, features, fields = {o: i for i, o in enumerate(self.outputs)}, self.edges, self.base, self.features, self._fields()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = np.array([outputs[o] for o in b.column("output").to_pylist()], np.int64)
                x, bins = _numbers(b, features), np.zeros((b.num_rows, len(features)), np.int16)
                for o in np.unique(code):
                    bins[code == o] = _binned(x[code == o], edges[o])
                f = base[code]
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), b.column("y"), *(pa.array(bins[:, j]) for j in range(bins.shape[1])), *(pa.array(f[:, k]) for k in range(3))], ["o", "y", *fields, "f0", "f1", "f2"])

        return rows.mapInArrow(run, self._schema())

    def _schema(self) -> str:
        return ", ".join(["o int, y double", *(f"{c} short" for c in self._fields()), "f0 double, f1 double, f2 double"])

    def _read(self, b: pa.RecordBatch, since: list[Trees]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Output, bins, target and the predictions of the three quantiles with the trees grown since the state was written."""
        code, y = b.column("o").to_numpy().astype(np.int64), b.column("y").to_numpy()
        bins = np.stack([b.column(c).to_numpy() for c in self._fields()], axis=1) if self.features else np.zeros((b.num_rows, 1), np.int16)
        f = np.stack([b.column(f"f{k}").to_numpy() for k in range(3)], axis=1)
        for trees in since:
            for k in range(3):
                group = 3 * code + k
                f[:, k] += self.rate * trees.value[group, trees.leaf(group, bins)]
        return code, bins, y, f

    def _advanced(self, state: DataFrame, since: list[Trees]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, _, _, f = self._read(b, since)
                kept = [b.column(c) for c in b.schema.names[:-3]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(f[:, k]) for k in range(3))], b.schema.names)

        return state.mapInArrow(run, self._schema())

    def _cuts(self, state: DataFrame, since: list[Trees], trees: Trees, level: int) -> list:
        """tree, node, feature and cut of the nodes of a level that are cut: one row a node."""
        first, many, width, d, groups = 2**level - 1, 2**level, self.bins, max(len(self.features), 1), 3 * len(self.outputs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((groups * many * d * width, 2), np.int64)
            for b in batches:
                code, bins, y, f = self._read(b, since)
                for k in range(3):
                    group = 3 * code + k
                    node = trees.leaf(group, bins)
                    here = node >= first  # others are leaves of a level above
                    at = (group[here] * many + node[here] - first)[:, None] * d + np.arange(d)
                    cell = (at * width + bins[here]).ravel()
                    up = np.repeat((y > f[:, k])[here], d)
                    total[:, 0] += np.bincount(cell, minlength=len(total))
                    total[:, 1] += np.bincount(cell[up], minlength=len(total))
            some = np.flatnonzero(total[:, 0])
            place, b = np.divmod(some, width)
            place, feature = np.divmod(place, d)
            tree, node = np.divmod(place, many)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tree.astype(np.int32), (node + first).astype(np.int32), feature.astype(np.int32), b.astype(np.int32), total[some, 0], total[some, 1])], ["tree", "node", "feature", "bin", "n", "up"])

        levels, least = self.levels, self.min_rows

        def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            tree, node = (x.as_py() for x in key)
            n, up = np.zeros((d, width), np.int64), np.zeros((d, width), np.int64)
            at = table.column("feature").to_numpy(), table.column("bin").to_numpy()
            n[at], up[at] = table.column("n").to_numpy(), table.column("up").to_numpy()
            feature, cut = best_cut(n, up, levels[tree % 3], least)
            rows = [] if feature is None else [(tree, node, feature, cut)]
            return pa.table([pa.array([r[k] for r in rows], pa.int32()) for k in range(4)], ["tree", "node", "feature", "cut"])

        counts = state.mapInArrow(count, "tree int, node int, feature int, bin int, n long, up long").groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("up").alias("up"))
        return counts.groupBy("tree", "node").applyInArrow(best, "tree int, node int, feature int, cut int").collect()

    def _leaves(self, state: DataFrame, since: list[Trees], trees: Trees) -> list:
        """tree, leaf and the quantiles of its residuals: one row a leaf."""

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code, bins, y, f = self._read(b, since)
                for k in range(3):
                    group = 3 * code + k
                    yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(trees.leaf(group, bins).astype(np.int32)), pa.array(y - f[:, k])], ["tree", "leaf", "r"])

        rows = state.mapInArrow(residuals, "tree int, leaf int, r double")
        return rows.groupBy("tree", "leaf").agg(F.percentile_approx("r", list(self.levels), ACCURACY).alias("q")).collect()

    # prediction

    def predict_quantiles(self, rows: DataFrame) -> DataFrame:
        """Rows of known outputs with the three quantiles: lower, middle and upper."""
        outputs, truth, features, base, edges, rate, trees = {o: i for i, o in enumerate(self.outputs)}, "y_true" in rows.columns, self.features, self.base, self.edges, self.rate, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                code = np.array([outputs.get(o, -1) for o in b.column("output").to_pylist()], np.int64)
                b, code = b.filter(pa.array(code >= 0)), code[code >= 0]
                x, bins = _numbers(b, features), np.zeros((len(code), max(len(features), 1)), np.int16)
                for o in np.unique(code):
                    bins[code == o, : len(features)] = _binned(x[code == o], edges[o])
                f = base[code].copy()
                for t in trees:
                    for k in range(3):
                        f[:, k] += rate * t.value[3 * code + k, t.leaf(3 * code + k, bins)]
                kept = ["row_id", "output", *(["y_true"] if truth else [])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(f[:, k]) for k in range(3))], [*kept, "lower", "middle", "upper"])

        kind = rows.schema["row_id"].dataType.simpleString()
        some = rows.select("row_id", "output", *([F.col("y_true").cast("double").alias("y_true")] if truth else []), *[F.col(c).cast("double").alias(c) for c in features])
        return some.mapInArrow(run, f"row_id {kind}, output string" + ", y_true double" * truth + ", lower double, middle double, upper double")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows of known outputs with y_pred, the middle quantile, and y_std."""
        made = self.predict_quantiles(rows)
        return made.withColumn("y_pred", F.col("middle")).withColumn("y_std", F.abs(F.col("upper") - F.col("lower")) / 2).drop("lower", "middle", "upper")


def _numbers(b: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """Columns as a matrix of doubles, null as NaN."""
    columns = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features]
    return np.stack(columns, axis=1) if columns else np.zeros((b.num_rows, 0))


def best_cut(n: np.ndarray, up: np.ndarray, level: float, least: int) -> tuple[int | None, int | None]:
    """Feature and bin of the cut (bins up to it go left) of greatest gain from counts of rows and of positive residuals; of equals the first.

    The gradient of a row is level where its residual is positive, else level - 1.
    """
    total, rise = n[0].sum(), up[0].sum()
    left, left_up = np.cumsum(n, axis=1)[:, :-1], np.cumsum(up, axis=1)[:, :-1]
    slope = lambda m, u: u - (1 - level) * m
    right, right_up = total - left, rise - left_up
    gain = slope(left, left_up) ** 2 / np.maximum(left, 1) + slope(right, right_up) ** 2 / np.maximum(right, 1) - slope(total, rise) ** 2 / max(total, 1)
    gain[(left < least) | (right < least)] = 0
    if not gain.size or gain.max() <= _LEAST_GAIN:
        return None, None
    feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return int(feature), int(cut)
