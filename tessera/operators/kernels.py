"""Kernel models on all rows: Gaussian processes by inducing points, and support vectors by random features.

Gaussian process. Some distinct rows of each output (INDUCING, by a hash) are the inducing points Z. All rows enter through
K_zn K_nz, K_zn y, y'y and their number: one aggregate of m x m numbers, added up task by task. Mean and variance follow
from m x m factors; where Z has all distinct rows they are those of the exact process. The kernel's scale, where none is
given, is the likeliest of a grid, judged by the same sums over all rows with fewer inducing points.

Support vectors. The RBF kernel is approximated by random Fourier features (cosines and sines of m random directions, by
seed), which leaves a linear problem with one dual variable a row. An augmented Lagrangian smooths the loss around the
present dual variables; its optimum is found by Newton steps, each of which is one aggregate of m x m numbers over all
rows; then every row gets its new dual variable and the penalty grows. Rounds end when the duality gap, summed over all
rows, is below ``gap`` of the objective. Equal rows have equal dual variables and are kept once with their number; rows lie
in order of their features over as many files as there are partitions of a shuffle, so all cores take part whatever files
the table came in, and the random features of neighbouring rows that agree are made once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.written import dropped, written

#: Inducing points of an output, and how many judge the scale.
INDUCING, SCOUTS = 256, 48
#: Kernel values that one numpy pass holds.
_PASS = 2_000_000
_JITTERS = (1e-10, 1e-8, 1e-6, 1e-4)
#: Variance of noise that keeps sums solvable where none is given.
_LEAST_NOISE = 1e-9


def _matrix(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1) if names else np.zeros((b.num_rows, 0))


def _ready(train: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """output, y and x0 .. of the rows without a null or NaN."""
    names = [f"x{j}" for j in range(len(features))]
    rows = train.select("output", F.col("y_true").cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
    whole = F.lit(True)
    for c in ("y", *names):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return rows.where(whole), names


def _added(parts: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """Arrays v of equal keys (of kinds), added up element by element."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        total = v.flatten().to_numpy().reshape(len(v), -1).sum(0)
        return pa.table([*(pa.array([k.as_py()], table.schema.field(n).type) for k, n in zip(key, keys)), pa.array([total.tolist()], pa.list_(pa.float64()))], [*keys, "v"])

    return parts.groupBy(*keys).applyInArrow(add, f"{kinds}, v array<double>")


class GaussianProcess:
    """Regression of each output on centred targets with an RBF (or Matern 3/2) kernel; y_std is that of the function, without the noise."""

    def __init__(self, alpha: float = 1e-10, matern: bool = False, scale: float | None = None, inducing: int = INDUCING, seed: int = 0):
        self.alpha, self.matern, self.scale, self.inducing, self.seed = alpha, matern, scale, inducing, seed

    def kernel(self, a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)) / scale
        return (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d) if self.matern else np.exp(-0.5 * d * d)

    def _points(self, rows: DataFrame, names: list[str], most: int) -> dict[str, np.ndarray]:
        distinct = rows.select("output", *names).distinct()
        draw = F.row_number().over(Window.partitionBy("output").orderBy(F.xxhash64(*names, F.lit(self.seed)), *names))
        out: dict[str, list] = {}
        for r in distinct.withColumn("_p", draw).where(F.col("_p") <= most).collect():  # most an output
            out.setdefault(r["output"], []).append([r[c] for c in names])
        return {o: np.array(v, float).reshape(len(v), len(names)) for o, v in out.items()}

    def _sums(self, rows: DataFrame, names: list[str], points: dict[str, np.ndarray], scales: dict[str, list[float]]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        """For each output and scale: K_zn K_nz and K_zn y, y centred; one aggregate."""
        mean = self.mean

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[str, int], np.ndarray] = {}
            for b in batches:
                output = np.array(b.column("output").to_pylist(), object)
                x, y = _matrix(b, names), b.column("y").to_numpy()
                for o in set(output):
                    mine = np.flatnonzero(output == o)
                    z = points[o]
                    for at in range(0, len(mine), max(1, _PASS // max(len(z), 1))):
                        some = mine[at : at + max(1, _PASS // max(len(z), 1))]
                        for s, scale in enumerate(scales[o]):
                            k = self.kernel(x[some], z, scale)
                            sums = np.column_stack([k.T @ k, k.T @ (y[some] - mean[o])])
                            total[o, s] = total.get((o, s), 0) + sums
            for (o, s), v in total.items():
                n = len(v)
                yield pa.RecordBatch.from_arrays([pa.array([o] * n, pa.string()), pa.array([s] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["output", "s", "i", "v"])

        got: dict[tuple[str, int], dict[int, list]] = {}
        for r in _added(rows.mapInArrow(partial, "output string, s int, i int, v array<double>"), ["output", "s", "i"], "output string, s int, i int").collect():  # one row an inducing point
            got.setdefault((r["output"], r["s"]), {})[r["i"]] = r["v"]
        both = {k: np.array([v[i] for i in range(len(v))]) for k, v in got.items()}
        return {k: (v[:, :-1], v[:, -1]) for k, v in both.items()}

    def _solve(self, z: np.ndarray, scale: float, a: np.ndarray, b: np.ndarray, yy: float, n: int) -> tuple:
        """Weights of k(x, Z), the factors of the variance, the likeliest variance of the function and the log likelihood."""
        noise, m, k = self.alpha + _LEAST_NOISE, len(z), self.kernel(z, z, scale)
        for jitter in _JITTERS:  # inducing points that lie close together leave the kernel nearly singular
            try:
                low = np.linalg.cholesky(k + jitter * np.eye(m))
                inner = np.linalg.solve(low, np.linalg.solve(low, a).T)
                root = np.linalg.cholesky(np.eye(m) + (inner + inner.T) / (2 * noise))
                break
            except np.linalg.LinAlgError:
                if jitter == _JITTERS[-1]:
                    raise
        c = np.linalg.solve(root, np.linalg.solve(low, b)) / noise
        rest = max(yy / noise - float(c @ c), 1e-30)
        variance = 1.0 if self.scale is not None else rest / n
        likely = -0.5 * n * np.log(rest / n) - np.log(np.diag(root)).sum() - 0.5 * n * np.log(noise)
        weights = np.linalg.solve(low.T, np.linalg.solve(root.T, c))
        return weights, low, root, variance, likely

    def fit(self, train: DataFrame, features: list[str]) -> GaussianProcess:
        self.features = features
        rows, names = _ready(train, features)
        rows = written(rows, "process-rows")
        facts = rows.groupBy("output").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"), *[F.var_pop(c).alias(f"v{j}") for j, c in enumerate(names)]).collect()  # one row an output
        self.mean, n = {r["output"]: r["mean"] for r in facts}, {r["output"]: r["n"] for r in facts}
        yy = {r["output"]: r["n"] * r["var"] for r in facts}
        if self.scale is None:
            wide = {r["output"]: max(float(np.sqrt(np.mean([r[f"v{j}"] for j in range(len(names))]))), 1e-9) * np.sqrt(len(names)) if names else 1.0 for r in facts}
            grids = {o: (np.logspace(-1.5, 1.5, 13) * w).tolist() for o, w in wide.items()}
            scouts = self._points(rows, names, min(SCOUTS, self.inducing))
            best: dict[str, tuple[float, float]] = {}
            for (o, s), (a, b) in self._sums(rows, names, scouts, grids).items():
                try:
                    likely = self._solve(scouts[o], grids[o][s], a, b, yy[o], n[o])[-1]
                except np.linalg.LinAlgError:
                    continue
                if o not in best or likely > best[o][0]:
                    best[o] = (likely, grids[o][s])
            self.scales = {o: best[o][1] if o in best else grids[o][6] for o in grids}
        else:
            self.scales = {o: self.scale for o in n}
        self.points = self._points(rows, names, self.inducing)
        self.solved = {}
        for (o, _), (a, b) in self._sums(rows, names, self.points, {o: [s] for o, s in self.scales.items()}).items():
            self.solved[o] = self._solve(self.points[o], self.scales[o], a, b, yy[o], n[o])[:-1]
        dropped(rows)
        return self

    def _of(self, output: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights, low, root, variance = self.solved[output]
        k = self.kernel(x, self.points[output], self.scales[output])
        c = np.linalg.solve(low, k.T)
        left = np.linalg.solve(root, c)
        var = np.maximum(variance * (1 - (c * c).sum(0) + (left * left).sum(0)), 0)
        return self.mean[output] + k @ weights, np.sqrt(var)

    def predict(self, rows: DataFrame) -> DataFrame:
        return _by_row(rows, self.features, self._of, set(self.solved), max(1, _PASS // self.inducing))


def _by_row(rows: DataFrame, features: list[str], predict, known: set[str], step: int) -> DataFrame:
    """Rows of known outputs with y_pred and y_std (null where there is none, or a feature is missing)."""
    truth = "y_true" in rows.columns
    kept = ["row_id", "output", *(["y_true"] if truth else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            output = np.array(b.column("output").to_pylist(), object)
            x = _matrix(b, [f"x{j}" for j in range(len(features))])
            p, s = np.full(len(x), np.nan), np.full(len(x), np.nan)
            here = np.array([o in known for o in output], bool)
            for o in set(output) & known:
                mine = np.flatnonzero((output == o) & ~np.isnan(x).any(1))
                for at in range(0, len(mine), step):
                    p[mine[at : at + step]], std = predict(o, x[mine[at : at + step]])
                    if std is not None:
                        s[mine[at : at + step]] = std
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p, mask=np.isnan(p)), pa.array(s, mask=np.isnan(s))], [*kept, "y_pred", "y_std"]).filter(pa.array(here))

    kind = rows.schema["row_id"].dataType.simpleString()
    some = rows.select("row_id", "output", *([F.col("y_true").cast("double").alias("y_true")] if truth else []), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    return some.mapInArrow(run, f"row_id {kind}, output string" + ", y_true double" * truth + ", y_pred double, y_std double")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and the run of each row."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _by_features(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values, added up over each run."""
    return np.bincount(at, values)


class SupportVectors:
    """Epsilon-insensitive regression of each output with an RBF kernel by ``directions`` random Fourier features and an intercept of its own."""

    def __init__(self, C: float = 1.0, gamma: str | float = "scale", epsilon: float = 0.1, directions: int = 128, gap: float = 0.01, rounds: int = 15, seed: int = 0):  # noqa: N803
        self.c, self.gamma, self.epsilon, self.directions, self.gap, self.rounds, self.seed = C, gamma, epsilon, directions, gap, rounds, seed

    def _phi(self, output: str, x: np.ndarray) -> np.ndarray:
        """Random features, whose products approximate the kernel; the last is the intercept's."""
        turned = x @ self.frequencies[output]
        return np.column_stack([np.cos(turned) / np.sqrt(self.directions), np.sin(turned) / np.sqrt(self.directions), np.ones(len(x))])

    def fit(self, train: DataFrame, features: list[str]) -> SupportVectors:
        self.features = features
        rows, names = _ready(train, features)
        facts = rows.groupBy("output").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), *[F.avg(c).alias(f"m{j}") for j, c in enumerate(names)], *[F.avg(F.col(c) * F.col(c)).alias(f"q{j}") for j, c in enumerate(names)]).collect()  # one row an output
        self.centre, self.frequencies = {r["output"]: r["mean"] for r in facts}, {}
        for r in facts:
            mean = np.mean([r[f"m{j}"] for j in range(len(names))]) if names else 0.0
            var = np.mean([r[f"q{j}"] for j in range(len(names))]) - mean**2 if names else 1.0
            g = float(self.gamma) if not isinstance(self.gamma, str) else 1 / max(len(names), 1) / (var if self.gamma == "scale" and var > 0 else 1.0)
            self.frequencies[r["output"]] = np.random.default_rng(self.seed).normal(size=(len(names), self.directions)) * np.sqrt(2 * g)
        outputs, width = list(self.frequencies), 2 * self.directions + 1
        self.weights = {o: np.zeros(width) for o in outputs}
        self.gaps, penalty = {o: np.inf for o in outputs}, {o: self.c for o in outputs}
        alike = rows.groupBy("output", *names, "y").agg(F.count("*").alias("n")).withColumn("beta", F.lit(0.0))
        files = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
        order = ["output", *names, "y"]
        state, self.passes_ = written(alike.repartitionByRange(files, *order).sortWithinPartitions(*order), "support-rows"), 0
        for _ in range(self.rounds):
            open_ = {o for o, g in self.gaps.items() if g > self.gap}
            if not open_:
                break
            w = self._smooth_optimum(state, names, {o: self.weights[o] for o in open_}, penalty)
            newer = written(self._with_duals(state, names, w, penalty), "support-rows")
            dropped(state)
            state = newer
            # of the weights found and those that the dual variables make the better ones count
            made = {r["output"]: np.array(r["v"]) for r in self._summed(newer, names, lambda o, phi, at, r, beta, n: (_by_features(n * beta, at) @ phi)[None], open_)}
            sums = {r["output"]: np.array(r["v"]) for r in self._summed(newer, names, lambda o, phi, at, r, beta, n: np.array([[n @ (beta * r - self.epsilon * np.abs(beta)), *(n @ np.maximum(np.abs(r - (phi @ v[o])[at]) - self.epsilon, 0) for v in (w, made))]]), open_)}
            for o in open_:
                dual = sums[o][0] - 0.5 * made[o] @ made[o]
                primal, self.weights[o] = min(((0.5 * v @ v + self.c * loss, v) for v, loss in ((w[o], sums[o][1]), (made[o], sums[o][2]))), key=lambda t: t[0])
                self.gaps[o] = (primal - dual) / max(abs(primal), 1e-12)
                penalty[o] *= 5
        dropped(state)
        return self

    def _summed(self, state: DataFrame, names: list[str], part, outputs: set[str]) -> list:
        """output, i and v: the rows of part(output, features, place of each row among them, targets, dual variables, numbers of equal rows), a matrix, added up over all blocks of rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for b in batches:
                output, x, y, beta, n = np.array(b.column("output").to_pylist(), object), _matrix(b, names), b.column("y").to_numpy(), b.column("beta").to_numpy(), b.column("n").to_numpy()
                for o in set(output) & outputs:
                    mine = np.flatnonzero(output == o)
                    for start in range(0, len(mine), 4096):
                        some = mine[start : start + 4096]
                        first, at = _runs(x[some])
                        total[o] = total.get(o, 0) + part(o, self._phi(o, x[some[first]]), at, y[some] - self.centre[o], beta[some], n[some])
            for o, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([o] * len(v), pa.string()), pa.array(range(len(v)), pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["output", "i", "v"])

        self.passes_ += 1
        return _added(state.mapInArrow(run, "output string, i int, v array<double>"), ["output", "i"], "output string, i int").collect()  # a few rows, or one a feature, of each output

    def _duals(self, fitted: np.ndarray, r: np.ndarray, beta: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """The dual variables that belong to the fitted values of some weights, and whether each is free to move."""
        u = beta + penalty * (r - fitted)
        shrunk = np.sign(u) * np.maximum(np.abs(u) - penalty * self.epsilon, 0)
        return np.clip(shrunk, -self.c, self.c), (shrunk != 0) & (np.abs(shrunk) < self.c)

    def _smooth_optimum(self, state: DataFrame, names: list[str], start: dict[str, np.ndarray], penalty: dict[str, float], steps: int = 25) -> dict[str, np.ndarray]:
        """Weights at which the loss, smoothed around the present dual variables, is least: Newton steps, halved where they go too far; each trial is one pass."""
        w, before, done = {o: v.copy() for o, v in start.items()}, {}, set()
        for _ in range(steps):
            open_ = set(w) - done
            if not open_:
                break

            def part(o, phi, at, r, beta, n):
                fitted = (phi @ w[o])[at]
                new, free = self._duals(fitted, r, beta, penalty[o])
                value = n @ (new * (r - fitted) - self.epsilon * np.abs(new) - (new - beta) ** 2 / (2 * penalty[o]))
                first = np.zeros(phi.shape[1])
                first[0] = value
                moving = _by_features(n * free, at)
                turned = phi[moving > 0] * np.sqrt(moving[moving > 0])[:, None]
                return np.vstack([first, _by_features(n * new, at) @ phi, turned.T @ turned])

            got: dict[str, dict[int, list]] = {}
            for r in self._summed(state, names, part, open_):
                got.setdefault(r["output"], {})[r["i"]] = r["v"]
            for o in open_:
                rows = np.array([got[o][i] for i in range(len(got[o]))])
                value, slope = 0.5 * w[o] @ w[o] + rows[0, 0], w[o] - rows[1]
                if o in before and value > before[o][1] + 1e-4 * before[o][3] * before[o][4] + 1e-12 * abs(value) and before[o][3] > 1e-4:
                    old, least, step, t, fall = before[o]
                    before[o] = (old, least, step, t / 2, fall)
                    w[o] = old + t / 2 * step
                    continue
                if np.linalg.norm(slope) <= 1e-6 * max(1.0, np.linalg.norm(w[o])):
                    done.add(o)
                    continue
                step = -np.linalg.solve(np.eye(len(slope)) + penalty[o] * rows[2:], slope)
                before[o] = (w[o], value, step, 1.0, float(slope @ step))
                w[o] = w[o] + step
        return w

    def _with_duals(self, state: DataFrame, names: list[str], w: dict[str, np.ndarray], penalty: dict[str, float]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                output, x, y, beta = np.array(b.column("output").to_pylist(), object), _matrix(b, names), b.column("y").to_numpy(), b.column("beta").to_numpy().copy()
                for o in set(output) & set(w):
                    mine = np.flatnonzero(output == o)
                    for start in range(0, len(mine), 4096):
                        some = mine[start : start + 4096]
                        first, at = _runs(x[some])
                        beta[some], _ = self._duals((self._phi(o, x[some[first]]) @ w[o])[at], y[some] - self.centre[o], beta[some], penalty[o])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["output", "y", *names, "n"]), pa.array(beta)], ["output", "y", *names, "n", "beta"])

        return state.select("output", "y", *names, "n", "beta").mapInArrow(run, ", ".join(["output string, y double", *(f"{c} double" for c in names), "n long, beta double"]))

    def _of(self, output: str, x: np.ndarray) -> tuple[np.ndarray, None]:
        return self.centre[output] + self._phi(output, x) @ self.weights[output], None

    def predict(self, rows: DataFrame) -> DataFrame:
        return _by_row(rows, self.features, self._of, set(self.weights), 4096)
