"""Estimators over long tables (row_id, output, y_true, features), and what is built of them: search, bagging, levels of fidelity.

An estimator is a factory's product with fit(train, features), which returns itself, and predict(rows), which gives rows
with y_pred and y_std (null where it has no uncertainty). All outputs are fitted at once, on all rows: least squares,
Bayesian ridge, means, Gaussian processes, support vectors and quantile boosting through aggregates, neighbours through
bounded blocks; trees are Spark ML's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.errors import IllegalArgumentException, PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels
from tessera.operators.boosting import QuantileBoosting
from tessera.operators.frames import hash_unit, kfold
from tessera.operators.metrics import compare_rmse
from tessera.operators.neighbours import nearest
from tessera.operators.written import dropped, written

LONG = ["row_id", "output", "y_true"]
#: What a fit that can't be made raises; a failed Spark job is none of these and ends the search.
FIT_ERRORS = (ArithmeticError, LookupError, RuntimeError, TypeError, ValueError, IllegalArgumentException, PythonException, np.linalg.LinAlgError)


def _rows(df: DataFrame, pred: Column, std: Column | None = None) -> DataFrame:
    truth = ["y_true"] if "y_true" in df.columns else []
    return df.select("row_id", "output", *truth, pred.cast("double").alias("y_pred"), (F.lit(None) if std is None else std).cast("double").alias("y_std"))


def gram(train: DataFrame, features: list[str], by: tuple[str, ...] = ("output",)) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, int]]:
    """For each group: X'X and X'y with an intercept first, y'y and the number of rows; one aggregate."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    d = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(cols[i] * F.col("y_true")).alias(f"b{i}") for i in range(d)]
    out = {}
    for r in train.groupBy(*by).agg(*sums, F.sum(F.col("y_true") * F.col("y_true")).alias("yy"), F.count("*").alias("n")).collect():  # one row a group
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
        out[tuple(r[c] for c in by)] = (a, np.array([r[f"b{i}"] for i in range(d)], float), float(r["yy"]), r["n"])
    return out


def _by_output(values: Mapping[str, float]) -> Column:
    """A number for each output, as a column."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col("output") == k, F.lit(float(v))).otherwise(out)
    return out


class Linear:
    """Least squares of each output by its normal equations; fit_intercept as usual. y_std: null."""

    closed_form = True

    def __init__(self, fit_intercept: bool = True):
        self.fit_intercept = fit_intercept

    def solve(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.fit_intercept:
            return np.linalg.lstsq(a, b, rcond=None)[0]
        return np.concatenate([[0.0], np.linalg.lstsq(a[1:, 1:], b[1:], rcond=None)[0]])

    def fit(self, train: DataFrame, features: list[str]) -> Linear:
        self.features = features
        self.weights = {k[0]: self.solve(a, b) for k, (a, b, _, _) in gram(train, features).items()}
        return self

    def _line(self) -> Column:
        total = _by_output({k: w[0] for k, w in self.weights.items()})
        for j, c in enumerate(self.features, 1):
            total = total + _by_output({k: w[j] for k, w in self.weights.items()}) * F.col(c).cast("double")
        return total

    def predict(self, rows: DataFrame) -> DataFrame:
        return _rows(rows, self._line())


class BayesianRidge(Linear):
    """Ridge whose two precisions maximise the evidence, from the same sums; y_std is that of the predictive distribution."""

    def __init__(self, rounds: int = 300, tolerance: float = 1e-6):
        super().__init__()
        self.rounds, self.tolerance = rounds, tolerance

    def fit(self, train: DataFrame, features: list[str]) -> BayesianRidge:
        self.features, self.weights, self.noise, self.spread, self.centre = features, {}, {}, {}, {}
        for (output,), (a, b, yy, n) in gram(train, features).items():
            mean, ym = a[0, 1:] / n, b[0] / n
            s, t, total = a[1:, 1:] - n * np.outer(mean, mean), b[1:] - n * mean * ym, yy - n * ym * ym
            values, vectors = np.linalg.eigh(s)
            values, turned = np.maximum(values, 0), vectors.T @ t
            noise, prior = 1 / max(total / n, 1e-12), 1.0
            for _ in range(self.rounds):
                w = noise * turned / (noise * values + prior)
                effective = float((noise * values / (noise * values + prior)).sum())
                rest = max(total - 2 * w @ turned + values @ (w * w), 1e-12)
                new = (effective / max(w @ w, 1e-12), max(n - effective, 1e-6) / rest)
                done = abs(new[0] - prior) <= self.tolerance * prior and abs(new[1] - noise) <= self.tolerance * noise
                prior, noise = new
                if done:
                    break
            w = vectors @ (noise * turned / (noise * values + prior))
            self.weights[output] = np.concatenate([[ym - w @ mean], w])
            self.noise[output], self.centre[output] = 1 / noise, mean
            self.spread[output] = vectors @ np.diag(1 / (noise * values + prior)) @ vectors.T
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        off = [F.col(c).cast("double") - _by_output({k: m[j] for k, m in self.centre.items()}) for j, c in enumerate(self.features)]
        var = _by_output(self.noise)
        for i in range(len(off)):
            for j in range(len(off)):
                var = var + _by_output({k: s[i, j] for k, s in self.spread.items()}) * off[i] * off[j]
        return _rows(rows, self._line(), F.sqrt(var))


class Mean:
    """The mean of each output; y_std is its population deviation."""

    def fit(self, train: DataFrame, features: list[str]) -> Mean:
        self.table = train.groupBy("output").agg(F.avg("y_true").alias("_m"), F.stddev_pop("y_true").alias("_s"))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return _rows(rows.join(F.broadcast(self.table), "output"), F.col("_m"), F.col("_s"))  # one row an output


class Neighbours:
    """Mean and population deviation of the k nearest training rows, over all of them (ties: the least row_id)."""

    def __init__(self, n_neighbors: int = 3):
        self.k = n_neighbors

    def fit(self, train: DataFrame, features: list[str]) -> Neighbours:
        self.train, self.features = train, features
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        parts = []
        for r in self.train.select("output").distinct().collect():  # the outputs
            mine = rows.where(F.col("output") == r["output"])
            near = nearest(self.train.where(F.col("output") == r["output"]), mine, "row_id", self.features, self.k, "y_true", apart=False)
            both = near.groupBy("row_id").agg(F.avg("payload").alias("_p"), F.stddev_pop("payload").alias("_s"))
            parts.append(_rows(mine.join(both.hint("merge"), "row_id"), F.col("_p"), F.col("_s")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class _SparkTrees:
    """A Spark ML regressor for each output. y_std: the deviation over the trees of a forest, else null."""

    spread = False

    def _make(self):
        raise NotImplementedError

    def fit(self, train: DataFrame, features: list[str]) -> _SparkTrees:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import array_to_vector

        self.assembler = VectorAssembler(inputCols=features, outputCol="_features")
        # the fit reads the rows three times: an array makes the assembler's vectors at a part of its cost
        x = {c: F.col(c).cast("double") for c in features}
        known = [F.when(F.isnan(v) | v.isNull(), F.raise_error(F.lit(f"null or NaN in {c}")).cast("double")).otherwise(v) for c, v in x.items()]
        ready = train.withColumn("_features", array_to_vector(F.array(*known)))
        self.fitted = {r["output"]: self._make().setFeaturesCol("_features").setLabelCol("y_true").setPredictionCol("_p").fit(ready.where(F.col("output") == r["output"])) for r in train.select("output").distinct().collect()}  # the outputs
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = None
        for output, model in self.fitted.items():
            mine = self.assembler.transform(rows.where(F.col("output") == output))
            if self.spread:
                for i, tree in enumerate(model.trees):
                    mine = tree.setPredictionCol(f"_p{i}").transform(mine)
                each = F.array(*[F.col(f"_p{i}") for i in range(len(model.trees))])
                n = len(model.trees)
                mean = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / n
                mine = mine.withColumn("_mean", mean)
                std = F.sqrt(F.aggregate(F.transform(each, lambda v: F.pow(v - F.col("_mean"), 2)), F.lit(0.0), lambda s, v: s + v) / n)
                part = _rows(mine, F.col("_mean"), std)
            else:
                part = _rows(model.transform(mine), F.col("_p"))
            out = part if out is None else out.unionByName(part)
        return out


class Forest(_SparkTrees):
    spread = True

    def __init__(self, n_estimators: int = 50, max_depth: int | None = 5, seed: int = 0):
        self.n, self.depth, self.seed = n_estimators, max_depth, seed

    def _make(self):
        from pyspark.ml.regression import RandomForestRegressor

        return RandomForestRegressor(numTrees=self.n, maxDepth=min(self.depth or 15, 30), featureSubsetStrategy="all", seed=self.seed)


class Boosting(_SparkTrees):
    def __init__(self, n_estimators: int = 50, max_depth: int = 3, seed: int = 0):
        self.n, self.depth, self.seed = n_estimators, max_depth, seed

    def _make(self):
        from pyspark.ml.regression import GBTRegressor

        return GBTRegressor(maxIter=self.n, maxDepth=self.depth, stepSize=0.1, seed=self.seed)


class Tree(_SparkTrees):
    def __init__(self, max_depth: int | None = None, max_bins: int = 32):
        self.depth, self.bins = max_depth, max_bins

    def _make(self):
        from pyspark.ml.regression import DecisionTreeRegressor

        return DecisionTreeRegressor(maxDepth=min(self.depth or 15, 30), maxBins=self.bins, seed=0)


def gaussian_process(alpha: float = 1e-10, matern: bool = False) -> kernels.GaussianProcess:
    return kernels.GaussianProcess(alpha, matern)


def support_vectors(C: float = 1.0, gamma: str = "scale") -> kernels.SupportVectors:  # noqa: N803  the setting's usual name
    return kernels.SupportVectors(C, gamma)


def quantile_boosting(alpha: float = 0.95, n_estimators: int = 50, max_depth: int = 3) -> QuantileBoosting:
    """Middle: the median; y_std: half the distance between the alpha and 1 - alpha quantiles, never negative."""
    return QuantileBoosting(alpha, n_estimators, max_depth)


class Bagging:
    """Members on Poisson draws of the rows; mean and population deviation of their predictions."""

    def __init__(self, make: Callable, n_estimators: int = 10, seed: int = 0):
        self.make, self.n, self.seed = make, n_estimators, seed

    def fit(self, train: DataFrame, features: list[str]) -> Bagging:
        from tessera.operators.frames import poisson_weight

        self.members = []
        for m in range(self.n):
            drawn = train.withColumn("_w", poisson_weight(F.col("row_id"), F.lit(self.seed * 1_000_003 + m))).where("_w > 0")
            self.members.append(self.make().fit(drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_w"))).drop("_w", "_copy"), features))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        every = None
        for m in self.members:
            p = m.predict(rows)
            every = p if every is None else every.unionByName(p)
        truth = [F.first("y_true").alias("y_true")] if "y_true" in rows.columns else []
        return every.groupBy("row_id", "output").agg(*truth, F.avg("y_pred").alias("y_pred"), F.stddev_pop("y_pred").alias("y_std"))


class PerOutput:
    """An estimator for each output; missing says what a missing deviation becomes (NaN, 0 or null)."""

    def __init__(self, make: Mapping[str, Callable], missing: float | None = float("nan")):
        self.make, self.missing = dict(make), missing

    def fit(self, train: DataFrame, features: list[str]) -> PerOutput:
        self.estimators_ = {o: make().fit(train.where(F.col("output") == o), features) for o, make in self.make.items()}
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if not hasattr(self, "estimators_"):
            raise AttributeError("fit first")
        out = None
        for o, m in self.estimators_.items():
            p = m.predict(rows.where(F.col("output") == o))
            out = p if out is None else out.unionByName(p)
        return out if self.missing is None else out.withColumn("y_std", F.coalesce("y_std", F.lit(float(self.missing))))


def mixed_bagging(make: Mapping[str, Callable], n_estimators: int = 10, seed: int = 0) -> PerOutput:
    """Bagging of another kind of estimator for each output."""
    return PerOutput({o: (lambda f=f: Bagging(f, n_estimators, seed)) for o, f in make.items()})


#: Names of kinds in settings.
KINDS: dict[str, Callable] = {"linear": Linear, "gp": gaussian_process, "bayesian_ridge": BayesianRidge, "rf": Forest, "forest": Forest, "boosting": Boosting, "svr": support_vectors, "knn": Neighbours, "tree": Tree, "mean": Mean, "quantile_boosting": quantile_boosting}


def from_settings(settings: Mapping[str, Mapping]) -> PerOutput:
    """One estimator an output from {output: {"type": kind, "params": {...}}}; an unknown kind is an error."""
    unknown = [s["type"] for s in settings.values() if s["type"] not in KINDS]
    if unknown:
        raise ValueError(f"unknown estimator {unknown[0]!r}")
    return PerOutput({o: (lambda s=s: KINDS[s["type"]](**s.get("params", {}))) for o, s in settings.items()})


class MultiFidelity:
    """An independent estimator for each level of fidelity; the first level is the default."""

    def __init__(self, make: Callable, levels: Sequence[str]):
        self.make, self.levels = make, list(levels)

    def _known(self, level: str) -> str:
        if level not in self.levels:
            raise ValueError(f"unknown fidelity level {level!r}")
        return level

    def fit(self, data: DataFrame | Mapping[str, DataFrame], features: list[str]) -> MultiFidelity:
        if not isinstance(data, Mapping):
            if len(self.levels) != 1:
                raise ValueError("one table is given, but there are several levels")
            data = {self.levels[0]: data}
        self.fitted = {self._known(k): self.make().fit(v, features) for k, v in data.items()}
        return self

    def predict(self, rows: DataFrame, level: str | None = None) -> DataFrame:
        level = self.levels[0] if level is None else self._known(level)
        if level not in self.fitted:
            raise ValueError(f"level {level!r} has not been fitted")
        return self.fitted[level].predict(rows)


def settings_grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the values of each setting, the last setting changing fastest; no settings: one empty combination."""
    return [dict(zip(space, values)) for values in product(*space.values())]


SCORES = {"neg_mean_squared_error": lambda: -F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)), "neg_mean_absolute_error": lambda: -F.avg(F.abs(F.col("y_true") - F.col("y_pred")))}


def cross_validate(train: DataFrame, features: list[str], make: Callable, cv: int = 3, scoring: str = "neg_mean_squared_error") -> DataFrame:
    """output and score: the mean over contiguous folds in order of row_id. train has a column fold (see kfold)."""
    scored = None
    for k in range(cv):
        model = make().fit(train.where(F.col("fold") != k), features)
        part = model.predict(train.where(F.col("fold") == k)).groupBy("output").agg(SCORES[scoring]().alias("s"))
        scored = part if scored is None else scored.unionByName(part)
    return scored.groupBy("output").agg(F.avg("s").alias("score"))


def with_noise(train: DataFrame, std: float = 10.0, seed: int = 0) -> DataFrame:
    """train with normal noise of a deviation on y_true, drawn from the md5 of row_id, output and seed: the same on every run."""
    u, v = (hash_unit(F.concat_ws("|", F.col("row_id").cast("string"), "output", F.lit(str(seed)), F.lit(str(k)))) for k in (1, 2))
    return train.withColumn("y_true", F.col("y_true") + std * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * np.pi * v))


def compare_with_noisy(make: Callable, train: DataFrame, test: DataFrame, features: list[str], std: float = 10.0, seed: int = 0) -> DataFrame:
    """output, model and noisy: the root mean squared errors on test of an estimator and of the same one fitted to noisy targets."""
    both = []
    for name, rows in (("model", train), ("noisy", with_noise(train, std, seed))):
        both.append(compare_rmse(make().fit(rows, features).predict(test), {name: "y_pred"}))
    return both[0].join(both[1], "output")  # one row an output


class AutoDetect:
    """Chooses an estimator for each output by a grid search with cross-validation and fits the winners on all rows.

    A setting whose fit fails is left out, with the reason in failures_; of equal scores the earlier one wins.
    """

    def __init__(self, estimators: Sequence[Callable], param_spaces: Sequence[Mapping[str, Sequence]], cv: int = 3, scoring: str = "neg_mean_squared_error"):
        if len(estimators) != len(param_spaces):
            raise ValueError("each estimator needs its own space of settings")
        if scoring not in SCORES:
            raise ValueError(f"unknown scoring {scoring!r}; known: {', '.join(SCORES)}")
        self.candidates = [(f, s) for f, space in zip(estimators, param_spaces) for s in settings_grid(space)]
        self.cv, self.scoring = cv, scoring

    @classmethod
    def with_defaults(cls, cv: int = 3, scoring: str = "neg_mean_squared_error") -> AutoDetect:
        """Seven kinds, 22 settings."""
        return cls(
            [Linear, gaussian_process, Forest, Boosting, support_vectors, Neighbours, Tree],
            [{}, {"alpha": [1e-10, 1e-2]}, {"n_estimators": [50, 100], "max_depth": [3, 5, None]}, {"n_estimators": [50, 100], "max_depth": [3, 5]}, {"C": [1, 10], "gamma": ["scale", "auto"]}, {"n_neighbors": [3, 5, 7]}, {"max_depth": [1, None]}],
            cv, scoring,
        )

    def _row_ids(self, train: DataFrame) -> DataFrame:
        ids = kfold(train.select("row_id").distinct(), "row_id", self.cv)
        return train.join(ids.select("row_id", "fold").hint("merge"), "row_id")  # as long as train: never through the driver

    def fit(self, train: DataFrame, features: list[str]) -> AutoDetect:
        folded = written(self._row_ids(train), "folds")  # every fit of every fold reads them
        rows, self.failures_ = [], {}
        for place, (make, settings) in enumerate(self.candidates):
            try:
                scores = cross_validate(folded, features, lambda make=make, settings=settings: make(**settings), self.cv, self.scoring).collect()  # one row an output
            except FIT_ERRORS as e:
                self.failures_[place] = f"{type(e).__name__}: {e}"[:200]
                continue
            rows += [(r["output"], place, getattr(make, "__name__", str(make)), str(settings), r["score"]) for r in scores if r["score"] is not None and np.isfinite(r["score"])]
        dropped(folded)
        self.scores_ = train.sparkSession.createDataFrame(rows, "output string, place int, estimator string, settings string, score double")
        best: dict[str, tuple[float, int]] = {}
        for output, place, _, _, score in rows:
            if output not in best or score > best[output][0]:
                best[output] = (score, place)
        missing = [r["output"] for r in train.select("output").distinct().collect() if r["output"] not in best]  # the outputs
        if missing or not best:
            raise RuntimeError(f"no valid estimator for {missing or 'any output'}")
        self.chosen_ = {o: place for o, (_, place) in best.items()}
        winners = {o: (lambda p=place: self.candidates[p][0](**self.candidates[p][1])) for o, place in self.chosen_.items()}
        self.model_ = PerOutput(winners, missing=0.0).fit(train, features)
        self.estimators_ = self.model_.estimators_
        return self

    def predict(self, rows: DataFrame, return_std: bool = False) -> DataFrame:
        """row_id, output, (y_true,) y_pred and, with return_std, y_std; an estimator without uncertainty has 0."""
        if not hasattr(self, "model_"):
            raise AttributeError("fit before predict")
        out = self.model_.predict(rows)
        return out if return_std else out.drop("y_std")


def random_search(train: DataFrame, features: list[str], make: Callable, space: Mapping[str, Sequence], trials: int = 12, cv: int = 3, seed: int = 0) -> DataFrame:
    """output, settings, score of trials settings drawn without replacement from a grid; best first."""
    grid, search, out = settings_grid(space), AutoDetect([], [], cv), None
    folded = search._row_ids(train)
    for i in np.random.default_rng(seed).permutation(len(grid))[:trials]:
        part = cross_validate(folded, features, lambda s=grid[i]: make(**s), cv, search.scoring).withColumn("settings", F.lit(str(grid[i])))
        out = part if out is None else out.unionByName(part)
    return out.select("output", "settings", "score").orderBy("output", F.desc("score"), "settings")


class ParzenSearch:
    """Tree-structured Parzen estimator over the values of each setting.

    Trials so far are parted into the best ``share`` of them and the rest; each setting has two densities over its values,
    of the good and of the other trials, smoothed over neighbouring values and by a prior. Of ``draws`` combinations drawn
    from the good densities the one of greatest ratio (expected improvement) that has not been tried is next.
    """

    def __init__(self, space: Mapping[str, Sequence], startup: int = 4, share: float = 0.25, draws: int = 24, seed: int = 0):
        self.space, self.startup, self.share, self.draws = {k: list(v) for k, v in space.items()}, startup, share, draws
        self.dice, self.tried = np.random.default_rng(seed), {}
        self.size = int(np.prod([len(v) for v in self.space.values()], dtype=object))

    def _density(self, trials: list[tuple[int, ...]], j: int, n: int) -> np.ndarray:
        p = np.ones(n) / n
        for t in trials:
            near = np.exp(-0.5 * (np.arange(n) - t[j]) ** 2 / max(0.6, 0.12 * n) ** 2)
            p += near / near.sum()
        return p / p.sum()

    def ask(self) -> dict:
        """The settings to try next; each combination once."""
        sizes = [len(v) for v in self.space.values()]
        scored = [(s, t) for t, s in self.tried.items() if s is not None]
        if len(self.tried) >= self.size:
            raise StopIteration
        fresh = lambda: tuple(int(self.dice.integers(n)) for n in sizes)
        if len(scored) < self.startup:
            options = [fresh() for _ in range(self.draws)]
            value = [0.0] * len(options)
        else:
            scored.sort(key=lambda x: -x[0])
            cut = max(1, int(np.ceil(self.share * len(scored))))
            good, bad = [t for _, t in scored[:cut]], [t for _, t in scored[cut:]] + [t for t, s in self.tried.items() if s is None]  # those under way count as no better
            l, g = ([self._density(part, j, n) for j, n in enumerate(sizes)] for part in (good, bad))
            options = [tuple(int(self.dice.choice(n, p=l[j])) for j, n in enumerate(sizes)) for _ in range(self.draws)]
            value = [sum(np.log(l[j][t[j]] / g[j][t[j]]) for j in range(len(sizes))) for t in options]
        left = [(v, -k) for k, v in enumerate(value) if options[k] not in self.tried]
        pick = options[-max(left)[1]] if left else next(t for t in product(*map(range, sizes)) if t not in self.tried)
        self.tried[pick] = None
        return {k: v[i] for (k, v), i in zip(self.space.items(), pick)}

    def tell(self, settings: Mapping, score: float) -> None:
        """The score (greater is better; not finite: a failed trial) of settings that ask() gave."""
        at = tuple(next(i for i, x in enumerate(v) if x is settings[k] or x == settings[k]) for k, v in self.space.items())
        self.tried[at] = float(score) if np.isfinite(score) else -np.inf


def model_search(train: DataFrame, features: list[str], make: Callable, space: Mapping[str, Sequence], trials: int = 12, cv: int = 3, seed: int = 0, parallel: int = 2, startup: int = 4) -> DataFrame:
    """output, settings, score and trial of model-based search, best first; the mean of the outputs' scores steers it.

    ``parallel`` trials at a time run as Spark jobs of their own threads, on folds that are written once. The order of
    trials, and so the result, depends on seed, parallel and startup alone.
    """
    from concurrent.futures import ThreadPoolExecutor

    steer, search, rows = AutoDetect([], [], cv), ParzenSearch(space, startup, seed=seed), []
    folded = written(steer._row_ids(train), "folds")

    def score(settings: dict) -> dict[str, float]:
        return {r["output"]: r["score"] for r in cross_validate(folded, features, lambda: make(**settings), cv, steer.scoring).collect()}  # one row an output

    with ThreadPoolExecutor(parallel) as pool:
        while len(rows) < trials and len(search.tried) < search.size:
            asked = [search.ask() for _ in range(min(parallel, trials - len(rows), search.size - len(search.tried)))]
            for settings, scores in zip(asked, pool.map(score, asked)):
                values = [v for v in scores.values() if v is not None]
                search.tell(settings, float(np.mean(values)) if values else -np.inf)
                rows.append((settings, scores))
    dropped(folded)
    out = [(o, str(s), v, t) for t, (s, scores) in enumerate(rows) for o, v in scores.items() if v is not None]
    return train.sparkSession.createDataFrame(out, "output string, settings string, score double, trial int").orderBy("output", F.desc("score"), "settings")


# uncertainty ------------------------------------------------------------------------------------------------------

#: How an estimator may give its uncertainty, in order of preference.
METHODS = ("return_std", "return_cov", "predict_std", "predict_var")


def predict_with_uncertainty(estimator, rows: DataFrame, method: str | None = None) -> DataFrame:
    """Rows with y_pred and y_std. An estimator names what it supports in ``supports`` (default: what methods it has).

    return_std: predict gives y_std; return_cov: predict_cov gives place and cov (the row of a covariance matrix, whose
    diagonal counts); predict_std and predict_var give y_std and y_var. The method asked for is tried first, then METHODS.
    """
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    has = {"return_std": "predict", "return_cov": "predict_cov", "predict_std": "predict_std", "predict_var": "predict_var"}
    supports = getattr(estimator, "supports", None) or [m for m, f in has.items() if hasattr(estimator, f)]
    for m in dict.fromkeys([*([method] if method else []), *METHODS]):
        if m not in supports:
            continue
        if m == "return_std":
            out = estimator.predict(rows, return_std=True) if isinstance(estimator, AutoDetect) else estimator.predict(rows)
            if "y_std" not in out.columns:
                continue
        elif m == "return_cov":
            cov = estimator.predict_cov(rows)
            out = cov.withColumn("y_std", F.sqrt(F.get("cov", F.col("place")))).drop("cov", "place")
        elif m == "predict_std":
            out = estimator.predict_std(rows)
        else:
            out = estimator.predict_var(rows).withColumn("y_std", F.sqrt("y_var")).drop("y_var")
        return out
    raise RuntimeError("no way to get an uncertainty from this estimator; give y_std yourself")


def same_rows(a: DataFrame, b: DataFrame) -> None:
    """An error unless two long tables have the same (row_id, output), each once."""
    keys = ["row_id", "output"]
    both = a.select(*keys, F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select(*keys, F.lit(0).alias("na"), F.lit(1).alias("nb")))
    bad = both.groupBy(*keys).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).where("na <> 1 or nb <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"shape mismatch: row {bad[0]['row_id']} of {bad[0]['output']} stands {bad[0]['na']} and {bad[0]['nb']} times")


def flexible_metrics(estimator, test: DataFrame, method: str | None = None, std: DataFrame | None = None, std_is_var: bool = False) -> DataFrame:
    """rmse, mae, nll and miscal_area of each output, and with output null over all rows.

    std (row_id, output, y_std) replaces the estimator's own uncertainty; with std_is_var it holds variances. Deviations
    count with their absolute value, at least STD_FLOOR.
    """
    from tessera.operators.metrics import flat_metrics

    if std is None:
        predictions = predict_with_uncertainty(estimator, test, method)
    else:
        value = F.sqrt("y_std") if std_is_var else F.col("y_std")
        predictions = estimator.predict(test).select("row_id", "output", "y_pred")
        same_rows(predictions, std)
        predictions = predictions.join(std.select("row_id", "output", value.alias("y_std")), ["row_id", "output"])
    same_rows(test, predictions)
    truth = test.select("row_id", "output", "y_true")
    return flat_metrics(truth.join(predictions.select("row_id", "output", "y_pred", "y_std"), ["row_id", "output"]))
