"""Principal components: fitted by one aggregate, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Components:
    """Centred principal components; each has a positive greatest loading, so signs don't depend on the solver."""

    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray  # one row a component

    @property
    def ratios(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else np.zeros(len(self.eigenvalues))

    def choose(self, method: str | None = None, n: int | None = None, threshold: float | None = None) -> int:
        """How many components: 'Manual' (n), 'Explained variance threshold' (the first that reach it), else eigenvalues above 1, at least one."""
        if method == "Manual" and n is not None:
            if not 1 <= n <= len(self.columns):
                raise ValueError(f"n_components must be 1 to {len(self.columns)}")
            return int(n)
        if method == "Explained variance threshold" and threshold is not None:
            return min(int(np.searchsorted(np.cumsum(self.ratios), threshold) + 1), len(self.columns))
        return max(1, int((self.eigenvalues > 1).sum()))

    def transform(self, df: DataFrame, n: int, keep: list[str] | None = None) -> DataFrame:
        """Columns keep (default: all but the features) and PC1 to PCn."""
        kept = [c for c in df.columns if c not in self.columns] if keep is None else keep
        made = []
        for k in range(n):
            terms = [(F.col(c).cast("double") - float(m)) * float(w / s) for c, m, s, w in zip(self.columns, self.means, self.scales, self.vectors[k])]
            made.append(sum(terms[1:], terms[0]).alias(f"PC{k + 1}"))
        return df.select(*kept, *made)

    def scree(self, spark: SparkSession, selected: int | None = None) -> DataFrame:
        """k, eigenvalue, ratio, cumulative and whether the component is selected."""
        cumulative = np.cumsum(self.ratios)
        rows = [(k + 1, float(self.eigenvalues[k]), float(self.ratios[k]), float(cumulative[k]), selected is None or k < selected) for k in range(len(self.columns))]
        return spark.createDataFrame(rows, "k long, eigenvalue double, ratio double, cumulative double, selected boolean")


def fit_components(df: DataFrame, columns: list[str], scale: bool = False) -> Components:
    """Sample covariances of all pairs in one aggregate (of population-standardised columns with scale), decomposed on the driver."""
    d = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    sums = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    if sums["m0"] is None or sums["c0_0"] is None:
        raise ValueError("two rows without nulls are needed")
    scales = np.array([(sums[f"s{i}"] or 1.0) if scale else 1.0 for i in range(d)])
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float) / np.outer(scales, scales)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    top = np.argmax(np.abs(vectors), axis=1)
    vectors = vectors * np.sign(vectors[np.arange(d), top])[:, None]
    return Components(list(columns), np.array([sums[f"m{i}"] for i in range(d)]), scales, values, vectors)
