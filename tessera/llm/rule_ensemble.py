"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on a bounded sample of labelled rows give their paths as conjunctive rules; a lasso logistic fit
weighs the rules and drops most; what is left is compiled into one Spark column expression.

Defined cases: null and empty texts have zero statistics and are scored by the rules like any other; without labels of
both kinds every score is the share of label 1 (0.5 without labels); labels that repeat a doc_id count once, as their
mean; repeated rows are scored alike; of splits with one gain the first in order of features and thresholds is taken; a
text longer than a slice is a slice of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.text_statistics import quality_statistics

#: Labelled rows that the fit uses, about (a hash of doc_id chooses them when there are more).
TRAIN_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_chars", "n_upper", "n_digits", "n_marks", "n_letters", "n_single")
#: Statistic: numerator, denominator.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"), "chars_per_word": ("word_chars", "n_words"), "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digits", "n_chars"), "marks_per_word": ("n_marks", "n_words"), "letter_share": ("n_letters", "n_chars"),
    "single_share": ("n_single", "n_words"), "words_per_line": ("n_words", "n_lines"),
}
FEATURES = (*RATIOS, "n_words")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and the counts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = quality_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(got[k].astype(np.int64)) for k in COUNTS)], [*keep, *COUNTS])

    fields = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), *(f"{k} long" for k in COUNTS)])
    return docs.select(*keep, "text").mapInArrow(run, fields)


def feature_columns() -> list[Column]:
    return [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(name) for name, (a, b) in RATIOS.items()] + [F.col("n_words").cast("double").alias("n_words")]


Condition = tuple[int, bool, float]  # feature, whether it is above, threshold


@dataclass
class RuleEnsemble:
    """score = logistic(bias + sum of weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self) -> Column:
        total = F.lit(float(self.bias))
        feature = {j: (F.col(RATIOS[n][0]) / F.greatest(F.col(RATIOS[n][1]), F.lit(1)) if n in RATIOS else F.col(n).cast("double")) for j, n in enumerate(FEATURES)}
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for j, above, at in conditions:
                holds = holds & ((feature[j] > at) if above else (feature[j] <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), float(self.bias))
        for conditions, weight in self.rules:
            total += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{FEATURES[j]} {'>' if up else '<='} {t:.5g}" for j, up, t in c) for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in conditions:
        out &= x[:, j] > at if above else x[:, j] <= at
    return out


def _grow(x, bins, edges, grad, hess, rows, depth, path, out, least):
    """Best split by second-order gain over binned features; adds the path of every node to out and returns leaf steps."""
    g, h = grad[rows].sum(), hess[rows].sum()
    if path:
        out.append(path)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for j in range(x.shape[1]):
            b = bins[rows, j]
            n = len(edges[j]) + 1
            gs, hs, cs = (np.cumsum(np.bincount(b, weights=w, minlength=n)) for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(cs < least) | (len(rows) - cs < least)] = 0
            k = int(np.argmax(gain[:-1])) if n > 1 else 0
            if n > 1 and gain[k] > best[0]:
                best = (gain[k], j, k)
    step = np.zeros(len(x))
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return step
    _, j, k = best
    low = bins[rows, j] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        step += _grow(x, bins, edges, grad, hess, side, depth - 1, (*path, (j, above, float(edges[j][k]))), out, least)
    return step


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, rate: float = 0.3) -> RuleEnsemble:
    """Rules from the paths of boosted trees, weighed by logistic regression under an L1 penalty (accelerated proximal gradient)."""
    n = len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return RuleEnsemble(base, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    paths: list[tuple[Condition, ...]] = []
    raw = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        raw += rate * _grow(x, bins, edges, p - y, p * (1 - p), np.arange(n), depth, (), paths, max(5, n // 400))
    seen: dict[bytes, tuple[Condition, ...]] = {}
    for path in sorted(set(paths), key=lambda q: (len(q), q)):  # of rules that hold for the same rows the shortest stays
        seen.setdefault(np.packbits(_holds(x, path)).tobytes(), path)
    rules = list(seen.values())
    a = np.stack([_holds(x, q) for q in rules], 1).astype(np.float64)
    limit = 0.25 * np.linalg.norm(a, 2) ** 2 / n + 0.25
    w, b = np.zeros(a.shape[1]), base
    v, c, t = w.copy(), b, 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        w2 = v - a.T @ r / n / limit
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / limit, 0)
        b2 = c - r.mean() / limit
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return RuleEnsemble(float(b), [(q, float(k)) for q, k in zip(rules, w) if abs(k) > 1e-6])


def id_remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fits on at most about train_rows labelled rows; only their texts are looked at, by a join with the small broadcast sample."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("_label"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < int(train_rows / n * (1 << 20)))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = statistics(sample, ("doc_id", "_label")).select("doc_id", "_label", *feature_columns()).toPandas().sort_values(["doc_id", "_label"])
    return fit_rules(rows[list(FEATURES)].to_numpy(float), (rows["_label"].to_numpy(float) >= 0.5).astype(float))


def score_quality(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, score and predicted of every row of docs."""
    return statistics(docs).select("doc_id", model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
