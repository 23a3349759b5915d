"""Sampling designs and their diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.quantiles import beta_quantile, gamma_quantile, normal_quantile
from tessera.operators.frames import hash_unit, numeric_columns
from tessera.operators.metrics import histogram
from tessera.operators.neighbours import nearest, silhouette
from tessera.operators.order import BLOCK_ROWS, average_ranks, prefix_sums, string_place
from tessera.operators.reduction import fit_components
from tessera.operators.written import written


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows that have both; null where one of them is constant."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def bias_metrics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """duplicate_rate of whole rows, greatest absolute correlation, least and greatest sample variance, alerts."""
    cols = columns or numeric_columns(df)
    n = F.sum("_n")
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    dup = groups.agg((1 - F.count("*") / n).alias("duplicate_rate"))
    pairs = [F.abs(correlation(a, b)) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    var = [F.var_samp(c) for c in cols]
    top = lambda f, x: (f(*x) if len(x) > 1 else x[0]) if x else F.lit(0.0)
    stats = df.agg(F.coalesce(top(F.greatest, pairs), F.lit(0.0)).alias("max_abs_corr"), top(F.least, var).alias("min_variance"), top(F.greatest, var).alias("max_variance"))
    both = dup.withColumn("_k", F.lit(1)).join(stats.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    return both.withColumn("duplicate_alert", F.col("duplicate_rate") > 0.05).withColumn("correlation_alert", F.col("max_abs_corr") > 0.95)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[correlation(a, b).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("c")).select("c.*")


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns replaced by their average ranks (ties share one); ranks are counted over distinct values."""
    out = df.select(*columns)
    for c in columns:
        out = out.join(average_ranks(df, c), c)
    return out.select(*[F.col(f"{c}_rank").alias(c) for c in columns])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b]).agg(correlation(a, b).alias("rho"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and rho of every pair of columns, over rows without nulls."""
    return correlation_matrix(ranked(df.select(*columns).na.drop("any"), columns), columns).withColumnRenamed("r", "rho")


def mean_absolute(matrix: DataFrame, value: str = "rho") -> DataFrame:
    """The mean absolute value of the pairs of a correlation matrix."""
    return matrix.agg(F.avg(F.abs(value)).alias("mean_abs"))


@dataclass(frozen=True)
class Scaler:
    """(x - centre) / width of some columns, fitted on one table and applied to any; a width of 0 or null counts as 1, and constant columns get ``constant`` where it is given."""

    centre: dict[str, float | None]
    width: dict[str, float | None]
    constant: float | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """df with the scaled columns in place of the others of their names; a null stays one, also in a column whose fit saw none."""
        flat = lambda c: self.constant is not None and not self.width[c]
        return df.withColumns({c: F.lit(self.constant) if flat(c) else (F.col(c) - F.lit(self.centre[c]).cast("double")) / F.lit(self.width[c] or 1.0) for c in self.centre})


def fit_standard(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population deviation of each column, from one aggregate."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return Scaler({c: s[f"m_{c}"] for c in columns}, {c: s[f"s_{c}"] for c in columns})


def fit_minmax(df: DataFrame, columns: list[str], constant: float | None = 0.5) -> Scaler:
    """Least value and range of each column, from one aggregate."""
    s = df.agg(*[F.min(c).cast("double").alias(f"l_{c}") for c in columns], *[F.max(c).cast("double").alias(f"h_{c}") for c in columns]).first()
    return Scaler({c: s[f"l_{c}"] for c in columns}, {c: None if s[f"l_{c}"] is None else s[f"h_{c}"] - s[f"l_{c}"] for c in columns}, constant)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of df itself."""
    return fit_standard(df, columns).apply(df)


def minmax(df: DataFrame, columns: list[str], constant: float = 0.5) -> DataFrame:
    return fit_minmax(df, columns, constant).apply(df)


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.5) -> DataFrame:
    """df with value where one of columns is null or NaN."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(value)).otherwise(F.col(c).cast("double")) for c in columns})


def discrepancy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(13/12)^d - 2/N sum of [prod(1 - x^2) - prod(1/2 - |1/2 - x|)] of columns in [0, 1]."""
    prod = lambda f: reduce(lambda a, b: a * b, [f(F.col(c)) for c in columns])
    return df.agg((F.lit((13 / 12) ** len(columns)) - 2 / F.count("*") * F.sum(prod(lambda x: 1 - x * x) - prod(lambda x: 0.5 - F.abs(0.5 - x)))).alias("discrepancy"))


#: Rows that are compared on the driver at most, and the share of rows that one level of closest_pair keeps for the one before it.
FEW_ROWS, SHARE = 2_000, 16


def closest_pair(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Least Euclidean distance of two rows; null where fewer than two have all columns.

    Equal rows settle it at 0. Else the distance in a hashed share of the rows is a cell's edge for all rows, and of those in
    turn: the nearest pair lies in one cell or in two neighbouring ones, and an edge found in one row of SHARE leaves about
    SHARE pairs a row to compare, however the rows are spread. The last share is at most about FEW_ROWS rows. With more than
    three columns cells tell little, and each row looks for its nearest one between pivots (see neighbours.py).
    """
    out = lambda v: df.sparkSession.createDataFrame([(v,)], "distance double")
    names = [f"x{i}" for i in range(len(columns))]
    rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, names)]).na.drop("any")
    ends = rows.agg(F.count("*").alias("n"), *[F.min(x).alias(f"l_{x}") for x in names], *[F.max(x).alias(f"h_{x}") for x in names]).first()
    if ends["n"] < 2:
        return out(None)
    if rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return out(0.0)
    if len(columns) > 3 and ends["n"] > FEW_ROWS:
        return out(nearest_distances(rows, rows, "k", names).agg(F.min("d")).first()[0])
    spread = max(ends[f"h_{x}"] - ends[f"l_{x}"] for x in names)
    levels = 0
    while ends["n"] / SHARE**levels > FEW_ROWS / 2:
        levels += 1
    chance = F.pmod(F.xxhash64(*names), F.lit(SHARE**levels)) if levels else F.lit(0)
    few = rows.where(chance == 0).select(*names).limit(FEW_ROWS).toPandas().to_numpy(float)  # at most FEW_ROWS
    edge = _least_distance(few) if len(few) > 1 else spread
    for level in reversed(range(levels)):
        some = rows.where(F.pmod(F.xxhash64(*names), F.lit(SHARE**level)) == 0)
        found = _closest_in_cells(some, names, [ends[f"l_{x}"] for x in names], max(edge * (1 + 1e-6), spread * 1e-12))
        edge = edge if found is None else min(edge, found)
    return out(float(edge))


def _least_distance(x: np.ndarray) -> float:
    x = x[np.argsort(x[:, 0])]
    best = np.inf
    for step in range(1, len(x)):  # rows step places apart in order of the first column
        if (x[step:, 0] - x[:-step, 0]).min() > best:
            break
        best = min(best, float(np.sqrt(((x[step:] - x[:-step]) ** 2).sum(1).min())))
    return best


def _closest_in_cells(rows: DataFrame, names: list[str], low: list[float], edge: float) -> float | None:
    """Least distance of two different rows in one cell or in neighbouring ones; of two neighbours only one looks into the other."""
    cells = [f"c{i}" for i in range(len(names))]
    here = rows.select(*names, *[F.floor((F.col(x) - F.lit(v)) / edge).alias(c) for x, v, c in zip(names, low, cells)])
    steps = [()]
    for _ in names:
        steps = [(*s, o) for s in steps for o in (-1, 0, 1)]
    around = F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip(cells, s)], F.lit(not any(s)).alias("own")) for s in steps if s >= (0,) * len(names)])
    there = here.select(*[F.col(x).alias(f"z_{x}") for x in names], F.explode(around).alias("c")).select("*", "c.*").drop("c")
    d = F.sqrt(sum((F.pow(F.col(x) - F.col(f"z_{x}"), 2) for x in names), F.lit(0.0)))
    once = ~F.col("own") | (F.struct(*names) < F.struct(*[F.col(f"z_{x}").alias(x) for x in names]))
    return here.join(there, cells).where(once).agg(F.min(d)).first()[0]


def vector_distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def nearest_distances(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str | list[str] = "embedding") -> DataFrame:
    """q and d: distance of each query to its nearest other row, in bounded sets of queries against all rows."""
    features = [vector] if isinstance(vector, str) else list(vector)
    return nearest(vectors, queries, key, features, 1).select(F.col("row_id").alias("q"), F.sqrt("d").alias("d"))


def distance_entropy(distances: DataFrame, column: str = "d", bins: int = 30) -> DataFrame:
    """Shannon entropy (nats) of the histogram of a column."""
    h = histogram(distances.select(F.lit("all").alias("output"), column), column, bins)
    total = h.agg(F.sum("n").alias("_total"))
    p = F.col("n") / F.col("_total")
    return h.where("n > 0").join(F.broadcast(total)).agg((-F.sum(p * F.ln(p))).alias("entropy"))  # one row


def sampling_rule(std: Column, silhouette: Column, entropy: Column) -> Column:
    return (
        F.when((std < 0.05) & (silhouette > 0.6), "Grid").when((std > 0.2) & (silhouette < 0.3), "Random")
        .when((std >= 0.05) & (std <= 0.15), F.when(entropy < 2, "Sobol").otherwise("LHS")).otherwise("Uncertain")
    )


def classify_sampling(df: DataFrame, columns: list[str], key: str, every: int = 1, embed=None, seed: int = 0) -> DataFrame:
    """n, std, silhouette, entropy and method: nearest-neighbour distances and two clusters of an embedding in two dimensions, judged by sampling_rule().

    embed(standardised rows, columns) gives key, e1, e2; the default is the two principal components. Distances and
    silhouettes are those of every so-many-th row (by a hash of key; 1: all) against all rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = standardise(df.select(key, *columns).na.drop("any"), columns)
    if embed is None:
        fitted = fit_components(ready, columns)
        two = fitted.transform(ready, min(2, len(columns)), [key])
        flat = two.select(key, F.col("PC1").alias("e1"), (F.col("PC2") if len(columns) > 1 else F.lit(0.0)).alias("e2"))
    else:
        flat = embed(ready, columns)
    vectors = VectorAssembler(inputCols=["e1", "e2"], outputCol="_v").transform(flat)
    labelled = KMeans(k=2, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors).transform(vectors).drop("_v")
    queries = labelled if every == 1 else labelled.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)
    d = written(nearest_distances(labelled, queries, key, ["e1", "e2"]).select("d"), "nearest-distances")  # read three times
    stats = d.agg(F.count("*").alias("n"), F.stddev_pop("d").alias("std"))
    s = silhouette(labelled, queries, key, ["e1", "e2"], "cluster").agg(F.avg("s").alias("silhouette"))
    one = stats.join(s).join(distance_entropy(d))  # one row each
    return one.withColumn("method", sampling_rule(F.col("std"), F.col("silhouette"), F.col("entropy")))


#: What is said for each method.
EXPLANATIONS = {
    "Grid": "Low std and high silhouette -> Grid",
    "Random": "High std and low silhouette -> Random",
    "Sobol": "Moderate spread, low entropy -> Sobol",
    "LHS": "Moderate spread, higher entropy -> LHS",
    "Uncertain": "Pattern unclear",
}


def compare_with_random(df: DataFrame, columns: list[str], key: str, trials: int = 10, seed: int = 0) -> DataFrame:
    """discrepancy and maximin of columns scaled to [0, 1], and their means over uniform random designs of the same size."""
    spark, scaled = df.sparkSession, minmax(df.select(key, *columns), columns)
    n = scaled.count()
    own = discrepancy(scaled, columns).first()[0], closest_pair(scaled, key, columns).first()[0]
    drawn = []
    for t in range(trials):
        unit = [hash_unit(F.concat_ws("/", F.col("id"), F.lit(t), F.lit(j), F.lit(seed))).alias(c) for j, c in enumerate(columns)]
        made = spark.range(n).select("id", *unit)
        drawn.append((discrepancy(made, columns).first()[0], closest_pair(made, "id", columns).first()[0]))
    mean = [float(np.mean([x[i] for x in drawn])) for i in (0, 1)]
    return spark.createDataFrame([(float(own[0]), own[1], *mean)], "discrepancy double, maximin double, random_discrepancy double, random_maximin double")


def is_lhs(compared: DataFrame, mean_abs: DataFrame) -> DataFrame:
    """lhs_like: a discrepancy below 0.9 of random, a least distance above 1.1 of random, and a mean absolute rank correlation below 0.2."""
    rule = (F.col("discrepancy") < 0.9 * F.col("random_discrepancy")) & (F.col("maximin") > 1.1 * F.col("random_maximin")) & (F.col("mean_abs") < 0.2)
    return compared.join(mean_abs).withColumn("lhs_like", rule)  # one row each


def off_grid(points: DataFrame, levels: dict[str, list[float]], tolerance: float = 1e-6) -> DataFrame:
    """Points with a coordinate that lies further than tolerance from every level of its column."""
    ok = F.lit(True)
    for c, values in levels.items():
        gaps = F.array(*[F.abs(F.col(c) - float(v)) for v in values])
        ok = ok & (F.array_min(gaps) <= tolerance)
    return points.where(~ok)


def levels_by_gaps(df: DataFrame, column: str, tolerance: float = 1e-6) -> DataFrame:
    """v and level: each distinct value's level, from 1; a value further than tolerance from the one before it opens a new one."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).distinct()
    numbered = prefix_sums(values, "v", {"at": F.lit(1).cast("long")})
    before = numbered.select((F.col("at") + 1).alias("at"), F.col("v").alias("_before"))
    opens = numbered.join(before, "at", "left").withColumn("_opens", F.when(F.col("_before").isNull() | (F.col("v") - F.col("_before") > tolerance), 1).otherwise(0))
    return prefix_sums(opens.select("v", "_opens"), "v", {"_level": F.col("_opens")}).select("v", (F.col("_level") + F.col("_opens")).alias("level"))


def snapped(df: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """columns as the numbers of their levels (see levels_by_gaps)."""
    out = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        out = out.join(levels_by_gaps(df, c, tolerance).select(F.col("v").alias(c), F.col("level").alias(f"_l_{c}")), c, "left")
    return out.select(*[F.col(f"_l_{c}").alias(c) for c in columns])


def is_grid(df: DataFrame, columns: list[str], tolerance: float = 1e-6) -> bool:
    """Whether rows are the full product of their columns' levels: as many as the product, and no combination twice.

    Values at most tolerance apart, one after another, are one level.
    """
    counts = snapped(df, columns, tolerance).agg(F.count("*").alias("n"), F.count_distinct(*columns).alias("u"), *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)]).first()
    return counts["n"] == counts["u"] == int(np.prod([counts[f"u{i}"] for i in range(len(columns))]))


def max_multiplicity(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature and how often its most frequent value stands."""
    out = None
    for c in columns:
        part = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).agg(F.lit(c).alias("feature"), F.max("_n").alias("most"))
        out = part if out is None else out.unionByName(part)
    return out


def missing_counts(df: DataFrame) -> DataFrame:
    """feature and n_missing of the columns that have nulls."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "feature", "n_missing").where("n_missing > 0")


def unique_counts(df: DataFrame, key: str | None = None) -> DataFrame:
    """Distinct values of each column, and whether key is one for each row that has it."""
    extra = [(F.count_distinct(key) == F.count(key)).alias("key_unique")] if key else []
    return df.agg(*[F.count_distinct(c).alias(c) for c in df.columns], *extra)


def pair_histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """a, b, bin_a, bin_b, n: a two-dimensional histogram of every pair of columns (a = b: of the column alone), equal bins from least to greatest."""
    ends = df.agg(*[F.min(c).alias(f"l_{c}") for c in columns], *[F.max(c).alias(f"h_{c}") for c in columns])
    place = {c: F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(c) - F.col(f"l_{c}")) / F.nullif((F.col(f"h_{c}") - F.col(f"l_{c}")) / bins, F.lit(0.0))), F.lit(0))).cast("int") for c in columns}
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p_{a}").alias("bin_a"), F.col(f"p_{b}").alias("bin_b")) for i, a in enumerate(columns) for b in columns[i:]])
    binned = df.select(*columns).na.drop("any").join(F.broadcast(ends)).select(*[place[c].alias(f"p_{c}") for c in columns])  # one row
    return binned.select(F.explode(pairs).alias("c")).select("c.*").groupBy("a", "b", "bin_a", "bin_b").agg(F.count("*").alias("n"))


def exact_pattern(df: DataFrame, columns: list[str]) -> DataFrame:
    """Grid if the distinct counts multiply to the rows; else LHS if every column is all different; else Random."""
    n = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)])
    product, unique = F.lit(1).cast("double"), F.lit(True)
    for i in range(len(columns)):
        product, unique = product * F.col(f"u{i}"), unique & (F.col(f"u{i}") == F.col("n"))
    return n.select(F.when(product == F.col("n"), "Grid").when(unique, "LHS").otherwise("Random or other").alias("method"), "n")


def ks_two_sample(a: DataFrame, b: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Greatest gap of the two cumulative distributions, over distinct values; strings are compared as such (by their bytes)."""
    both = a.select(F.col(column).alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")).union(b.select(column, F.lit(0), F.lit(1))).where("v is not null")
    g = both.groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    text = dict(g.dtypes)["v"] == "string"
    placed = prefix_sums(g.withColumn("_place", string_place(g, "v")), "_place", {"ca": F.col("na"), "cb": F.col("nb")}, ("v",), block_rows=block_rows) if text else prefix_sums(g, "v", {"ca": F.col("na"), "cb": F.col("nb")}, block_rows=block_rows)
    summed = placed.select((F.col("ca") + F.col("na")).alias("ca"), (F.col("cb") + F.col("nb")).alias("cb"), "na", "nb")
    total = g.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return summed.join(F.broadcast(total)).agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("d"))  # one row


def grid_design(spark: SparkSession, levels: dict[str, list[float]]) -> DataFrame:
    out = None
    for name, values in levels.items():
        column = spark.createDataFrame([(float(v),) for v in values], f"{name} double")
        out = column if out is None else out.crossJoin(column)  # a full factorial design is a product by definition
    return out


def inverse_cdf(d: dict, p: np.ndarray) -> np.ndarray:
    """Quantiles of a descriptor: normal has a variance as stat2; gamma has loc, scale, shape; beta has a, b, loc."""
    a, b, c = (float(d[k]) if d.get(k) is not None else None for k in ("stat1", "stat2", "stat3"))
    if d["kind"] == "uniform":
        return a + p * (b - a)
    if d["kind"] == "normal":
        return np.array([normal_quantile(min(max(float(v), 1e-12), 1 - 1e-12), a, b**0.5) for v in p])
    if d["kind"] == "gamma":
        return gamma_quantile(p, c, a, b)
    if d["kind"] == "beta":
        return beta_quantile(p, a, b, c or 0.0)
    if d["kind"] == "categorical":
        return np.array(d["levels"], object)[np.minimum((p * len(d["levels"])).astype(int), len(d["levels"]) - 1)].astype(str)
    raise ValueError(f"unknown distribution {d['kind']}")


def _design(spark: SparkSession, unit: DataFrame, descriptors: list[dict]) -> DataFrame:
    fields = ", ".join(f"`{d['name']}` {'string' if d['kind'] == 'categorical' else 'double'}" for d in descriptors)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({d["name"]: inverse_cdf(d, b[f"u{i}"].to_numpy()) for i, d in enumerate(descriptors)})

    return unit.mapInPandas(run, fields)


def random_design(spark: SparkSession, descriptors: list[dict], n: int, seed: int = 0) -> DataFrame:
    return _design(spark, spark.range(n).select(*[hash_unit(F.concat_ws(";", F.col("id"), F.lit(seed), F.lit(i))).alias(f"u{i}") for i in range(len(descriptors))]), descriptors)


def permuted(i: Column, n: int, salt: str, rounds: int = 6) -> Column:
    """A keyed permutation of 0 .. n - 1 without sorting: a Feistel network over the next power of four, walked on until the number is below n.

    Each round mixes one half of the bits into the other by a hash of the half, the round and salt, which any input order
    undoes, so no two numbers meet; and as more than a quarter of the numbers are below n, walks are short. The same salt gives
    the same permutation on every run.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, steps = (1 << half) - 1, 64 if n > 1 else 0

    def network(x: Column) -> Column:
        state = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(F.lit(mask)).alias("r"))
        keys = F.array(*[F.lit(f"{salt}|{k}") for k in range(rounds)])
        mix = lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], k).bitwiseAND(F.lit(mask))).alias("r"))
        done = F.aggregate(keys, state, mix)
        return F.shiftleft(done["l"], half).bitwiseOR(done["r"])

    # a walk that is inside stays there; of 4^half numbers more than a quarter are, so none is outside after 64 steps but once in 10^8
    first = network(i.cast("long"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(steps, 1))), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return walk if n > 1 else F.lit(0).cast("long")


def lhs_design(spark: SparkSession, descriptors: list[dict], n: int, seed: int = 0) -> DataFrame:
    """One point in each of n strata of every variable; each variable permutes the strata in its own way, row by row."""
    if n > 2_000_000_000:
        raise ValueError("n must be at most 2,000,000,000")
    unit = [((permuted(F.col("id"), n, f"{seed}:{i}") + hash_unit(F.concat_ws(":", F.col("id"), F.lit(seed), F.lit(i)))) / n).alias(f"u{i}") for i in range(len(descriptors))]
    return _design(spark, spark.range(n).select(*unit), descriptors)


def grid_levels(d: dict, n: int) -> list:
    """Levels of a descriptor in a grid of about n points: the cube root of n many, over the range or two deviations around the mean; all levels of a category.

    A beta variable's location is left out, as the definition has it.
    """
    count = int(np.cbrt(n))
    a, b, c = (float(d[k]) if d.get(k) is not None else None for k in ("stat1", "stat2", "stat3"))
    if d["kind"] == "categorical":
        return list(d["levels"])
    if d["kind"] == "uniform":
        return np.linspace(a, b, count).tolist()
    if d["kind"] == "normal":
        mean, std = a, b**0.5
    elif d["kind"] == "gamma":
        mean, std = a + b * c, c**0.5 * b
    elif d["kind"] == "beta":
        mean, std = a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    else:
        raise ValueError(f"no grid for {d['kind']}")
    return np.linspace(mean - 2 * std, mean + 2 * std, count).tolist()


def descriptor_grid(spark: SparkSession, descriptors: list[dict], n: int, seed: int = 0) -> DataFrame:
    """The product of the descriptors' levels; of more than n points n are drawn by a hash of their number."""
    levels = [grid_levels(d, n) for d in descriptors]
    total = int(np.prod([len(v) for v in levels], dtype=object))
    number, columns, rest = F.col("id"), [], total
    for d, values in zip(descriptors, levels):
        rest //= max(len(values), 1)
        place = F.pmod(F.floor(number / max(rest, 1)), F.lit(max(len(values), 1))) + 1
        kind = "string" if d["kind"] == "categorical" else "double"
        columns.append(F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), place.cast("int")).alias(d["name"]))
    points = spark.range(total)
    if total > n:
        points = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(n)
    return points.select(*columns)


def _primitive(degree: int):
    """Primitive polynomials over two elements of a degree, as numbers with their highest bit, in ascending order."""
    order = (1 << degree) - 1
    factors = [p for p in range(2, order + 1) if order % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))]

    def power(e: int, poly: int) -> int:  # x^e modulo poly
        out, base = 1, 2
        while e:
            if e & 1:
                out = _times(out, base, poly, degree)
            base, e = _times(base, base, poly, degree), e >> 1
        return out

    for poly in range((1 << degree) | 1, 1 << (degree + 1), 2):
        if power(order, poly) == 1 and all(power(order // p, poly) != 1 for p in factors if p != order or degree > 1):
            yield poly


def _times(a: int, b: int, poly: int, degree: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = a << 1, b >> 1
        if a >> degree & 1:
            a ^= poly
    return out


def sobol_directions(dimensions: int, bits: int = 30) -> list[list[int]]:
    """Direction numbers of each dimension: the bits from the highest down, then one primitive polynomial each in ascending order.

    The first numbers of a polynomial of degree s are any odd ones below 2, 4, 8 ...; here a hash of dimension and place.
    """
    out, degree = [[1 << (bits - 1 - k) for k in range(bits)]], 1
    while len(out) < dimensions:
        for poly in _primitive(degree) if degree > 1 else [3]:
            if len(out) == dimensions:
                break
            m = [(int(np.random.default_rng([len(out), k]).integers(0, 1 << k)) << 1 | 1) & ((2 << k) - 1) for k in range(degree)]
            v = [x << (bits - 1 - k) for k, x in enumerate(m)]
            for k in range(degree, bits):
                x = v[k - degree] ^ (v[k - degree] >> degree)
                for j in range(1, degree):
                    if poly >> (degree - j) & 1:
                        x ^= v[k - j]
                v.append(x)
            out.append(v)
        degree += 1
    return out


def sobol_design(spark: SparkSession, n: int, dimensions: int = 2) -> DataFrame:
    """The first n points (x1, x2 ...) of an unscrambled Sobol sequence; each point follows from its number."""
    bits = 30
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
    columns = []
    for j, directions in enumerate(sobol_directions(dimensions, bits)):
        out = F.lit(0).cast("long")
        for k, v in enumerate(directions):
            out = out.bitwiseXOR(F.when(F.shiftright(gray, k).bitwiseAND(F.lit(1)) == 1, F.lit(v)).otherwise(F.lit(0)).cast("long"))
        columns.append((out / float(1 << bits)).alias(f"x{j + 1}"))
    return spark.range(n).select(*columns)


METHODS = {"LHS": lhs_design, "Grid": descriptor_grid, "Random": random_design}


def compare_methods(spark: SparkSession, data: DataFrame, descriptors: list[dict], n: int | None = None, methods: dict | None = None) -> DataFrame:
    """method, d: the sum over the variables of KS distances to the data of each design that could be made; least first, ties in order of methods.

    Numbers are scaled to the range of the data (which changes no KS distance) and categories compared as strings. A
    design that can't be made is left out.
    """
    n, rows = n or data.count(), []
    for order, (name, make) in enumerate((methods or METHODS).items()):
        try:
            made = make(spark, descriptors, n)
            gaps = [ks_two_sample(data.select(F.col(d["name"]).cast(made.schema[d["name"]].dataType).alias(d["name"])), made, d["name"]).first()["d"] for d in descriptors]
        except (ArithmeticError, LookupError, RuntimeError, TypeError, ValueError, PythonException):  # of the descriptors; a failed job ends the comparison
            continue
        rows.append((name, order, float(sum(gaps))))
    if not rows:
        raise ValueError("no design could be made")
    return spark.createDataFrame(rows, "method string, ord int, d double").orderBy("d", "ord").drop("ord")
