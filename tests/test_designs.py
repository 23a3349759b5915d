"""Scalers apart from their data, levels by gaps, keyed permutations and Sobol nets of any dimension."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import design


def test_scalers_are_fitted_on_one_table_and_applied_to_another(spark):
    a = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    b = spark.createDataFrame([(7.0, 6.0), (None, 1.0)], "x double, c double")
    assert [tuple(r) for r in design.fit_standard(a, ["x", "c"]).apply(b).collect()] == [(5.0, 1.0), (None, -4.0)]
    scaled = design.fit_minmax(a, ["x", "c"]).apply(b)
    assert [tuple(r) for r in scaled.collect()] == [(3.0, 0.5), (None, 0.5)]
    assert [tuple(r) for r in design.fill_missing(scaled, ["x", "c"]).collect()] == [(3.0, 0.5), (0.5, 0.5)]
    assert [tuple(r) for r in design.fit_standard(a.limit(0), ["x"]).apply(b).collect()] == [(None, 6.0), (None, 1.0)]


def test_levels_open_where_a_gap_is_wider_than_the_tolerance(spark):
    values = [0.0, 0.4999e-6, 0.5001e-6, 1.4e-6, 1.0, 1.0 + 5e-7, 2.0, 2.0 + 1.5e-6]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (1.0,)], "v double")
    got = {r["v"]: r["level"] for r in design.levels_by_gaps(df, "v").collect()}
    assert [got[v] for v in values] == [1, 1, 1, 1, 2, 2, 3, 4]
    rng = np.random.default_rng(0)
    grid = [(a + 1e-7 * rng.random(), b + 1e-7 * rng.random()) for a in (0.0, 0.25, 0.5) for b in (1.0, 2.0)]
    assert design.is_grid(spark.createDataFrame(grid, "a double, b double"), ["a", "b"])
    assert not design.is_grid(spark.createDataFrame([*grid, grid[0]], "a double, b double"), ["a", "b"])
    assert not design.is_grid(spark.createDataFrame(grid[:-1], "a double, b double"), ["a", "b"])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 200, 1000])
def test_permutations_are_whole_and_like_random_ones(spark, n):
    rows = spark.range(n).select("id", *[design.permuted(F.col("id"), n, f"s{k}").alias(f"p{k}") for k in range(6)]).toPandas()
    for k in range(6):
        assert sorted(rows[f"p{k}"]) == list(range(n))
    if n >= 200:
        rho = np.abs(np.corrcoef(rows[["id", *[f"p{k}" for k in range(6)]]].to_numpy().T)[np.triu_indices(7, 1)])
        # of 21 pairs of random permutations hardly one exceeds 3.3 deviations
        assert rho.max() < 3.3 / np.sqrt(n - 1)
        assert (np.abs(np.diff(rows["p0"])) == np.abs(np.diff(rows["p0"])[0])).mean() < 0.1


def test_sobol_points_are_nets_in_every_two_dimensions(spark):
    """Of the first 2^m points every dimension has one in each of 2^m intervals; projections of neighbours are (t, m, 2)-nets of small t."""
    m, d = 6, 7
    x = design.sobol_design(spark, 1 << m, d).toPandas().to_numpy()
    for j in range(d):
        assert sorted((x[:, j] * (1 << m)).astype(int)) == list(range(1 << m))
    for a in range(1, m):  # dimensions one and two are a (0, m, 2)-net
        boxes = set(zip((x[:, 0] * (1 << a)).astype(int), (x[:, 1] * (1 << (m - a))).astype(int)))
        assert len(boxes) == 1 << m
    # all seven polynomials are different ones, and primitive
    from tessera.operators.design import _primitive

    assert list(_primitive(2)) == [7] and list(_primitive(3)) == [11, 13] and list(_primitive(4)) == [19, 25] and len(list(_primitive(6))) == 6
    first = design.sobol_design(spark, 8).toPandas()
    assert first["x1"].tolist() == [0.0, 0.5, 0.75, 0.25, 0.375, 0.875, 0.625, 0.125] and first["x2"].tolist() == [0.0, 0.5, 0.25, 0.75, 0.375, 0.875, 0.125, 0.625]


def test_the_closest_pair_is_found_by_shares_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(design, "FEW_ROWS", 40)
    monkeypatch.setattr(design, "SHARE", 4)
    rng = np.random.default_rng(5)
    for d, spread in ((1, 1e6), (2, 1.0), (3, 1.0), (5, 1.0)):
        x = rng.random((600, d)) * spread
        x[:400] = x[:400] * 1e-4 + 0.5  # two thirds of all rows lie close together
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *[f"x{j}" for j in range(d)]])
        gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.eye(600) * 1e9
        assert design.closest_pair(df, "id", [f"x{j}" for j in range(d)]).first()[0] == pytest.approx(gaps.min(), rel=1e-6)
        again = df.unionByName(df.where("id = 17").withColumn("id", F.lit(-1).cast("long")))
        assert design.closest_pair(again, "id", [f"x{j}" for j in range(d)]).first()[0] == 0


def test_ks_of_strings_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(2)
    names = [f"name-{'é' * (k % 3)}{k * 7919 % 1000}" for k in range(300)] + ["name-", "name-\0"]
    rows = [(str(rng.choice(names)), bool(rng.random() < (0.3 if k % 2 else 0.6))) for k in range(2000)] + [(None, True)]
    df = spark.createDataFrame(rows, "v string, a boolean")
    a, b = (sorted(v.encode() for v, x in rows if v is not None and x is side) for side in (True, False))
    want = max(abs(np.searchsorted(a, v, side="right") / len(a) - np.searchsorted(b, v, side="right") / len(b)) for v in {*a, *b})
    a = df.where("a"), df.where("not a"), "v"
    assert design.ks_two_sample(*a).first()[0] == pytest.approx(want)
    assert design.ks_two_sample(*a, block_rows=20).first()[0] == pytest.approx(want)
    assert design.ks_two_sample(df.limit(0), df.limit(0), "v").first()[0] is None


def test_a_failed_job_ends_the_comparison_of_designs(spark):
    def broken(*_):
        raise ConnectionError("executors are gone")

    described = [{"name": "u", "kind": "uniform", "stat1": 0, "stat2": 1}]
    with pytest.raises(ConnectionError):
        design.compare_methods(spark, spark.range(5).select((F.col("id") / 5).alias("u")), described, methods={"x": broken})
