"""Nearest rows and silhouettes against all pairs, by every plan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import design, distance_sums, neighbours


def all_pairs(x, y, ids, queries, k, apart):
    out = {}
    for q in queries:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - x[q, j]) ** 2
        if apart:
            d[q] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[ids[q]] = [(p + 1, ids[o], d[o], y[o]) for p, o in enumerate(order) if np.isfinite(d[o])]
    return out


def frame(spark, x, y, ids):
    rows = [(i, [float(v) for v in row], float(row[0]), float(row[1]), float(z)) for i, row, z in zip(ids, x, y)]
    return spark.createDataFrame(rows, f"id {'string' if isinstance(ids[0], str) else 'long'}, v array<double>, a double, b double, y double").repartition(5)


@pytest.mark.parametrize("case", ["direct", "pivots", "hot", "strings"])
def test_nearest_equals_all_pairs(spark, monkeypatch, case):
    """Ties, a value that a third of all rows have, cells cut into rings, and keys that are strings."""
    rng = np.random.default_rng(2)
    n = 600
    x = np.vstack([rng.integers(0, 9, (n // 3, 2)), rng.normal(3, 8, (n // 3, 2)), np.full((n // 3, 2), 4.0) if case == "hot" else rng.normal(-20, 1, (n // 3, 2))]).astype(float)
    y = np.arange(n) * 1.5
    ids = [f"k{i:04d}" for i in range(n)] if case == "strings" else list(range(n))
    if case != "direct":
        monkeypatch.setattr(neighbours, "DIRECT_ROWS", 0)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 24)
        monkeypatch.setattr(neighbours, "MOST_PIVOTS", 9)
    df = frame(spark, x, y, ids)
    for k, apart, features in ((4, True, ["a", "b"]), (3, False, ["v"])):
        want = all_pairs(x, y, np.array(ids), range(n), k, apart)
        near = neighbours.nearest(df, df, "id", features, k, "y", apart)
        got = {}
        for r in near.collect():
            got.setdefault(r["row_id"], []).append((r["place"], r["other"], r["d"], r["payload"]))
        assert {q: sorted(v) for q, v in got.items()} == want
        if case in ("pivots", "strings"):
            assert near.compared.value < 0.6 * n * n


@pytest.mark.parametrize("case", ["even", "far", "alike", "whole numbers", "huge"])
def test_wide_rows_equal_all_pairs_at_a_hundredth_of_the_sums(spark, monkeypatch, case):
    """Products only choose: distances, ties and places are those of all pairs, and few pairs are summed feature by feature."""
    rng = np.random.default_rng(4)
    n = 1500
    x = rng.normal(size=(n, 24))
    if case == "far":
        x += 1e8
    if case == "alike":
        x[::3] = x[0]
    if case == "whole numbers":
        x = np.round(x)
    if case == "huge":
        x[7] *= 1e200
    summed = []
    monkeypatch.setattr(neighbours, "_paired", lambda q, x, row, col, f=neighbours._paired: summed.append(len(row)) or f(q, x, row, col))
    a, b = (pa.table({key: pa.array(range(n)), "x": neighbours._lists(x), **more}) for key, more in (("q", {}), ("other", {"payload": pa.array(np.zeros(n))})))
    got = neighbours._best(6, spark.sparkContext.accumulator(0))(a, b).to_pandas().sort_values(["q", "d", "other"])
    with np.errstate(over="ignore"):
        d = neighbours._squares(x, x)
    want = np.argsort(d, axis=1, kind="stable")[:, :6]
    assert got["other"].tolist() == want.ravel().tolist() and got["d"].tolist() == np.take_along_axis(d, want, axis=1).ravel().tolist()
    if case == "even":
        assert 0 < sum(summed) < n * n / 50
    if case in ("even", "alike"):
        df = spark.createDataFrame(list(zip(range(n), x.tolist())), "id long, v array<double>").repartition(3)
        near = neighbours.nearest(df, df.where("id % 10 = 0"), "id", ["v"], 5).collect()
        other = np.where(np.eye(n, dtype=bool), np.inf, d)
        want = np.argsort(other, axis=1, kind="stable")[:, :5]
        assert len(near) == 750 and all(want[r["row_id"], r["place"] - 1] == r["other"] and r["d"] == d[r["row_id"], r["other"]] for r in near)


def test_few_rows_nulls_and_empty_tables(spark, monkeypatch):
    rows = [(1, 0.0, 1.0), (2, 1.0, 1.0), (3, None, 2.0), (4, float("nan"), 0.0), (5, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for direct in (100, 0):
        monkeypatch.setattr(neighbours, "DIRECT_ROWS", direct)
        got = sorted((r["row_id"], r["place"], r["other"]) for r in neighbours.nearest(df, df, "id", ["a", "b"], 5).collect())
        assert got == [(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)]
        assert neighbours.nearest(df, df.limit(0), "id", ["a"], 2).count() == 0
    monkeypatch.setattr(neighbours, "DIRECT_ROWS", 100)
    assert neighbours.nearest(df.limit(0), df, "id", ["a"], 2).count() == 0


def plain_silhouette(x, c, power):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) ** power
        mine = (c == c[i]) & (np.arange(len(x)) != i)
        others = [d[c == k].mean() for k in np.unique(c) if k != c[i]]
        a, b = d[mine].mean() if mine.any() else None, min(others) if others else None
        out.append(0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("clusters", [1, 2, 6])
def test_silhouettes_equal_the_definition(spark, monkeypatch, clusters):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 25)
    rng = np.random.default_rng(clusters)
    c = rng.integers(0, clusters, 200)
    x = rng.normal(size=(200, 2)) + 6 * np.column_stack([c, c % 3])
    if clusters > 2:
        c[0] = 99  # a cluster of one row
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, a double, b double, c int").repartition(4)
    for power, f in ((1, neighbours.silhouette), (2, neighbours.silhouette_squared)):
        got = {r["row_id"]: r["s"] for r in f(df, df.where("id % 2 = 0"), "id", ["a", "b"], "c").collect()}
        want = plain_silhouette(x, c, power)
        assert sorted(got) == list(range(0, 200, 2)) and np.allclose([got[i] for i in sorted(got)], want[::2])


def test_silhouettes_of_rows_alike_are_summed_once(spark, monkeypatch):
    """Forty copies of each of fifty rows: as many blocks' rows as rows that differ, and the figures of all pairs, each row without itself."""
    rng = np.random.default_rng(8)
    x, c = np.repeat(rng.normal(size=(50, 2)), 40, axis=0), np.repeat(rng.integers(0, 2, 50), 40)
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, a double, b double, c int").repartition(4)
    met = []
    monkeypatch.setattr(neighbours, "_meet", lambda left, right, *rest, f=neighbours._meet: met.append((left, right)) or f(left, right, *rest))
    got = {r["row_id"]: r["s"] for r in neighbours.silhouette(df, df, "id", ["a", "b"], "c").collect()}
    assert np.allclose([got[i] for i in range(2000)], plain_silhouette(x, c, 1))
    assert met[0][0].count() <= 100 and met[0][1].count() == 50
    apart = {r["row_id"]: r["s"] for r in neighbours.silhouette(df, df.where("id % 40 = 0").withColumn("id", F.col("id") + 10_000), "id", ["a", "b"], "c").collect()}
    assert len(apart) == 50 and all(apart[10_000 + i] > got[i] for i in range(0, 2000, 40))  # keys that the table has not leave no row out


def test_distance_sums_equal_all_pairs(spark, monkeypatch):
    """Rows on lines, in a heap of 1e-7 and far out; weights; to nine digits."""
    monkeypatch.setattr(distance_sums, "SQUARE_ROWS", 40)
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(900, 2)), np.column_stack([rng.uniform(-3, 3, 400), rng.integers(0, 5, 400)]), 1e-7 * rng.normal(size=(200, 2)) + 2, rng.normal(size=(200, 2)) * 100])
    n = len(x)
    c, w = rng.integers(0, 3, n), rng.integers(1, 4, n)
    rows = spark.createDataFrame([(v.tolist(), int(k), int(m)) for v, k, m in zip(x, c, w)], "x array<double>, c int, w long").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q long, x array<double>")
    got = distance_sums.distance_sums(rows, asked, n, 3).toPandas().sort_values(["q", "c"])
    weight = np.zeros((n, 3))
    weight[np.arange(n), c] = w
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) @ weight
    assert len(got) == 3 * n and np.allclose(got["total"].to_numpy().reshape(n, 3), want, rtol=1e-9, atol=0)


@pytest.mark.parametrize("case", ["plane", "line", "one place", "other keys"])
def test_silhouettes_by_squares_meet_no_blocks(spark, monkeypatch, case):
    """No row is copied to a block for every query, and the figures are those of all pairs."""
    monkeypatch.setattr(neighbours, "SUMMED_ROWS", 0)
    monkeypatch.setattr(distance_sums, "SQUARE_ROWS", 20)
    monkeypatch.setattr(neighbours, "_meet", None)
    rng = np.random.default_rng(3)
    c = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 2)) + 4 * np.column_stack([c, c % 2])
    x[::7] = x[0]
    if case == "one place":
        x[:] = 0.1
    if case == "line":
        x[:, 1] = 0
    features = ["a"] if case == "line" else ["a", "b"]
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, a double, b double, c int").repartition(4)
    shift = 10_000 if case == "other keys" else 0
    got = {r["row_id"] - shift: r["s"] for r in neighbours.silhouette(df, df.where("id % 2 = 0").withColumn("id", F.col("id") + shift), "id", features, "c").collect()}
    want = plain_silhouette(x, c, 1)
    assert sorted(got) == list(range(0, 400, 2))
    assert np.allclose([got[i] for i in sorted(got)], want[::2], atol=0.02 if shift else 1e-8)


def test_entropy_of_rows_that_all_have_a_twin(spark):
    """All nearest distances are 0: one bin, no division by its width."""
    d = spark.createDataFrame([(i, 0.0) for i in range(20)], "q long, d double")
    assert abs(design.distance_entropy(d).first()["entropy"]) == 0.0
