"""The embedding's parts: recall of the graph against all pairs, weights and curve against their definitions, and what the layout keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import design, neighbours, umap


def blobs(n, d, seed=0, groups=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) + 8 * rng.normal(size=(groups, d))[np.arange(n) % groups]


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, x array<double>").repartition(4)


@pytest.mark.parametrize("d", [2, 16])
def test_graph_finds_nine_of_ten_neighbours(spark, d):
    """Measured against the exact search; a value that many rows have is among them."""
    x = blobs(1500, d)
    x[::10] = x[0]
    rows = table(spark, x)
    exact = neighbours.nearest(rows, rows, "i", ["x"], 10).select(F.col("row_id").alias("i"), F.col("other").alias("j"), F.sqrt("d").alias("d"))
    graph = umap.neighbour_graph(rows, 10)
    apart = exact.join(exact.groupBy("i").agg(F.max("d").alias("reach")), "i").where("reach > 0")  # rows alike are as near as any other of them
    assert umap.graph_recall(graph, apart.select("i", "j")) >= 0.9
    assert graph.groupBy("i").count().where("count <> 10").count() == 0 and graph.where("i = j").count() == 0


def test_graph_of_rows_without_structure(spark):
    """Unit vectors in 64 dimensions: neighbours know no neighbours, so the descent alone finds too few of them."""
    x = np.random.default_rng(3).normal(size=(5000, 64))
    rows = table(spark, x / np.linalg.norm(x, axis=1)[:, None])
    exact = neighbours.nearest(rows, rows.where("i % 10 = 0"), "i", ["x"], 10).select(F.col("row_id").alias("i"), F.col("other").alias("j"))
    graph = umap.neighbour_graph(rows, 10)
    assert umap.graph_recall(graph.where("i % 10 = 0"), exact) >= 0.9 and graph.count() == 50_000


def test_hopeless_descents_are_given_up(spark, monkeypatch):
    """Evenly spread rows: the descent ends after few rounds, the exact neighbours of all are asked once, and equal those of all pairs."""
    x = np.random.default_rng(5).normal(size=(2500, 64))
    rows, asked = table(spark, x), []
    monkeypatch.setattr(umap, "nearest", lambda *a, f=umap.nearest: asked.append(a[1].count()) or f(*a))
    rounds = []
    monkeypatch.setattr(umap, "graph_recall", lambda *a, f=umap.graph_recall: rounds.append(1) or f(*a))
    got = umap.neighbour_graph(rows, 5, rounds=20, tolerance=-1).toPandas().sort_values(["i", "d", "j"])
    d = neighbours._squares(x, x)
    np.fill_diagonal(d, np.inf)
    assert asked == [umap.CHECKED, 2500] and len(rounds) < 20
    assert got["j"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :5].ravel().tolist()
    assert not umap._out_of_reach([0.1, 0.2], 8, 0.9) and not umap._out_of_reach([0.1, 0.2, 0.4], 8, 0.9) and umap._out_of_reach([0.1, 0.2, 0.25], 8, 0.9)


def test_exact_neighbours_are_made_once_a_recall(spark):
    seen = spark.sparkContext.accumulator(0)
    exact = spark.range(60).select((F.col("id") % 20).alias("i"), (F.col("id") % 7 + 100).alias("j"), (F.col("id") % 3 + 1.0).alias("d"))
    counted = exact.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), exact.schema)
    assert umap.graph_recall(exact.where("i >= 5"), counted) == 0.75 and seen.value == 60


def test_weights_add_up_to_log2_k(spark):
    x = blobs(120, 3)
    rows = table(spark, x)
    graph = umap.neighbour_graph(rows, 8)
    got = {(r["i"], r["j"]): r["w"] for r in umap.fuzzy_weights(graph, 8).collect()}
    near = {}
    for r in graph.collect():
        near.setdefault(r["i"], []).append((r["d"], r["j"]))
    one = {}
    for i, v in near.items():
        d = np.array(sorted(d for d, _ in v))
        low, high = 1e-9, 1e9
        for _ in range(200):
            mid = np.sqrt(low * high)
            low, high = (mid, high) if np.exp(-(d - d[0]) / mid).sum() < 3 else (low, mid)
        one |= {(i, j): float(np.exp(-(dd - d[0]) / low)) for dd, j in v}
    want = {}
    for i, j in {*one, *((j, i) for i, j in one)}:
        a, b = one.get((i, j), 0.0), one.get((j, i), 0.0)
        want[i, j] = a + b - a * b
    assert set(got) == set(want) and all(got[e] == pytest.approx(want[e], abs=1e-6) for e in want)


def test_curve_is_the_known_one():
    a, b = umap.curve(0.1, 1.0)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)


def test_layout_keeps_groups_apart_and_repeats(spark):
    x = blobs(160, 5, 3, 2)
    df = spark.createDataFrame([(f"k{i:03d}", *map(float, v)) for i, v in enumerate(x)] + [("null", None, 0.0, 0.0, 0.0, 0.0)], "key string, " + ", ".join(f"c{j} double" for j in range(5)))
    got = umap.umap(df, [f"c{j}" for j in range(5)], "key", 8, epochs=8).toPandas().sort_values("key")
    assert len(got) == 160 and np.isfinite(got[["e1", "e2"]].to_numpy()).all()
    e = got[["e1", "e2"]].to_numpy()
    d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    # the five nearest in the plane are of the row's own group
    assert (np.argsort(d, axis=1)[:, :5] % 2 == (np.arange(160) % 2)[:, None]).mean() > 0.98
    again = umap.umap(df.repartition(3), [f"c{j}" for j in range(5)], "key", 8, epochs=8).toPandas().sort_values("key")
    assert np.allclose(again[["e1", "e2"]], got[["e1", "e2"]], atol=1e-6)


def test_classifier_takes_the_embedding(spark):
    x = blobs(90, 3, 5, 2)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    r = design.classify_sampling(df, ["a", "b", "c"], "id", embed=umap.umap_embedding(n_neighbors=6, epochs=4)).first()
    assert r["n"] == 90 and r["silhouette"] > 0.3 and r["method"] in design.EXPLANATIONS
    assert umap.umap(df.limit(0), ["a"], "id").count() == 0
