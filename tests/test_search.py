"""Model-based search against random search, and exact draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import estimators, frames

SPACE = {"a": list(range(12)), "b": list(range(12)), "c": ["x", "y", "z"]}


def goal(s):
    return -((s["a"] - 8) ** 2) - (s["b"] - 3) ** 2 - 20 * (s["c"] != "y")


def test_search_beats_random_trials():
    found, chance = [], []
    for seed in range(30):
        search = estimators.ParzenSearch(SPACE, seed=seed)
        got = []
        for _ in range(12):
            s = search.ask()
            got.append(goal(s))
            search.tell(s, got[-1])
        found.append(max(got))
        grid = estimators.settings_grid(SPACE)
        chance.append(max(goal(grid[i]) for i in np.random.default_rng(seed).permutation(len(grid))[:12]))
    assert np.mean(found) > np.mean(chance) + 1 and np.median(found) > np.median(chance)


def test_search_tries_nothing_twice_and_survives_failures():
    search, seen = estimators.ParzenSearch({"a": [1, None], "b": ["u", "v", "w"]}, startup=2), []
    for k in range(6):
        s = search.ask()
        assert s not in seen
        seen.append(s)
        search.tell(s, float("nan") if k % 2 else k)
    with pytest.raises(StopIteration):
        search.ask()


def test_search_over_a_table_repeats(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 8, 150)
    df = spark.createDataFrame([(i, "y", float(v), float(np.floor(v))) for i, v in enumerate(x)], "row_id long, output string, x double, y_true double")
    runs = [estimators.model_search(df, ["x"], estimators.Tree, {"max_depth": [1, 2, 3, 4]}, trials=3, cv=2, seed=5).collect() for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 3 and runs[0][0]["score"] >= runs[0][-1]["score"]


def test_every_replicate_has_as_many_draws_as_rows(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(157)], "k long")
    got = frames.drawn_replicates(df, "k", 5).groupBy("replicate").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).collect()
    assert len(got) == 5 and {r["n"] for r in got} == {157} and all(80 < r["rows"] < 115 for r in got)


def test_noise_on_the_targets_is_normal_and_repeats(spark):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.lit("y").alias("output"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y_true"))
    noise = estimators.with_noise(rows, 10.0).select((F.col("y_true") - 1).alias("e"))
    s = noise.agg(F.avg("e"), F.stddev("e"), F.kurtosis("e"), F.avg((F.abs("e") < 10).cast("int"))).first()
    assert abs(s[0]) < 0.6 and abs(s[1] - 10) < 0.5 and abs(s[2]) < 0.4 and abs(s[3] - 0.683) < 0.03
    assert noise.exceptAll(estimators.with_noise(rows.repartition(5), 10.0).select(F.col("y_true") - 1)).count() == 0
    got = estimators.compare_with_noisy(estimators.Linear, rows, rows, ["x"], 10.0).first()
    assert got["model"] < 1e-6 < got["noisy"] < 1


def test_folds_are_numbered_once_and_not_broadcast(spark, monkeypatch):
    """Every fold of every candidate reads the written folds; no table as long as the rows goes through the driver."""
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.lit("y").alias("output"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2).cast("double").alias("y_true"))
    seen = []
    monkeypatch.setattr(estimators, "kfold", lambda df, key, k, f=estimators.kfold: seen.append(f(df, key, k)) or seen[-1])
    monkeypatch.setattr(estimators, "cross_validate", lambda folded, *rest, f=estimators.cross_validate: seen.append(folded) or f(folded, *rest))
    search = estimators.AutoDetect([estimators.Linear, estimators.Mean], [{}, {}])
    assert set(search.fit(rows, ["a"]).chosen_.values()) == {0}
    assert all(len(t.inputFiles()) for t in seen[1:]) and len(seen) == 3
    assert "BroadcastHashJoin" not in search._row_ids(rows)._jdf.queryExecution().executedPlan().toString()


def test_common_labels_shuffle_each_label_once(spark):
    """As an intersection, nulls included; both sides are reduced to their labels before any shuffle."""
    a = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), F.col("id") % 3)).alias("label"))
    b = spark.range(3000).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("l"), F.col("id") % 4)).alias("other"))
    both = frames.common_labels(a, b)
    assert both.columns == ["label"] and sorted(str(r[0]) for r in both.collect()) == ["None", "l1", "l2"]
    assert "Join" not in both._jdf.queryExecution().executedPlan().toString()
    assert frames.common_labels(a).count() == 3
