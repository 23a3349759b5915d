"""UMAP in two dimensions: a neighbour graph by descent, fuzzy weights, and a layout by sampled attraction and repulsion.

Graph. Random hyperplanes part the rows into leaves of bounded size, several times over, and the nearest rows within the
leaves are a first graph. In each round of the descent every row introduces its neighbours (its own, and a sample of the
rows that have it as theirs) to each other: what is nearer than a row's present k-th neighbour takes its place. Rounds
end when few edges change. A round is three joins by row, and no row introduces more than 2 k others. Where rows lie evenly
in many dimensions, neighbours of neighbours are no nearer than others and the descent finds fewer of them the more rows
there are; so the graph of some rows is held against the exact one, and where it has less than ``least`` of it the exact
graph of all rows is made instead, in blocks of bounded size (all pairs, see neighbours.py).

Weights. A row's distances become weights exp(-(d - rho) / sigma), rho the least positive distance and sigma such that
they add up to log2(k); both directions are joined by a + b - a b.

Layout. All rows move at once, epoch by epoch, from the first two principal components: towards their neighbours by
weight, away from ``negatives`` rows drawn by a hash of row and epoch. An epoch is a join of the edges with the positions
and one aggregate; positions are written every few epochs.

Everything repeats by seed. Rows with a null or NaN are left out; of equal distances the lower key is nearer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.frames import hash_unit
from tessera.operators.neighbours import _SUMMED, LARGE, WIDE, _lists, _matrix, _near_by_products, _paired, _rounding, _squares, _vector, _whole, nearest
from tessera.operators.reduction import fit_components
from tessera.operators.written import dropped, written

#: Rows of a leaf of the first graph, about, and how often rows are parted anew.
LEAF_ROWS, FORESTS = 64, 4
#: A row goes to one of so many numpy rows at most in a leaf (hot values are cut by a hash).
MOST_LEAF = 512
#: Rows whose neighbours are looked up exactly to judge a graph, and how much more than ``least`` of them it must have.
CHECKED, MARGIN = 500, 0.02


def _numbered(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """i (from 0, in order of key), key and x of the whole rows: one sort over range partitions, and what stands before each."""
    rows = df.select(F.col(key).alias("key"), _vector(df, columns).alias("x")).where(_whole("x"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, "key", "x").sortWithinPartitions("key", "x").withColumn("_at", F.monotonically_increasing_id()), "rows-by-key")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.join(F.broadcast(starts), part == F.col("_part")).select((F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), "key", "x")


def _closest(df: DataFrame, k: int) -> DataFrame:
    """The k nearest of each i among rows (i, j, d) that may repeat."""
    once = df.groupBy("i", "j").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return once.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def _spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature."""
    found = {r["j"]: r for r in rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}  # one row a feature
    return tuple(np.array([(found[j][c] if j in found else 0.0) or 0.0 for j in range(width)]) for c in "ms")


def _leaves(rows: DataFrame, n: int, spread: tuple[np.ndarray, np.ndarray], forest: int, seed: int) -> DataFrame:
    """rows with leaf: which side of random planes through random medians they are on, and a hash where a leaf is too full."""
    bits = max(0, int(np.ceil(np.log2(max(n / LEAF_ROWS, 1)))))
    mean, scale = spread
    width = len(mean)
    dice = np.random.default_rng([seed, forest])
    planes = dice.normal(size=(max(bits, 1), width))
    shift = dice.normal(size=max(bits, 1)) * 0.5

    def side(batches):
        for b in batches:
            away = (_matrix(b.column("x")) - mean) / np.where(scale > 0, scale, 1)
            off = away @ planes.T / np.sqrt(width) + shift
            code = np.zeros(len(off), np.int64)
            for k in range(bits):
                code = 2 * code + (off[:, k] > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], [*b.schema.names, "leaf"])

    placed = rows.mapInArrow(side, "i long, x array<double>, leaf long")
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / MOST_LEAF).alias("parts"))
    return placed.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("i", F.lit(forest)), F.col("parts")))


def _within(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("i").to_numpy(), _matrix(table.column("x"))
        if len(ids) > 4 * k and x.shape[1] >= WIDE and np.abs(x).max() < LARGE:
            i, j, d = (np.concatenate(v) for v in zip(*_near_by_products(x, x, k + 1)))
            other = i != j  # of many rows alike a row may not be among its own nearest
            i, j, d = i[other], j[other], d[other]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            return pa.table([pa.array(ids[i[first]]), pa.array(ids[j[first]]), pa.array(np.sqrt(d[first]))], ["i", "j", "d"])
        d = np.sqrt(_squares(x, x))
        np.fill_diagonal(d, np.inf)
        first = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
        return pa.table([pa.array(np.repeat(ids, first.shape[1])), pa.array(ids[first].ravel()), pa.array(np.take_along_axis(d, first, axis=1).ravel())], ["i", "j", "d"])

    return run


def _introduce(batches):
    """Pairs of the rows that one row knows, where either is nearer to the other than its present k-th neighbour."""
    for b in batches:
        known = b.column("known")
        sizes = np.diff(known.offsets.to_numpy())
        flat = known.flatten()
        ids, reach, new, x = flat.field("id").to_numpy(), flat.field("reach").to_numpy(), flat.field("new").to_numpy(zero_copy_only=False), _matrix(flat.field("x"))
        start, out = np.cumsum(sizes) - sizes, []
        slack = 2 * _rounding(x.shape[1])
        for n in np.unique(sizes):
            rows = start[sizes == n]
            for group in np.array_split(rows, -(-len(rows) * n * (n + x.shape[1]) // _SUMMED) or 1):
                at = group[:, None] + np.arange(n)
                # products tell which pairs may be near enough; these are summed feature by feature
                v = x[at] - x[at].mean(1, keepdims=True)
                squares = (v**2).sum(2)
                least = (1 - slack) * (squares[:, :, None] + squares[:, None, :]) - 2 * (v @ v.transpose(0, 2, 1))
                near = ~(least > (reach[at] ** 2 * (1 + slack))[:, :, None])
                near &= new[at][:, :, None] | new[at][:, None, :]  # pairs of old acquaintances have met
                near &= ids[at][:, :, None] != ids[at][:, None, :]
                p, a, c = np.nonzero(near)
                a, c = at[p, a], at[p, c]
                d = np.sqrt(_paired(x, x, a, c))
                nearer = d < reach[a]
                out.append((ids[a[nearer]], ids[c[nearer]], d[nearer]))
        i, j, d = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(d.astype(float)), pa.array(np.ones(len(i), bool))], ["i", "j", "d", "new"])


def neighbour_graph(rows: DataFrame, k: int = 15, rounds: int = 8, tolerance: float = 0.001, seed: int = 0, least: float = 0.9) -> DataFrame:
    """i, j and d (Euclidean) of the k nearest of each of rows (i, x), written: at least ``least`` of them, as judged on CHECKED rows, and all where the descent finds fewer."""
    rows = rows.select("i", "x")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = facts["n"], facts["width"] or 1
    first, spread = None, _spread(rows, width)
    for forest in range(FORESTS if n > MOST_LEAF else 1):
        met = _leaves(rows, n if n > MOST_LEAF else 1, spread, forest, seed).groupBy("leaf", "part").applyInArrow(_within(k), "i long, j long, d double")
        first = met if first is None else first.unionByName(met)
    if first is None or n <= MOST_LEAF:  # one leaf holds all rows: the graph is exact
        return written(_closest(first.withColumn("new", F.lit(True)), k).drop("new"), "neighbour-graph")
    graph = written(_closest(first.withColumn("new", F.lit(True)), k), "neighbour-graph")
    some = written(_exact(rows, rows.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(CHECKED), k), "exact-of-some")
    shares = []
    for step in range(rounds):
        reach = graph.groupBy("i").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach"))
        # a sample of the rows that have this one as a neighbour
        draw = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("new"), F.xxhash64("id", "at", F.lit(seed + step)), "id"))
        back = graph.select(F.col("j").alias("at"), F.col("i").alias("id"), "new").withColumn("_r", draw).where(F.col("_r") <= k).drop("_r")
        ties = graph.select(F.col("i").alias("at"), F.col("j").alias("id"), "new").unionByName(back).groupBy("at", "id").agg(F.max("new").alias("new"))
        known = ties.join(rows.join(reach, "i").withColumnRenamed("i", "id"), "id").groupBy("at").agg(F.collect_list(F.struct("id", "reach", "new", "x")).alias("known"))  # 2 k at most
        found = known.mapInArrow(_introduce, "i long, j long, d double, new boolean")
        newer = written(_closest(graph.withColumn("new", F.lit(False)).unionByName(found), k), "neighbour-graph")
        changed = newer.where("new").count()
        dropped(graph)
        graph = newer
        shares.append(graph_recall(graph, some))
        if changed <= tolerance * n * k or _out_of_reach(shares, rounds, least + MARGIN):
            break
    dropped(some)
    if shares[-1] >= least + MARGIN:
        return graph.select("i", "j", "d")
    whole = written(_exact(rows, rows, k), "neighbour-graph")
    dropped(graph)
    return whole


def _out_of_reach(shares: list[float], rounds: int, least: float) -> bool:
    """Whether a graph with these shares of the exact neighbours, round by round, stays below least though the rounds left gain as much as the last one, which gained no more than the one before."""
    if len(shares) < 3:
        return False
    gain, before = shares[-1] - shares[-2], shares[-2] - shares[-3]
    return gain <= before and shares[-1] + (rounds - len(shares)) * gain < least


def _exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return nearest(rows, queries, "i", ["x"], k).select(F.col("row_id").alias("i"), F.col("other").alias("j"), F.sqrt("d").alias("d"))


def graph_recall(graph: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (i, j) that the graph has; where exact has distances d, a neighbour as near as the last exact one counts, whichever of rows alike it is."""
    if "d" in exact.columns:  # exact is asked once
        reach = exact.groupBy("i").agg(F.max("d").alias("_reach"), F.count("*").alias("_k"))
        near = F.count(F.when(F.col("d") <= F.col("_reach") * (1 + 1e-9), 1))
        had = graph.join(reach, "i", "right").groupBy("i").agg(F.least(near, F.max("_k")).alias("_n"), F.max("_k").alias("_k"))
        found, total = had.agg(F.sum("_n"), F.sum("_k")).first()
        return found / total if total else 1.0
    total = exact.count()
    return exact.join(graph, ["i", "j"], "left_semi").count() / total if total else 1.0


def fuzzy_weights(graph: DataFrame, k: int) -> DataFrame:
    """i, j and w of both directions of every edge."""
    lists = graph.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("near"))

    def weigh(batches):
        target = np.log2(max(k, 2))
        for b in batches:
            near = b.column("near")
            sizes, flat = np.diff(near.offsets.to_numpy()), near.flatten()
            width = int(sizes.max()) if len(sizes) else 0
            d = np.full((len(sizes), width), np.inf)
            row, col = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            d[row, col] = flat.field("d").to_numpy()
            rho = np.where(np.isfinite(d) & (d > 0), d, np.inf).min(1, initial=np.inf)
            rho = np.where(np.isfinite(rho), rho, 0)
            off = np.maximum(d - rho[:, None], 0)
            low, high = np.full(len(sizes), 1e-12), np.full(len(sizes), 1e12)
            for _ in range(80):  # bisection of the logarithm
                sigma = np.sqrt(low * high)
                more = np.exp(-off / sigma[:, None]).sum(1) > target
                high, low = np.where(more, sigma, high), np.where(more, low, sigma)
            w = np.exp(-off / np.sqrt(low * high)[:, None])[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("i").to_numpy(), sizes)), flat.field("j"), pa.array(w)], ["i", "j", "w"])

    one = lists.mapInArrow(weigh, "i long, j long, w double")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    # of a pair one or both directions are there: a + b - a b
    return both.groupBy("i", "j").agg((F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0)).alias("w"))


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^(2 b)) nearest to 1 up to min_dist and exp(-(x - min_dist) / spread) beyond, by damped least squares."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-3
    f = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    for _ in range(200):
        v = f(p)
        j = np.column_stack([-v * v * x ** (2 * p[1]), -v * v * p[0] * 2 * np.log(x) * x ** (2 * p[1])])
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (y - v))
        better = ((y - f(p + step)) ** 2).sum() < ((y - v) ** 2).sum() and (p + step > 0).all()
        p, damp = (p + step, damp / 3) if better else (p, damp * 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(p[0]), float(p[1])


def layout(edges: DataFrame, start: DataFrame, epochs: int = 40, negatives: int = 5, min_dist: float = 0.1, seed: int = 0, refresh: int = 5) -> DataFrame:
    """i, e1 and e2 after so many epochs. edges: i, j, w (both directions); start: i (0 to n - 1), e1, e2."""
    n, (a, b) = start.count(), curve(min_dist)
    pulls = written(edges.select("i", "j", "w"), "layout-edges")
    at, kept = written(start, "positions"), []
    kept.append(at)
    clip = lambda v: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), v))
    for epoch in range(epochs):
        draws = F.explode(F.sequence(F.lit(0), F.lit(negatives - 1)))
        away = at.select("i", draws.alias("m")).select("i", F.least(F.floor(hash_unit(F.concat_ws("/", "i", F.lit(epoch), "m", F.lit(seed))) * n), F.lit(n - 1)).alias("j"), F.lit(-1.0).alias("w"))
        other = at.select(F.col("i").alias("j"), F.col("e1").alias("o1"), F.col("e2").alias("o2"))
        met = pulls.unionByName(away).where("i <> j").join(other, "j").join(at, "i")
        d2 = F.pow(F.col("e1") - F.col("o1"), 2) + F.pow(F.col("e2") - F.col("o2"), 2)
        power = F.pow(F.greatest(F.col("d2"), F.lit(1e-12)), b)
        pull = F.when(F.col("d2") > 0, -2 * a * b * power / F.greatest(F.col("d2"), F.lit(1e-12)) / (1 + a * power)).otherwise(0.0)
        push = 2 * b / ((0.001 + F.col("d2")) * (1 + a * power))
        force = met.withColumn("d2", d2).withColumn("g", F.when(F.col("w") > 0, pull).otherwise(push))
        # every pull goes with as many pushes as there are negatives, so pushes count by the weight of the pulls
        part = lambda c, o, sign: F.sum(F.when(F.col("w") > 0 if sign > 0 else F.col("w") < 0, F.abs("w") * clip(F.col("g") * (F.col(c) - F.col(o)))).otherwise(0.0))
        sums = force.groupBy("i").agg(F.first("e1").alias("e1"), F.first("e2").alias("e2"), F.sum(F.greatest("w", F.lit(0.0))).alias("pull"), *[part(c, o, s).alias(f"{c}{'p' if s > 0 else 'n'}") for c, o in (("e1", "o1"), ("e2", "o2")) for s in (1, -1)])
        rate = 1 - epoch / epochs
        weight = F.greatest("pull", F.lit(1.0))
        at = sums.select("i", *[(F.col(c) + rate * (F.col(f"{c}p") + F.col("pull") * F.col(f"{c}n")) / weight).alias(c) for c in ("e1", "e2")])
        if epoch % refresh == refresh - 1 or epoch == epochs - 1:
            at = written(at, "positions")
            kept.append(at)
            dropped(kept.pop(0))
    dropped(pulls)
    return at


def umap(df: DataFrame, columns: list[str], key: str, n_neighbors: int = 15, min_dist: float = 0.1, epochs: int = 40, seed: int = 0) -> DataFrame:
    """key, e1 and e2 of every whole row of df."""
    rows = written(_numbered(df, key, columns), "rows-to-embed")
    if rows.isEmpty():
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("e1"), F.lit(0.0).alias("e2"))
    width = rows.select(F.max(F.size("x"))).first()[0]
    names = [f"x{j}" for j in range(width)]
    wide = rows.select("i", *[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(names)])
    two = fit_components(wide, names).transform(wide, min(2, width), ["i"])
    top = two.agg(*[F.max(F.abs(f"PC{c + 1}")).alias(f"t{c}") for c in range(min(2, width))]).first()
    scale = 10 / (max(top) or 1.0)
    # a little noise parts rows that are alike
    noise = lambda c: (hash_unit(F.concat_ws("~", "i", F.lit(c), F.lit(seed))) - 0.5) * 1e-3
    start = two.select("i", (F.col("PC1") * scale + noise("a")).alias("e1"), ((F.col("PC2") if width > 1 else F.lit(0.0)) * scale + noise("b")).alias("e2"))
    graph = neighbour_graph(rows, n_neighbors, seed=seed)
    placed = layout(fuzzy_weights(graph, n_neighbors), start, epochs, min_dist=min_dist, seed=seed)
    return placed.join(rows.select("i", "key"), "i").select(F.col("key").alias(key), "e1", "e2")


def umap_embedding(**settings):
    """An embed= for design.classify_sampling."""
    return lambda ready, columns: umap(ready, columns, next(c for c in ready.columns if c not in columns), **settings)
