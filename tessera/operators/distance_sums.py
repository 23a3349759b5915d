"""Sums of Euclidean distances in the plane from every query to all rows, cluster by cluster, without all pairs.

Squares are cut into four until none holds more than a bounded number of rows. A query sums the rows of its own square and of
those nearby one by one. Squares that lie at least their own width away (the larger of both) are summed at once: a square's
rows are carried over to NODES x NODES Chebyshev points, exactly so for polynomials of that degree, and the distance is so
smooth there that nothing else is lost but about the tenth digit of a sum (tests hold 1e-9). Every row counts, however far.
What is shuffled grows with the rows; squares, their points and who is near whom go to every task, bounded by MOST_SQUARES.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.written import written

#: Chebyshev points of a square's side, rows of an uncut square at least, and uncut squares, about, at most.
NODES, SQUARE_ROWS, MOST_SQUARES = 12, 1024, 4096
#: Levels cut at a time, and how often a square is halved at most (2^-40 of the whole).
_LEVELS, _DEEPEST = 5, 40
#: Distances that one numpy pass holds.
_SUMMED = 500_000

_POINTS = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)


def _basis(u: np.ndarray) -> np.ndarray:
    """What each Chebyshev point counts at u of [-1, 1]: one row a place."""
    one, at = np.polynomial.chebyshev.chebvander(_POINTS, NODES - 1), np.polynomial.chebyshev.chebvander(u, NODES - 1)
    at[:, 1:] *= 2
    return at @ one.T / NODES


def plane(column: pa.Array) -> np.ndarray:
    """Points of arrays of one or two numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 2))
    return x if x.shape[1] == 2 else np.column_stack([x[:, 0], np.zeros(len(x))])


class _Squares:
    """Centres, half widths and the four parts (-1: none) of squares; the first holds all."""

    def __init__(self, middle: np.ndarray, half: float):
        self.middle, self.half, self.parts, self.level = [middle], [half], [[-1] * 4], [0]

    def fixed(self) -> None:
        self.m, self.h, self.p = np.array(self.middle, float).reshape(-1, 2), np.array(self.half, float), np.array(self.parts, np.int64).reshape(-1, 4)
        self.uncut, self.deepest = (self.p < 0).all(1), max(self.level)

    def add(self, parent: int, part: int) -> int:
        if self.parts[parent][part] < 0:
            h = self.half[parent] / 2
            self.parts[parent][part] = len(self.half)
            self.middle.append(self.middle[parent] + h * np.array([1 if part & 1 else -1, 1 if part & 2 else -1]))
            self.half.append(h)
            self.parts.append([-1] * 4)
            self.level.append(self.level[parent] + 1)
        return self.parts[parent][part]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The uncut square of each point."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.deepest):
            below = self.p[at, (x[:, 0] >= self.m[at, 0]) + 2 * (x[:, 1] >= self.m[at, 1])]
            at = np.where(below >= 0, below, at)
        return at

    def path(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Parts of the next levels below squares at, two bits each, the first ones highest."""
        m, h, code = self.m[at].copy(), self.h[at].copy(), np.zeros(len(x), np.int64)
        for _ in range(_LEVELS):
            right, up = x[:, 0] >= m[:, 0], x[:, 1] >= m[:, 1]
            code = 4 * code + right + 2 * up
            h /= 2
            m[:, 0] += np.where(right, h, -h)
            m[:, 1] += np.where(up, h, -h)
        return code

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Uncut squares and squares far from them, and uncut squares and uncut ones near them."""
        to = np.nonzero(self.uncut)[0]
        of, far, near = np.zeros(len(to), np.int64), [], []
        while len(to):
            gap = np.abs(self.m[to] - self.m[of]).max(1) - self.h[to] - self.h[of]
            apart = gap >= 2 * np.maximum(self.h[to], self.h[of]) * (1 - 1e-9)
            apart &= self.h[of] > 0
            beside = ~apart & self.uncut[of]
            far.append((to[apart], of[apart]))
            near.append((to[beside], of[beside]))
            to, of = to[~apart & ~beside], of[~apart & ~beside]
            below = self.p[of]
            to, of = np.repeat(to, 4), below.ravel()
            to, of = to[of >= 0], of[of >= 0]
        return *(np.concatenate(v) for v in zip(*far)), *(np.concatenate(v) for v in zip(*near))


def _cut(points: DataFrame, most: int) -> _Squares:
    """Squares cut until none holds more than most of the points (x), by counts of a few levels at a time."""
    low, high = (points.select(*[f(F.coalesce(F.get("x", F.lit(j)), F.lit(0.0))).alias(f"v{j}") for j in (0, 1)]).first() for f in (F.min, F.max))
    low, high = np.array(low, float), np.array(high, float)
    squares = _Squares((low + high) / 2, float((high - low).max()) / 2 * (1 + 1e-9))
    squares.fixed()
    heavy = np.array([0])
    while len(heavy):
        here = heavy

        def count(batches):
            for b in batches:
                x = plane(b.column("x"))
                at = squares.place(x)
                some = np.isin(at, here)
                at, x = at[some], x[some]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(squares.path(x, at))], ["square", "path"])

        found = points.select("x").mapInArrow(count, "square long, path long").groupBy("square", "path").count().collect()  # occupied squares below the heavy ones
        levels = [{(r["square"], r["path"]): r["count"] for r in found}]
        for _ in range(_LEVELS):
            up = {}
            for (s, path), n in levels[-1].items():
                up[s, path >> 2] = up.get((s, path >> 2), 0) + n
            levels.append(up)
        levels.reverse()  # levels[j]: counts of the squares j levels below
        open_ = {(s, 0): s for (s, _), n in levels[0].items() if n > most}
        for j in range(1, _LEVELS + 1):
            below = {}
            for (s, path), n in levels[j].items():
                if (s, path >> 2) in open_:
                    made = squares.add(open_[s, path >> 2], path & 3)
                    if n > most:
                        below[s, path] = made
            open_ = below
        squares.fixed()
        heavy = np.array([s for s in open_.values() if squares.level[s] < _DEEPEST and squares.half[s] > 0])
    return squares


def distance_sums(rows: DataFrame, asked: DataFrame, n: int, clusters: int) -> DataFrame:
    """q, c and total of every query of asked (q, x) and every cluster: its distances to all rows (x, c, w) of cluster c (0 to clusters - 1), each counted w times."""
    kind = asked.schema["q"].dataType.simpleString()
    squares = _cut(rows.select("x").unionByName(asked.select("x")), max(SQUARE_ROWS, -(-2 * n // MOST_SQUARES)))
    to, of, beside, near = squares.pairs()
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(squares.place(plane(b.column("x"))))], [*b.schema.names, "block"])

    rows = written(rows.select("x", "c", "w").mapInArrow(placed, "x array<double>, c int, w long, block long"), "rows-by-square")

    def carried(table: pa.Table) -> pa.Table:
        x, s = plane(table.column("x")), table.column("block")[0].as_py()
        u = (x - squares.m[s]) / (squares.h[s] or 1.0)
        c, w = table.column("c").to_numpy(), table.column("w").to_numpy()
        a, b, out = _basis(u[:, 0]), _basis(u[:, 1]), np.zeros((clusters, NODES, NODES))
        for k in range(clusters):
            mine = c == k
            out[k] = (a[mine] * w[mine, None]).T @ b[mine]
        return pa.table([pa.array([s]), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["block", "points"])

    held = np.zeros((len(squares.h), clusters, NODES, NODES))
    for r in rows.groupBy("block").applyInArrow(carried, "block long, points array<double>").toLocalIterator():  # one row a square
        held[r["block"]] = np.reshape(r["points"], held.shape[1:])
    up = [_basis((_POINTS + side) / 2) for side in (-1, 1)]
    for s in np.argsort(-np.array(squares.level), kind="stable"):  # parts before what they are parts of
        for part, below in enumerate(squares.p[s]):
            if below >= 0:
                held[s] += up[part & 1].T @ held[below] @ up[part >> 1 & 1]
    held = held.reshape(len(held), clusters, NODES * NODES)
    grid = np.stack(np.meshgrid(_POINTS, _POINTS, indexing="ij"), 2).reshape(-1, 2)

    def from_afar(s: int) -> np.ndarray:
        """Sums of the far squares' points at the points of square s, by cluster."""
        some, out = of[np.searchsorted(to, s) : np.searchsorted(to, s, "right")], np.zeros((len(grid), clusters))
        here = squares.m[s] + squares.h[s] * grid
        for at in range(0, len(some), max(1, _SUMMED // len(grid) ** 2)):
            part = some[at : at + max(1, _SUMMED // len(grid) ** 2)]
            there = (squares.m[part][:, None] + squares.h[part][:, None, None] * grid).reshape(-1, 2)
            d = np.sqrt((here[:, None, 0] - there[None, :, 0]) ** 2 + (here[:, None, 1] - there[None, :, 1]) ** 2)
            out += d @ held[part].transpose(0, 2, 1).reshape(-1, clusters)
        return out

    by = np.argsort(near, kind="stable")
    first, last = np.searchsorted(near[by], np.arange(len(squares.h))), np.searchsorted(near[by], np.arange(len(squares.h)), "right")
    wanted_by = beside[by]

    def spread(batches):
        """Every row to the squares that it is near to."""
        for b in batches:
            s = b.column("block").to_numpy()
            times = last[s] - first[s]
            row = np.repeat(np.arange(len(s)), times)
            block = wanted_by[first[s][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
            x = plane(b.column("x"))
            for at in range(0, len(row), 65_536):
                part = slice(at, at + 65_536)
                some = row[part]
                yield pa.RecordBatch.from_arrays([pa.array(x[some, 0]), pa.array(x[some, 1]), b.column("c").take(pa.array(some)), b.column("w").take(pa.array(some)), pa.array(block[part])], ["x0", "x1", "c", "w", "block"])

    def add(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        q, s = plane(a.column("x")), key[0].as_py()
        total = np.zeros((len(q), clusters))
        if len(q):
            u = (q - squares.m[s]) / (squares.h[s] or 1.0)
            afar = from_afar(s).reshape(NODES, NODES, clusters)
            total += np.einsum("ni,nj,ijc->nc", _basis(u[:, 0]), _basis(u[:, 1]), afar, optimize=True)
            x0, x1, c, w = (b.column(name).to_numpy() for name in ("x0", "x1", "c", "w"))
            weight = np.zeros((len(c), clusters))
            weight[np.arange(len(c)), c] = w
            step = max(1, _SUMMED // max(len(c), 1))
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                total[part] += np.sqrt((q[part, None, 0] - x0) ** 2 + (q[part, None, 1] - x1) ** 2) @ weight
        ids = a.column("q").combine_chunks().take(pa.array(np.repeat(np.arange(len(q)), clusters)))
        return pa.table([ids, pa.array(np.tile(np.arange(clusters, dtype=np.int32), len(q))), pa.array(total.ravel())], ["q", "c", "total"])

    left = asked.select("q", "x").mapInArrow(placed, f"q {kind}, x array<double>, block long")
    right = rows.mapInArrow(spread, "x0 double, x1 double, c int, w long, block long")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(add, f"q {kind}, c int, total double")
