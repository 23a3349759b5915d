"""Places in a sorted order without a task that holds all rows: blocks between quantiles, totals of blocks, and prefix sums within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about; one window sorts one block.
BLOCK_ROWS = 200_000
#: Blocks at most: what one row of quantiles may hold. Beyond it blocks grow.
MOST_BLOCKS = 4095


def search_sorted(df: DataFrame, value: Column, edges: list[float], name: str, right: bool = False) -> DataFrame:
    """Adds name: how many of the ascending edges lie below value (with right: at or below it), by binary search in column expressions."""
    df = df.withColumn("_v", value).withColumn(name, F.lit(0))
    if edges:
        size = 1 << (len(edges)).bit_length()
        padded = F.array(*[F.lit(float(e)) for e in edges], *[F.lit(float("inf"))] * (size - 1 - len(edges)))
        step = size // 2
        while step:
            edge = F.get(padded, F.col(name) + (step - 1))
            below = (edge <= F.col("_v")) if right else (edge < F.col("_v"))
            df = df.withColumn(name, F.when(below & (F.col(name) + step <= len(edges)), F.col(name) + step).otherwise(F.col(name)))
            step //= 2
    return df.drop("_v")


def block_bounds(df: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> list[float]:
    """The ascending values that part the blocks; none where one block is enough."""
    value, coarse = F.col(column).cast("double"), 64
    n, bounds = df.agg(F.count("*"), F.percentile_approx(value, [k / coarse for k in range(1, coarse)], 20 * coarse)).first()
    blocks = min(MOST_BLOCKS + 1, -(-n // block_rows))
    if blocks <= coarse:  # one pass is enough: every so-many-th of its quantiles
        bounds = [bounds[round(k * coarse / blocks) - 1] for k in range(1, blocks)] if blocks > 1 and bounds else []
    else:
        bounds = df.agg(F.percentile_approx(value, [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0]
    return sorted(set(bounds or []))


def string_place(df: DataFrame, column: str) -> Column:
    """A number that grows with a string column (in order of bytes), to cut blocks by: the six bytes after what all its values begin with.

    Strings alike in these share a number, so they share a block and the string itself must order them.
    """
    low, high = (("" if v is None else v).encode() for v in df.agg(F.min(column), F.max(column)).first())
    alike = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), alike + 1, 6)), 12, "0"), 16, 10).cast("double")


def prefix_sums(df: DataFrame, column: str, sums: dict[str, Column], ties: tuple[str, ...] = (), by: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds each of sums over all rows (of the same by) that come before in order of column and ties, without the row itself."""
    bounds = block_bounds(df, column, block_rows)
    if not bounds:
        alone = Window.partitionBy(*by).orderBy(column, *ties).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(v).over(alone), F.lit(0)).alias(k) for k, v in sums.items()])
    tagged = search_sorted(df, F.col(column).cast("double"), bounds, "_block")
    for k, v in sums.items():
        tagged = tagged.withColumn(f"_x_{k}", v)
    totals = tagged.groupBy(*by, "_block").agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    # MOST_BLOCKS + 1 rows a group
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy(*by, "_block").orderBy(column, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = tagged
    for k in sums:
        placed = placed.withColumn(f"_i_{k}", F.coalesce(F.sum(f"_x_{k}").over(inside), F.lit(0)))
    out = placed.join(before, [*by, "_block"])
    return out.select(*[F.col(c) for c in df.columns], *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def row_numbers(df: DataFrame, column: str, ties: tuple[str, ...] = (), by: tuple[str, ...] = (), name: str = "x", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds name: the row's place from 0 in order of column and ties."""
    return prefix_sums(df, column, {name: F.lit(1).cast("long")}, ties, by, block_rows)


def average_ranks(df: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """column's distinct values with their average rank; ranks are summed over values, not rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    return prefix_sums(counts, column, {"_before": F.col("_c")}, block_rows=block_rows).select(column, (F.col("_before") + (F.col("_c") + 1) / 2).alias(f"{column}_rank"))


def quantiles(df: DataFrame, column: str, levels: list[float], by: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """by and q: exact quantiles of a column (linear between the two rows at a level, nulls left out), as an array.

    Distinct values are counted and placed by prefix sums; only the two values at each level come out of a block.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    placed = prefix_sums(counts, column, {"_before": F.col("_c")}, by=by, block_rows=block_rows)
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    rows = placed.join(F.broadcast(total), list(by)) if by else placed.join(F.broadcast(total))  # one row a group
    value, ends = F.col(column).cast("double"), []
    for i, q in enumerate(levels):
        at = (F.col("_n") - 1) * F.lit(float(q))
        for name, place in ((f"_l{i}", F.floor(at)), (f"_h{i}", F.ceil(at))):
            ends.append(F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")), value)).alias(name))
    found = rows.groupBy(*by).agg(*ends, F.max("_n").alias("_n"))
    share = [(F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q))) for q in levels]
    return found.select(*by, F.array(*[F.col(f"_l{i}") + share[i] * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i in range(len(levels))]).alias("q"))
