"""Contracts between operators: wide tables, long predictions (row_id, output, y_true, y_pred, y_std), splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STD_FLOOR = 1e-12


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def split_names(names: str) -> list[str]:
    return [n.strip() for n in names.split(",") if n.strip()]


def drop_constant(df: DataFrame) -> DataFrame:
    """df without columns of one value (nulls beside it don't count; a column of nulls alone stays)."""
    same = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if same[c]])


def to_long(df: DataFrame, ids: list[str], outputs: list[str], value: str = "y_true") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in outputs]).unpivot(ids, outputs, "output", value)


def to_wide(df: DataFrame, value: str = "y_pred") -> DataFrame:
    return df.groupBy("row_id").pivot("output").agg(F.first(value))


def clip_std(std: Column) -> Column:
    return F.greatest(F.abs(std), F.lit(STD_FLOOR))


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) from the md5 of a key's text: the same on every run, cluster and engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def remainder_split(df: DataFrame, key: str, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """Train and test: the row whose key is divisible by parts is a test row. For keys in no order that matters."""
    test = F.pmod(F.col(key), F.lit(parts)) == 0
    return df.where(~test), df.where(test)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer) without replacement, in order of key: those of the least hash of key and seed.

    A top-n of hashes: each task keeps n rows, and no table is sorted.
    """
    picked = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return picked.orderBy(key)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows in order of key."""
    return df.orderBy(key).limit(n)


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that df has not, in their order."""
    return [c for c in wanted if c not in df.columns]


def hash_split(df: DataFrame, key: str, test_share: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the key and the seed, whatever pattern the keys have (a null key is a train row)."""
    test = F.coalesce(hash_unit(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))) < test_share, F.lit(False)) & F.col(key).isNotNull()
    return df.where(~test), df.where(test)


def kfold(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold: contiguous folds in order of key; the first n mod k have one row more."""
    from tessera.operators.order import row_numbers

    n = df.count()
    big, size = n % k, n // k
    fold = F.when(F.col("_r") < big * (size + 1), F.floor(F.col("_r") / (size + 1))).otherwise(big + F.floor((F.col("_r") - big * (size + 1)) / max(size, 1)))
    return row_numbers(df, key, name="_r").withColumn("fold", fold.cast("int")).drop("_r")


#: The cumulative probabilities of a Poisson variable of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def poisson_weight(key: Column, replicate: Column) -> Column:
    """How often a row is drawn in a replicate: Poisson of mean 1 from a hash, the large-sample form of drawing with replacement."""
    u = hash_unit(F.concat_ws("|", key.cast("string"), replicate.cast("string")))
    return sum(((u >= p).cast("int") for p in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def poisson_replicates(df: DataFrame, key: str, n: int) -> DataFrame:
    """Adds replicate and weight; rows that a replicate doesn't draw have weight 0."""
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("weight", poisson_weight(F.col(key), F.col("replicate")))


def drawn_replicates(df: DataFrame, key: str, n: int) -> DataFrame:
    """key, replicate (from 1) and weight of the rows that n draws with replacement of as many rows as df has take.

    Every draw of a replicate picks a place in the order of key by a hash of replicate and draw, so the weights of a
    replicate add up to the number of rows exactly; the draws are counted before they meet the rows.
    """
    from tessera.operators.order import row_numbers

    total = df.count()
    spark = df.sparkSession
    draws = spark.range(total).select(F.col("id").alias("_draw"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"))
    place = F.floor(hash_unit(F.concat_ws("@", "replicate", "_draw")) * total)
    picked = draws.groupBy("replicate", place.alias("_at")).agg(F.count("*").alias("weight"))
    return row_numbers(df, key, name="_at").join(picked, "_at").drop("_at")


def drop_nulls(df: DataFrame) -> DataFrame:
    """Rows without a null."""
    return df.na.drop("any")


def positive_std(std: Column, floor: float = 1e-8) -> Column:
    """std, or floor where it is not above 0."""
    return F.when(std <= 0, F.lit(floor)).otherwise(std)


def choose_metrics(table: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Long output, metric, value of the wanted metrics that the table has (default: all numbers); an error if it has none of them."""
    there = [c for c in numeric_columns(table) if c != "output"]
    chosen = there if wanted is None else [c for c in wanted if c in there]
    if not chosen:
        raise ValueError(f"none of the metrics {wanted} is in the table; it has {', '.join(there) or 'no numbers'}")
    return table.select(F.col("output").cast("string").alias("output"), *[F.col(c).cast("double").alias(c) for c in chosen]).unpivot("output", chosen, "metric", "value")


def last_part(text: Column, mark: str = "->") -> Column:
    """What follows the last mark, without spaces around it."""
    return F.trim(F.substring_index(text, mark, -1))


def common_labels(*tables: DataFrame) -> DataFrame:
    """The labels (one column each) that every table has; each table gives each of its labels once, so no task sorts the rows of one label."""
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.unionAll(t.distinct())
    return out.groupBy(*tables[0].columns).agg(F.count("*").alias("_tables")).where(F.col("_tables") == len(tables)).drop("_tables")


def count_labels(*tables: tuple[DataFrame, str]) -> DataFrame:
    """label and n over the given columns of the given tables, one after another."""
    parts = [t.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")) for t, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flatten_structs(df: DataFrame) -> DataFrame:
    """Struct columns become their fields; a field whose name is taken is called column_field."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, T.StructType)]
    taken, out = set(plain), [F.col(c) for c in plain]
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                name = f"{f.name}_{g.name}" if g.name in taken else g.name
                taken.add(name)
                out.append(F.col(f"{f.name}.{g.name}").alias(name))
    return df.select(*out)
