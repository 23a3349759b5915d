"""Sources and sinks: CSV, series, variable descriptors, logs; tidy CSV, JSON status lines, HTML reports."""

from __future__ import annotations

import json
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.frames import missing_columns, numeric_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
    return reader.csv(path, header=True)


def in_file_order(table: DataFrame, name: str = "place") -> DataFrame:
    """A table read from files with each row's place from 0, by file name and place in the file, however files are split.

    Rows of a split are numbered as they are read; the splits' row counts are added up in order of file and first byte.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = table.select(*table.columns, *split, F.monotonically_increasing_id().alias("_id"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), ["_file", "_start"]).select(*table.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(name))


def read_series(spark: SparkSession, path: str, time_col: str | None = None, value_cols: str | None = None) -> DataFrame:
    """series_id, t, value without nulls. Default: the first numeric column that isn't the time."""
    table = read_csv(spark, path)
    wanted = [c.strip() for c in value_cols.split(",")] if value_cols else [c for c in numeric_columns(table) if c != time_col][:1]
    missing = missing_columns(table, wanted)
    if missing or not wanted:
        raise ValueError(f"columns not found: {', '.join(missing) or 'no numeric column'}")
    # without a time column the order is that of the file
    order = F.col(time_col or "_place")
    if not time_col:
        table = in_file_order(table, "_place")
    long = table.select(order.alias("t"), *[F.col(c).cast("double").alias(c) for c in wanted]).unpivot("t", wanted, "series_id", "value")
    return long.where("value is not null").select("series_id", "t", "value")


def read_descriptors(path: str) -> list[dict]:
    """Variable descriptors of a YAML file with five parallel lists; the text None counts as missing."""
    import yaml

    config = yaml.safe_load(Path(path).read_text())
    none = lambda v: None if v in (None, "None") else v
    keys = ("dependent_variables", "distributions", "stat1", "stat2", "stat3")
    return [{"name": n, "kind": "categorical" if isinstance(d, list) else d, "levels": d if isinstance(d, list) else None, "stat1": none(a), "stat2": none(b), "stat3": none(c)} for n, d, a, b, c in zip(*(config[k] for k in keys))]


#: What a failed factorisation is called in logs.
FAILED = "cholesky|not positive definite"


def matching_lines(lines: DataFrame, pattern: str = FAILED, column: str = "value") -> DataFrame:
    """Rows whose text, in lower case, matches pattern."""
    return lines.where(F.lower(column).rlike(pattern))


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log that speak of a failed factorisation; a missing file has none."""
    try:
        return matching_lines(spark.read.text(path))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string")


def write_csv(table: DataFrame, path: str, single: bool = False) -> None:
    (table.coalesce(1) if single else table).write.mode("overwrite").csv(path, header=True)


def in_words(error: Exception) -> str:
    """What a page shows in place of something that could not be made: base64 of the error's text, as figures are embedded."""
    import base64

    return base64.b64encode(f"{type(error).__name__}: {error}".encode()).decode()


def status_line(**facts) -> str:
    return json.dumps(facts)


PAGE = Template("<!doctype html><meta charset='utf-8'><title>$title</title><style>table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}</style><h1>$title</h1><p>$description</p>$sections")


def write_report(path: str, title: str, description: str, sections: dict, most_rows: int = 200) -> None:
    """An HTML page with a table for each section (a DataFrame, or what makes one); a section that fails shows its error instead."""
    parts = []
    for name, table in sections.items():
        try:
            table = table if isinstance(table, DataFrame) else table()
            parts.append(f"<h2>{name}</h2>" + table.limit(most_rows).toPandas().round(3).to_html(index=False))
        except Exception as e:
            parts.append(f"<h2>{name}</h2><p>not available: {type(e).__name__}</p>")
    Path(path).write_text(PAGE.substitute(title=title, description=description.replace("\n", "<br>"), sections="".join(parts)))
