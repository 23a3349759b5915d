"""Tables written to the folder that driver and executors share, so that iterative fits have a short lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
    return _LOCAL[0]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing still to be computed reads."""
    _delete(df.sparkSession, df._written)


@atexit.register
def _at_exit() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
