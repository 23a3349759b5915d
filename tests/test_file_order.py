"""Rows keep the order of their files when files are read in many splits."""

from tessera.sources import tables


def test_a_file_of_many_splits_keeps_its_order(spark, tmp_path):
    for name, first in (("b.csv", 5000), ("a.csv", 0)):
        (tmp_path / name).write_text("v,w\n" + "".join(f"{first + i},{'x' * (i % 9)}\n" for i in range(5000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = tables.read_csv(spark, str(tmp_path))
        assert table.rdd.getNumPartitions() > 5
        got = tables.in_file_order(table).collect()
        assert len(got) == 10000 and all(r["place"] == r["v"] for r in got)
        series = tables.read_series(spark, str(tmp_path), None, "v").collect()
        assert len(series) == 10000 and all(r["t"] == r["value"] for r in series)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
