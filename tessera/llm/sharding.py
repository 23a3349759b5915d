"""Sharding by rendezvous hashing of stable record keys over weighted shards, in column expressions alone.

Each shard draws -weight / ln(u) with u from a hash of the record's key and the shard's number; the highest wins. A new
shard can only win records for itself, so a change in the number of shards moves no record between the others. Draws come
from md5, so any engine can recompute them.

Defined cases: a null key counts as the key "null"; a null text has size 1 and the crc of no bytes; of equal draws the
lower shard wins; rows that repeat a key go to one shard, as the law wants; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import deal_copies, materialize

#: Rows of one shard, about, that one window sorts.
SLOT_ROWS = 20_000


def unit_draw(key: Column, shard: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of a key and a shard's number: the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws("/", key, shard.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def _draw(key: Column, shard: int, weight: float) -> Column:
    return F.lit(-float(weight)) / F.ln(unit_draw(key, F.lit(shard)))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins the key; the lower number wins a tie."""
    draws = [F.struct(_draw(key, k, w).alias("draw"), F.lit(-k).alias("below")) for k, w in enumerate(weights) if w > 0]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["below"]).cast("int")


def shard_records(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard of that weight).

    Rows alike in doc_id, size and crc are counted first and numbered as a whole, so a key that a third of all rows have is
    one row until its slots are dealt out, and these are dealt in runs over all tasks.
    """
    text, n = F.coalesce(F.col("text"), F.lit("")), len(weights)
    record = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = materialize(record.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "records")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = alike.select("*", rendezvous_shard(key, weights).alias("shard"), rendezvous_shard(key, [*weights, grown]).alias("grown_shard"))
    # a bucket has about SLOT_ROWS rows of alike, so no window holds a whole shard
    buckets = max(16, -(-alike.count() // (n * SLOT_ROWS)) * 4)
    placed = materialize(drawn.withColumn("bucket", F.pmod(F.crc32(F.concat_ws("/", key, "size", "text_crc32").cast("binary")), F.lit(buckets)).cast("int")), "sharded-records")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("_n")).select("shard", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    dealt = deal_copies(first.withColumn("first", F.col("start") + F.col("earlier")), "n", "copy")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")
