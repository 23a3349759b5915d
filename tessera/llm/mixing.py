"""Mixing sources to target weights: complete epochs, then a weighted sample without replacement up to a token budget.

Targets. A source's target is its share, by weight, of all words; where that is over ``most`` times its own size the
target stops there and the excess is shared again by weight among the others, until none is above. Each round is one
aggregate over the sources.

Sampling. A source takes every document as many times as its target holds its size, and fills the rest with a sample by
Efraimidis and Spirakis: document i has the exponential key -ln(u) / w with its quality weight w, and documents are
taken in order of their keys. Spark sorts all rows once by source and key over range partitions, so a source that has a
third of all rows is spread over as many partitions as it fills; prefix sums within a partition, and over the partitions
of a source, say where the budget ends. The document that would exceed it is passed over, and the next ones that still
fit are taken, round by round, until no document of the source fits the words that are left (first fit in order of
keys). Draws come from md5 of doc_id and text, so reruns agree on any engine.

Defined cases: a null text has no words, and documents without words take nothing; a null source is a source of its own,
the last; a null doc_id draws as ``null``; rows alike in doc_id, source and text are one row that counts many times, so
each takes as much as any other but for the copies that the budget ends at; of equal keys the lower doc_id, then the
lower md5 of the text goes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, deal_copies, default_partitions, discard, in_worker, materialize, slices
from tessera.llm.text_statistics import base_statistics

#: Weights that sources get by turns, in order of their names.
TURNS = (1, 2, 3)
#: How many times its own size a source (and so a document) is taken at most.
MOST = 3
#: The least quality weight of a document.
LEAST_WEIGHT = 0.05


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s = base_statistics(batch.column("text"))
        ink, lines = np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
        weight = np.maximum((s["word_chars"] - s["n_symbols"]) / ink * ((s["n_lines"] - s["n_dup_lines"]) / lines), LEAST_WEIGHT)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "digest")), pa.array(s["n_words"].astype(np.int64)), pa.array(weight)], ["doc_id", "source", "digest", "size", "weight"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest (md5 of the text), size (words) and weight of every row of docs (doc_id, source, text).

    The quality weight is the share of word characters that are no symbols times the share of lines that repeat no
    earlier one, LEAST_WEIGHT at least.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    return keyed.mapInArrow(in_worker(_measured), "doc_id long, source string, digest string, size long, weight double")


def exponential_key(doc_id: Column, digest: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u strictly between 0 and 1 from md5: the least keys are a weighted sample without replacement."""
    digits = F.substring(F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)), 1, 12)
    return -F.ln((F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)) / weight


def source_targets(sizes: DataFrame, turns: Sequence[int] = TURNS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """sizes (source, source_size: one row a source) with sid (place by code points, null last) and target, written.

    The targets of all sources add up to ``share`` of all sizes, or to ``most`` times these where that is less.
    """
    # one sort over range partitions; what stands before a partition is added up over partitions
    by_name = sizes.repartitionByRange(default_partitions(sizes.sparkSession), F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    placed = materialize(by_name.withColumn("_at", F.monotonically_increasing_id()), "sources-by-name")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    turn = F.element_at(F.array(*map(F.lit, turns)), (F.pmod("sid", F.lit(len(turns))) + 1).cast("int"))
    numbered = placed.join(F.broadcast(starts), part == F.col("_part")).select("source", "source_size", (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("sid"))
    sources = materialize(numbered.withColumn("turn", turn.cast("long")), "sources")
    discard(placed)
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    open_words, open_turns = share * all_words, None
    above = F.lit(False)
    while True:  # a source once above stays above, since the others' level only rises
        full, turns_left = sources.agg(F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("turn"))), F.lit(0))).first()
        if turns_left == open_turns:
            break
        open_words, open_turns = share * all_words - full, turns_left
        if not turns_left:
            break
        above = F.lit(open_words) * F.col("turn") / F.lit(turns_left) > most * F.col("source_size")
    level = F.lit(float(open_words)) * F.col("turn") / F.lit(max(open_turns or 0, 1))
    return sources.select("sid", "source", "source_size", F.when(above if open_turns else F.lit(True), most * F.col("source_size")).otherwise(level).cast("double").alias("target"))


def _first_fit(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each round and source of budgets (sid, budget) in which rows (written; sid, part, pos, size, n) were taken: sid, since, until, fits and copies.

    A round takes all copies of the rows after place since and before until with a size up to fits, and so many copies of the row at until.
    """
    found: list[DataFrame] = []
    open_ = budgets.where("budget > 0").select("sid", F.lit(-1).cast("long").alias("since"), F.col("budget").alias("fits"))
    ahead = Window.partitionBy("sid", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        open_ = broadcast_if_small(open_)
        left = rows.where("size > 0").join(open_, "sid").where("pos > since and size <= fits")
        sums = left.groupBy("sid", "part").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
        starts = sums.select("sid", "part", F.coalesce(F.sum("words").over(parts), F.lit(0)).alias("start"), "words")
        # the one partition of a source at which its budget ends is summed row by row
        ends = left.join(starts, ["sid", "part"]).where("start <= fits and start + words > fits")
        summed = ends.withColumn("before", F.col("start") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(ahead), F.lit(0)))
        crossing = summed.where("before <= fits and before + n * size > fits").select("sid", "since", F.col("pos").alias("until"), "fits", F.expr("(fits - before) div size").alias("copies"), F.expr("(fits - before) % size").alias("gap"))
        whole = starts.groupBy("sid").agg(F.sum("words").alias("_all")).join(open_, "sid").where("_all <= fits").select("sid", "since", F.lit((1 << 63) - 1).alias("until"), "fits", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("gap"))
        round_ = materialize(crossing.unionByName(whole), "first-fit")
        if round_.isEmpty():
            discard(round_)
            break
        found.append(round_)
        open_ = round_.where("gap > 0").select("sid", F.col("until").alias("since"), F.col("gap").alias("fits"))
    if not found:
        return rows.sparkSession.createDataFrame([], "sid long, since long, until long, fits long, copies long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("gap")


def mix_sources(docs: DataFrame, turns: Sequence[int] = TURNS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), weight, epochs and taken (words, repeats counted) of every row of docs."""
    spark = docs.sparkSession
    alike = materialize(measured(docs).groupBy("doc_id", "source", "digest").agg(F.first("size").alias("size"), F.first("weight").alias("weight"), F.count("*").alias("n")), "documents-to-mix")
    targets = source_targets(alike.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), turns, share, most)
    targets = materialize(targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")), "source-targets")
    keyed = alike.join(broadcast_if_small(targets.select("sid", F.col("source").alias("_source"))), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    order = ["sid", "key", "doc_id", "digest"]
    by_key = keyed.withColumn("key", exponential_key(F.col("doc_id"), F.col("digest"), F.col("weight"))).repartitionByRange(default_partitions(spark), *order).sortWithinPartitions(*order)
    pos = F.monotonically_increasing_id()
    rows = materialize(by_key.select("sid", "doc_id", "size", "weight", "n", pos.alias("pos")).withColumn("part", F.shiftright("pos", 33)), "documents-by-key")
    discard(alike)
    budgets = targets.select("sid", F.greatest(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0)).cast("long").alias("budget"))
    rounds = _first_fit(rows, budgets).groupBy("sid").agg(F.collect_list(F.struct("since", "until", "fits", "copies")).alias("rounds"))  # few a source: each takes what the one before left
    facts = broadcast_if_small(materialize(targets.join(rounds, "sid", "left"), "source-rounds"))
    in_round = lambda r: (F.col("pos") > r["since"]) & (F.col("pos") < r["until"]) & (F.col("size") <= r["fits"])
    once = F.when(F.exists("rounds", in_round), F.col("n")).otherwise(F.coalesce(F.aggregate("rounds", F.lit(0).cast("long"), lambda a, r: F.when(F.col("pos") == r["until"], r["copies"]).otherwise(a)), F.lit(0)))
    chosen = rows.join(facts, "sid").withColumn("once", F.when(F.col("size") > 0, once).otherwise(0))
    dealt = deal_copies(chosen.select("doc_id", "source", "size", "source_size", "target", "weight", "epochs", "once", "pos", "n"), "n", "copy")
    taken = (F.col("epochs") + (F.col("copy") < F.col("once")).cast("long")) * F.col("size")
    return dealt.select("doc_id", "source", "size", "source_size", "target", "weight", "epochs", taken.alias("taken"))
