"""A corpus pipeline over documents: quality rules, near duplicates, repeated passages, benchmark leaks, SentencePiece ids.

Each stage works on all that the one before it kept; all but the last return the columns of documents. A stage's result is
written before the next one runs, which deletes what the one before it had set aside.

Defined cases: an empty table gives no rows; rows alike are judged alike. Null, empty and blank texts fail the quality rules
and go there; where a stage is given some, near duplicates and benchmark leaks keep them (they are near nothing), repeated
passages keep them, too (they hold no passage), and their list of ids is empty. Rows with a null doc_id pass every stage that
their text passes: each is a group of its own among near duplicates. Other columns stay as they are, whatever their names, up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, materialize, stage
from tessera.llm.decontamination import drop_contaminated
from tessera.llm.ngram_join import keep_one_of_each
from tessera.llm.quality_rules import keep_good
from tessera.llm.sentencepiece_codec import encode_documents
from tessera.llm.suffix_dedup import remove_repeats


#: A repeated passage has so many whole words; at four bytes a word with its space, that many are in strings of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more that are found elsewhere, too, go; so do documents of which no word is left."""
    return remove_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and their number."""
    return encode_documents(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark leaks", benchmark_leaks), ("SentencePiece ids", piece_ids)]

#: Tokenisers and similarity joins can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
