"""A corpus pipeline of five of the training-data operators, each stage a table to a table.

Every stage works on all rows that its predecessor kept. Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.bpe import bpe_encode
from boxwright.llm.line_dedup import line_dedup
from boxwright.llm.mixing import mixed
from boxwright.llm.ngram_join import ngram_dedup
from boxwright.llm.spark_util import drop, saved
from boxwright.llm.toxicity import toxicity_filter

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity_filter(docs.select(*COLUMNS), labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier document has; n_chars follows the text."""
    return line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over 5-word shingles."""
    return ngram_dedup(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn words of each document, a row for each pass over its source; n_chars follows the text."""
    return mixed(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the token ids of each row, and the SHA-256 of the text that they decode to."""
    encoded = bpe_encode(docs.select("doc_id", "source", "text"), back="decoded")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

#: SQL cannot express the classifier, the draws or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
