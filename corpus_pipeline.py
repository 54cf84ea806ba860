"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the documents that go on.

Documents are rows of doc_id, text, lang, source and n_chars; each stage's result is written as Parquet and read again.
Extra columns are dropped at the first stage. Ids may be null or repeat: rows are judged by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, exact, jaccard, mixing, quality
from lodestar.llm.common import discard, scratch, shared_path, table
from lodestar.llm.queries import MIXTURE, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    docs = docs.select(*COLUMNS)
    weights, bias = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels"), quality.Settings()), quality.Settings())
    return quality.keep_good(docs, weights, bias, quality.Settings())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id. Null texts come back empty."""
    return jaccard.one_of_each(docs, COLUMNS[2:]).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of strings of 200 bytes; a document of which nothing is left goes."""
    kept = exact.suffix_dedup(docs, keep_first=True, carry=("lang", "source"))
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    return kept.where(left).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose languages, sources and topics come near the target weights."""
    return mixing.mix(docs, MIXTURE).where("kept").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each document, and of the text decoded from them."""
    return bpe.tokenizer_digests(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, with each result but the last in shared storage while it is needed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the trained scores nor the classes, so a test compares with brute force.
ORACLE_SQL = None
