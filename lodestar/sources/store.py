"""Collections at rest: Parquet partitioned by collection and epoch, with full vectors and their codes.

Batches are written to the epoch ``batch``, each micro-batch of a stream to one of its own, so both go to one store.

A write validates first and commits once, so a batch is in whole or not at all. What is rejected comes back with a reason.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.functions import jsons, text, vectors
from lodestar.operators.quantization import Codebook, decode, encode

COLUMNS = "id string, text string, embedding array<float>, metadata string, codes array<smallint>, codec string, ingest_seq long, collection string, epoch string"
#: The folders of a store, and the epoch of rows that no stream wrote.
FOLDERS, BATCH = ("collection", "epoch"), "batch"


def reject_reason(dim: int) -> Column:
    """Null for a valid row (text, embedding), else 'EmptyText' or 'DimMismatch'."""
    return F.when(text.is_blank(F.col("text")), "EmptyText").when(F.coalesce(F.size("embedding"), F.lit(-1)) != dim, "DimMismatch")


def validated(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their reason."""
    marked = rows.withColumn("reason", reject_reason(dim))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def prepared(rows: DataFrame, dim: int) -> DataFrame:
    """Rows as they are stored: an id where there is none, metadata that is JSON, scalar codes, a sequence, a collection."""
    names = set(rows.columns)
    own = lambda name, default: F.coalesce(F.col(name), default) if name in names else default
    good, _ = validated(rows, dim)
    return good.select(
        own("id", F.uuid()).cast("string").alias("id"),
        "text",
        F.col("embedding").cast("array<float>").alias("embedding"),
        jsons.json_or_empty(own("metadata", F.lit("{}"))).alias("metadata"),
        vectors.quantize(F.col("embedding")).alias("codes"),
        F.lit("scalar").alias("codec"),
        own("ingest_seq", F.unix_micros(F.current_timestamp())).cast("long").alias("ingest_seq"),
        own("collection", F.lit(S.DEFAULT_COLLECTION)).alias("collection"),
    )


def ingest(rows: DataFrame, path: str, dim: int) -> None:
    """Append the valid rows in one commit. repartition keeps a collection's files few; AQE splits large ones."""
    prepared(rows, dim).hint("rebalance", "collection").withColumn("epoch", F.lit(BATCH)).write.mode("append").partitionBy(*FOLDERS).parquet(path)


def ingest_epoch(rows: DataFrame, path: str, dim: int, epoch: str) -> None:
    """Write the valid rows as an epoch; what that epoch had in these collections before is replaced."""
    good = prepared(rows, dim).withColumn("epoch", F.lit(epoch))
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def version(docs: DataFrame) -> str:
    """A digest of the files that docs reads: another one after every write."""
    return hashlib.sha256("\n".join(sorted(docs.inputFiles())).encode()).hexdigest()


def ingest_strict(rows: DataFrame, path: str, dim: int) -> None:
    """Append all rows or, if one is invalid, none: the first invalid row's error is raised."""
    _, bad = validated(rows, dim)
    first = bad.select("reason", F.size("embedding").alias("n")).first()
    if first is not None:
        raise S.EmptyText() if first["reason"] == "EmptyText" else S.DimMismatch(dim, first["n"] if first["n"] is not None else 0)
    ingest(rows, path, dim)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows; empty if nothing was written. Reading creates nothing."""
    try:
        return spark.read.schema(COLUMNS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], COLUMNS)


def decoded(docs: DataFrame, source: str = "exact", book: Codebook | None = None) -> DataFrame:
    """docs with embedding from the full vectors ('exact'), the scalar codes ('scalar') or the codes of a book ('pq')."""
    if source == "exact":
        return docs
    if source == "pq" and book is not None:
        back = decode(encode(docs, book).withColumnRenamed("id", "__id"), book, "__id").withColumnRenamed("embedding", "__v")
        return docs.join(back, F.col("id") == F.col("__id")).withColumn("embedding", F.col("__v").cast("array<float>")).drop("__id", "__v")
    if source != "scalar":
        raise ValueError("source is 'exact', 'scalar' or, with a book, 'pq'")
    return docs.withColumn("embedding", vectors.dequantize(F.col("codes")).cast("array<float>"))


def get(docs: DataFrame, key: str, name: str = "id") -> DataFrame:
    """The row of an id; the comparison reaches the Parquet scan."""
    return docs.where(F.col(name) == key)
