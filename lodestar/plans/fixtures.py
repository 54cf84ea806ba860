"""The tables that queries run on: collections, query vectors and logs, from the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Searches take every row whose id is divisible by this as a query, against all rows.
QUERY_STEP = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, embedding, metadata (source, lang, label as JSON), collection (the language)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vectors = embeddings(spark, sf_dir)
    joined = docs.join(vectors, docs.doc_id == vectors.vec_id)
    return joined.select(F.col("doc_id").alias("id"), "text", "embedding", F.to_json(F.struct("source", "lang", "label")).alias("metadata"), F.col("lang").alias("collection"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"])


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
