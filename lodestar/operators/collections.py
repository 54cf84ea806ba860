"""Collections, shards and replicas as columns; stats, retention, and top-k across shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.functions import text, vectors
from lodestar.operators.search import exact_topk, hybrid


def in_collection(docs: DataFrame, name: str) -> DataFrame:
    """One collection's rows; reading never creates one, so an unknown name is empty."""
    return docs.where(F.col("collection") == name)


def list_collections(docs: DataFrame) -> DataFrame:
    return docs.select("collection").distinct()


def stats(docs: DataFrame, dim: int, config: S.IndexConfig = S.IndexConfig()) -> DataFrame:
    """A row for each collection: documents, dimension and what the index is."""
    return docs.groupBy("collection").agg(F.count(F.lit(1)).alias("num_documents")).select(
        "collection",
        "num_documents",
        F.lit(dim).alias("embedding_dim"),
        F.lit(config.label).alias("index_type"),
        F.lit(config.max_connections).alias("max_connections"),
        F.lit(config.ef_construction).alias("ef_construction"),
        F.lit(config.ef_search).alias("ef_search"),
    )


def routed(docs: DataFrame, shards: int) -> DataFrame:
    """docs with the primary shard of their collection."""
    return docs.withColumn("shard", text.shard_of(F.col("collection"), shards))


def placed(docs: DataFrame, shards: int, replicas: int) -> DataFrame:
    """A row for each replica (ids stay the same): replica number and shard. More replicas than shards repeat shards."""
    primary = text.shard_of(F.col("collection"), shards)
    return docs.withColumn("__p", primary).select(docs["*"], F.posexplode(text.replica_shards(F.col("__p"), shards, replicas)).alias("replica", "shard"))


def list_all(docs: DataFrame, shards: int, replicas: int = 1) -> DataFrame:
    """Names on every shard; a replicated collection is listed on each."""
    return placed(docs.select("collection").distinct(), shards, replicas).select("shard", "collection").distinct()


def shard_search(docs: DataFrame, collection: str, query: Sequence[float], limit: int, shards: int, key: str = "id", query_text: str | None = None) -> DataFrame:
    """Search a collection on its primary shard: the filter on the shard prunes partitions where it is a partition column."""
    own = in_collection(routed(docs, shards), collection).where(F.col("shard") == text.shard_of(F.lit(collection), shards))
    if query_text is None:
        return exact_topk(own, query, limit, key)
    return hybrid(own, query_text, query, limit, key)


def cross_shard_topk(docs: DataFrame, query: Sequence[float], limit: int, key: str = "id", shard: str = "shard") -> DataFrame:
    """rank, key, shard, score, distance: twice the limit of each shard, then the best of all."""
    scored = docs.select(shard, key, vectors.dot(F.col("embedding"), vectors.literal(query)).alias("dot"))
    local = F.row_number().over(Window.partitionBy(shard).orderBy(F.desc("dot"), key))
    best = scored.withColumn("local", local).where(F.col("local") <= 2 * limit).orderBy(F.desc("dot"), key).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("dot"), key))  # over limit rows
    score = vectors.search_score(F.col("dot"))
    return best.select(rank.cast("int").alias("rank"), key, shard, score.alias("score"), (1.0 - score).alias("distance"))


def retain(docs: DataFrame, most: int, sequence: Column | str, by: Sequence[str] = ("collection",)) -> DataFrame:
    """The newest ``most`` rows of each collection by ingest sequence; nothing of the others stays in any index."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy((F.col(sequence) if isinstance(sequence, str) else sequence).desc()))
    return docs.withColumn("__n", newest).where(F.col("__n") <= most).drop("__n")
