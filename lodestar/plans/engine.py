"""The engine as one object: named collections in a store, with an embedder; every method returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.operators import collections as C
from lodestar.operators import embed as E
from lodestar.operators import ivf, quantization, rag
from lodestar.operators import search as Q
from lodestar.sources import store


@dataclass
class Engine:
    spark: SparkSession
    path: str
    config: S.EngineConfig = field(default_factory=S.EngineConfig)
    embedder: E.Embedder | None = None

    def docs(self, collection: str | None = None) -> DataFrame:
        rows = store.open_store(self.spark, f"{self.path}/docs")
        return rows if collection is None else C.in_collection(rows, collection)

    def embed_query(self, query: str) -> list[float]:
        if not query.strip():
            raise S.EmptyText
        if self.embedder is not None:
            return [float(x) for x in E.embed_one(self.embedder, query)]
        return [float(x) for x in E.hash_vector(query, self.config.dim)]

    def ingest(self, rows: DataFrame, strict: bool = True) -> None:
        """Rows of text and, optionally, id, metadata, collection, embedding (made where there is no such column)."""
        if "embedding" not in rows.columns:
            rows = E.embed(rows, self.embedder) if self.embedder else rows.withColumn("embedding", E.hash_embedding(F.col("text"), self.config.dim))
        (store.ingest_strict if strict else store.ingest)(rows, f"{self.path}/docs", self.config.dim)
        for r in self.docs().groupBy("collection").count().where(F.col("count") > self.config.max_docs).select("collection").collect():
            self.evict(r["collection"])

    def search(self, query: str | Sequence[float], limit: int = 10, collection: str = S.DEFAULT_COLLECTION, hybrid: bool = False, min_score: float | None = None, metadata_filter: Any = None, filter_mode: str = "post", truncate: bool = True) -> DataFrame:
        docs, limit = self.docs(collection), S.clamp_limit(limit)
        v = self.embed_query(query) if isinstance(query, str) else query
        Q.check_dim(v, self.config.dim)
        if not hybrid:
            return Q.search(docs, v, limit, min_score, metadata_filter, filter_mode, truncate)
        if not isinstance(query, str):
            raise ValueError("a hybrid search needs the query's text")
        fetch = limit * S.OVER_FETCH_FILTER if metadata_filter is not None or min_score is not None else limit
        found = Q.metadata_filter(Q.hybrid(docs, query, v, fetch), metadata_filter)
        found = found if min_score is None else Q.min_score(found, min_score)
        return Q._cut(found, "id", limit if truncate else None)

    def search_batch(self, queries: Sequence[str], limit: int = 10, collection: str = S.DEFAULT_COLLECTION) -> DataFrame:
        if any(not q.strip() for q in queries):
            raise S.EmptyText
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
        asked = E.embed(asked, self.embedder) if self.embedder else asked.withColumn("embedding", E.hash_embedding(F.col("text"), self.config.dim))
        # a number for each id, by hash: two ids share one by chance only (2**-64)
        docs = self.docs(collection).withColumn("n", F.xxhash64("id"))
        found = Q.batch_knn(docs, asked.select("query_id", "embedding"), S.clamp_limit(limit), "n")
        return found.join(docs.select("n", "id", "text", "metadata"), "n").select("query_id", "rank", "id", "text", "metadata", Q.vectors.search_score(F.col("dot")).alias("score"))

    def retrieve(self, query: str, limit: int = 10, collection: str = S.DEFAULT_COLLECTION, hybrid: bool = False) -> DataFrame:
        return Q.retrieve(self.docs(collection), query, self.embed_query(query), limit, hybrid)

    def chat_messages(self, messages: Sequence[tuple[str, str]], collection: str = S.DEFAULT_COLLECTION, preset: rag.Preset = rag.SERVER, top_k: int = rag.TOP_K) -> DataFrame:
        """One row of messages with the retrieved context in the system message; sending them on is the caller's."""
        if not messages:
            raise ValueError("messages cannot be empty")
        query = next((c for r, c in reversed(messages) if r == "user"), "")
        query = query.strip() if preset.trim_query else query
        chat = self.spark.createDataFrame([([{"role": r, "content": c} for r, c in messages],)], "messages array<struct<role:string,content:string>>")
        if not query.strip():
            return rag.augment(chat.withColumn("context", F.lit(None).cast("string")), preset).select("messages")
        docs, v = self.docs(collection), self.embed_query(query)
        found = Q.rerank_length(Q.routed(docs, query, v, top_k)) if preset is rag.SERVER else Q.retrieve(docs, query, v, top_k)
        return rag.augment(chat.join(F.broadcast(rag.context(found, preset).select("context")), F.lit(True), "left"), preset).select("messages")

    def get(self, key: str) -> DataFrame:
        return store.get(self.docs(), key)

    def stats(self, collection: str | None = None) -> DataFrame:
        return C.stats(self.docs(collection), self.config.dim, self.config.index)

    def list_collections(self) -> DataFrame:
        return C.list_collections(self.docs())

    def delete(self, collection: str) -> None:
        """Drop a collection's partition, by rewriting nothing else."""
        rest = self.docs().limit(0)
        rest.drop("collection").write.mode("overwrite").partitionBy("epoch").parquet(f"{self.path}/docs/collection={collection}")

    def retain(self, collection: str = S.DEFAULT_COLLECTION) -> DataFrame:
        return C.retain(self.docs(collection), self.config.max_docs, "ingest_seq")

    def build_index(self, collection: str = S.DEFAULT_COLLECTION) -> ivf.Index:
        return ivf.build(self.docs(collection), self.config.index.n_lists)

    def save_index(self, collection: str = S.DEFAULT_COLLECTION) -> None:
        """Store the index with the version of the collection, so that it is used until the collection changes."""
        version = store.version(self.docs(collection))
        ivf.save(self.build_index(collection), f"{self.path}/index/{collection}", version)

    def train_pq(self, collection: str = S.DEFAULT_COLLECTION, m: int = quantization.DEFAULT_M, k: int = quantization.DEFAULT_K) -> quantization.Codebook:
        """Train a codebook on a sample of the collection, and store it as the engine's."""
        book = quantization.train(quantization.sample(self.docs(collection), "id"), m, k)
        if book.trained:
            book.table(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/codebook")
        return book

    def codebook(self) -> quantization.Codebook:
        """The stored codebook; before training, the default one for 384 components, and none (scalar codes) for others."""
        try:
            return quantization.Codebook.of(self.spark.read.parquet(f"{self.path}/codebook"))
        except AnalysisException:
            return quantization.default_codebook() if self.config.dim == quantization.DEFAULT_DIM else quantization.Codebook(None)

    def evict(self, collection: str = S.DEFAULT_COLLECTION) -> int:
        """Keep the newest max_docs rows of a collection, by ingest sequence and id; how many went."""
        docs = self.docs(collection)
        over = docs.count() - self.config.max_docs
        if over <= 0:
            return 0
        # the oldest rows are the few: a top-k of them, without a sort of the collection
        last = docs.select("ingest_seq", "id").orderBy("ingest_seq", "id").limit(over).agg(F.max(F.struct("ingest_seq", "id")).alias("m")).first()["m"]
        kept = docs.where(F.struct("ingest_seq", "id") > F.struct(F.lit(last["ingest_seq"]).cast("long"), F.lit(last["id"])))
        aside = f"{self.path}/evicting/{collection}"
        kept.drop("collection").write.mode("overwrite").partitionBy("epoch").parquet(aside)
        self.spark.read.schema(kept.drop("collection").schema).parquet(aside).write.mode("overwrite").partitionBy("epoch").parquet(f"{self.path}/docs/collection={collection}")
        return over

    def search_approximate(self, query: str | Sequence[float], limit: int = 10, collection: str = S.DEFAULT_COLLECTION, ef: int | None = None) -> DataFrame:
        """By the stored index if it is of the collection as it is now, else exactly."""
        v = self.embed_query(query) if isinstance(query, str) else query
        Q.check_dim(v, self.config.dim)
        index = ivf.load(self.spark, f"{self.path}/index/{collection}", store.version(self.docs(collection)))
        if index is None:
            return Q.exact_topk(self.docs(collection), v, limit)
        return index.search(v, limit, self.config.index.n_probe(ef))
