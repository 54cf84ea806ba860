"""A query for each operator, by name. Scores are rounded for comparison; ranks are of unrounded ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import jsons, text, vectors
from lodestar.operators import collections as C
from lodestar.operators import embed, evaluate, ivf, metrics, quantization, rag
from lodestar.operators import search as S
from lodestar.plans.fixtures import collection, embeddings, query_vector, query_vectors, table
from lodestar.schema import IndexConfig
from lodestar.sources import store
from lodestar.streaming import ingest as streaming
from lodestar.streaming import ratelimit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORDS = "the of and onthe"
LIMIT, THRESHOLD, MIN_SCORE = 10, 0.3, 0.15
WANTED = {"lang": "en"}
SHARDS, REPLICAS = 4, 2
PQ_M, PQ_K = 8, 16


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh folder in shared storage; a temporary one where none is set, in local mode only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestar-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def scored(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, r6("score").alias("score"), r6("distance").alias("distance"))


# ---------------------------------------------------------------- search


@query
def vec_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.exact_topk(embeddings(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, "vec_id", dim=None)
    return scored(found, "rank", "vec_id")


@query
def vec_brute_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.brute_top_k(embeddings(spark, sf_dir), [-x for x in query_vector(spark, sf_dir)], LIMIT, "vec_id")
    return scored(found, "rank", "vec_id")


@query
def vec_batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.batch_knn(embeddings(spark, sf_dir), query_vectors(spark, sf_dir), LIMIT, "vec_id")
    return found.select("query_id", "rank", "vec_id", r6(vectors.search_score(F.col("dot"))).alias("score"))


@query
def vec_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.exact_topk(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 5 * LIMIT, "vec_id")
    return scored(S.min_score(found, MIN_SCORE), "rank", "vec_id")


@query
def vec_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.similarity_search(embeddings(spark, sf_dir), query_vectors(spark, sf_dir), THRESHOLD, "vec_id")
    return found.select("query_id", "vec_id", r6("score").alias("score"))


@query
def search_metadata_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(collection(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, wanted=WANTED, truncate=False)
    return scored(found, "rank", "id", "metadata")


@query
def search_metadata_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(collection(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, wanted=WANTED, filter_mode="pre")
    return scored(found, "rank", "id", "metadata")


@query
def search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(collection(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, at_least=MIN_SCORE, wanted=WANTED)
    return scored(found, "rank", "id", "text")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.hybrid(collection(spark, sf_dir), WORDS, query_vector(spark, sf_dir), LIMIT), "rank", "id")


@query
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(S.routed(collection(spark, sf_dir), "the of and", query_vector(spark, sf_dir), 5), "rank", "id", "text")


@query
def rerank_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = collection(spark, sf_dir)
    found = S.with_documents(S.exact_topk(docs, query_vector(spark, sf_dir), LIMIT), docs)
    return scored(S.rerank_length(found), "rank", "id")


@query
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = collection(spark, sf_dir)
    return S.formatted(S.with_documents(S.exact_topk(docs, query_vector(spark, sf_dir), LIMIT), docs))


@query
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(text.keyword_score(F.col("text"), WORDS)).alias("score"))


@query
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = collection(spark, sf_dir).select("id", F.explode(jsons.flattened(F.col("metadata"))).alias("key", "value"))
    return flat.select("id", "key", "value")


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base addresses without slashes at their end, and the first of several addresses."""
    pages = table(spark, sf_dir, "pages")
    base = text.without_end(F.concat("url", F.lit("//")), "/")
    return pages.select("page_id", base.alias("base"), text.first_of(F.concat(F.lit(" "), F.col("url"), F.lit(" , proxy, other"))).alias("first"))


# ---------------------------------------------------------------- vectors


@query
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return embeddings(spark, sf_dir).select("vec_id", r6(vectors.norm(v)).alias("norm"), F.size(v).cast("long").alias("dim"))


@query
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embeddings(spark, sf_dir).select("vec_id", F.posexplode(vectors.normalize(F.transform("embedding", lambda x: x.cast("double") * 3))).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"))


@query
def vec_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embed.preview(embeddings(spark, sf_dir), "vec_id")
    return p.select("vec_id", "dim", r6("norm").alias("norm"), *[r6(F.element_at("head", i + 1)).alias(f"v{i}") for i in range(8)])


@query
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: no SQL has this hash."""
    docs = table(spark, sf_dir, "documents")
    made = embed.indexed_embeddings(docs, 64, "doc_id")
    return made.select("doc_id", "n_tokens", r6(vectors.norm(F.col("embedding"))).alias("norm"))


# ---------------------------------------------------------------- quantization


def _codes(column: str) -> Column:
    return F.array_join(F.transform(column, lambda c: c.cast("string")), ",")


@query
def scalar_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", vectors.quantize(F.col("embedding")).alias("c")).select("vec_id", _codes("c").alias("codes"))


@query
def scalar_dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = vectors.dequantize(vectors.quantize(F.col("embedding")))
    v = embeddings(spark, sf_dir).select("vec_id", F.posexplode(back).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return embeddings(spark, sf_dir).select("vec_id", "label", vectors.rms_error(v, vectors.dequantize(vectors.quantize(v))).alias("error"))


@query
def quant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("vec_id", r6("error").alias("error"))


@query
def quant_error_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.histogram(_errors(spark, sf_dir), "error", metrics.QUANT_BOUNDS, "label")
    return h.select("label", "le", "count", r6("sum").alias("sum"), "total")


def _initial(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return quantization.initial(quantization.sample(embeddings(spark, sf_dir), "vec_id"), PQ_K)


def _centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "code int, centroid array<double>")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))


@query
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = quantization.nearest(_points(spark, sf_dir), _centroid_table(spark, _initial(spark, sf_dir)))
    return near.select("vec_id", "code")


@query
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    stepped = quantization.lloyd_step(_points(spark, sf_dir), _centroid_table(spark, _initial(spark, sf_dir)))
    return stepped.select("code", F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"), "n")


def _book(spark: SparkSession, sf_dir: str) -> quantization.Codebook:
    return quantization.train(quantization.sample(embeddings(spark, sf_dir), "vec_id"), PQ_M, PQ_K)


@query
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = quantization.encode(embeddings(spark, sf_dir), _book(spark, sf_dir), "vec_id")
    return codes.select("vec_id", _codes("codes").alias("codes"))


@query
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    back = quantization.decode(quantization.encode(embeddings(spark, sf_dir), book, "vec_id"), book, "vec_id")
    v = back.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"))


@query
def pq_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantization.pq_error(embeddings(spark, sf_dir), _book(spark, sf_dir), "vec_id").select("vec_id", r6("error").alias("error"))


@query
def pq_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codebook after all iterations."""
    t = _book(spark, sf_dir).table(spark)
    return t.select("sub", "code", F.posexplode("centroid").alias("pos", "x")).select("sub", "code", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"))


@query
def pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    codes = quantization.encode(embeddings(spark, sf_dir), book, "vec_id")
    found = quantization.search_codes(codes, book, query_vector(spark, sf_dir), LIMIT, "vec_id")
    return found.select("rank", "vec_id", r6("score").alias("score"))


@query
def scalar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quantization.Codebook(None)
    codes = quantization.encode(embeddings(spark, sf_dir), book, "vec_id")
    found = quantization.search_codes(codes, book, query_vector(spark, sf_dir), LIMIT, "vec_id")
    return found.select("rank", "vec_id", r6("score").alias("score"))


# ---------------------------------------------------------------- approximate search, recall


@query
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists are visited, so the result is the exact one."""
    index = ivf.build(embeddings(spark, sf_dir), 16, "vec_id")
    return scored(index.search(query_vector(spark, sf_dir), LIMIT, 16), "rank", "vec_id")


@query
def ivf_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists for a batch of queries."""
    found = ivf.batch_search(ivf.build(embeddings(spark, sf_dir), 16, "vec_id"), query_vectors(spark, sf_dir), LIMIT, 16)
    return found.select("query_id", "rank", "vec_id", r6(vectors.search_score(F.col("dot"))).alias("score"))


@query
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index as it is by default finds nine tenths of the true neighbours."""
    docs, asked, index = embeddings(spark, sf_dir), query_vectors(spark, sf_dir), IndexConfig()
    found = ivf.batch_search(ivf.build(docs, index.n_lists, "vec_id"), asked, LIMIT, index.n_probe())
    recall = evaluate.recall(found, S.batch_knn(docs, asked, LIMIT, "vec_id"), LIMIT, key="vec_id")
    return recall.select((F.col("recall") >= 0.9).alias("reached"), "n_queries")


@query
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = embeddings(spark, sf_dir), query_vectors(spark, sf_dir)
    coded = docs.withColumn("embedding", vectors.dequantize(vectors.quantize(F.col("embedding"))))
    found, truth = S.batch_knn(coded, asked, LIMIT, "vec_id"), S.batch_knn(docs, asked, LIMIT, "vec_id")
    return evaluate.recall(found, truth, LIMIT, key="vec_id").select(r6("recall").alias("recall"), "n_queries")


@query
def synthetic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(vectors.doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    made = evaluate.synthetic(spark, 200, 32)
    return made.select("idx", "text", "metadata", r6(F.element_at("embedding", 32).cast("double")).alias("last"), r6(total).alias("total"))


# ---------------------------------------------------------------- collections, shards


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("collection", F.col("lang"))


@query
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stats(_by_lang(spark, sf_dir), 64)


@query
def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_collections(_by_lang(spark, sf_dir))


@query
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get(table(spark, sf_dir, "documents"), 7, "doc_id").select("doc_id", "text")


@query
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).select("id", "text", "metadata", "collection")


@query
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("collection-"), "source").alias("collection")).distinct()
    return C.routed(names, SHARDS)


@query
def replica_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.placed(_by_lang(spark, sf_dir).select("doc_id", "collection"), SHARDS, REPLICAS)


@query
def shard_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_all(_by_lang(spark, sf_dir), SHARDS, REPLICAS)


@query
def shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.shard_search(collection(spark, sf_dir), "fr", query_vector(spark, sf_dir), LIMIT, SHARDS)
    return scored(found, "rank", "id")


@query
def cross_shard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.routed(collection(spark, sf_dir), SHARDS)
    return scored(C.cross_shard_topk(docs, query_vector(spark, sf_dir), LIMIT), "rank", "id", "shard")


@query
def retention_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retain(_by_lang(spark, sf_dir), 50, "doc_id").select("collection", "doc_id")


# ---------------------------------------------------------------- ingest


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what vectors there are; those without fail validation."""
    docs, v = table(spark, sf_dir, "documents"), embeddings(spark, sf_dir)
    return docs.join(v, docs.doc_id == v.vec_id, "left").select(F.col("doc_id").cast("string").alias("id"), "text", "embedding", F.to_json(F.struct("source")).alias("metadata"), F.col("lang").alias("collection"), F.col("doc_id").alias("ingest_seq"))


@query
def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = store.validated(_raw(spark, sf_dir), 64)
    return good.select("id", F.lit("ok").alias("verdict")).unionByName(bad.select("id", F.col("reason").alias("verdict")))


@query
def ingest_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a store, and read again."""
    path = work_path(spark, "store")
    store.ingest(_raw(spark, sf_dir), path, 64)
    return store.open_store(spark, path).select("id", "text", "metadata", "collection", F.size("codes").cast("long").alias("n_codes"))


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a file stream into a store."""
    path = work_path(spark, "stream")
    kinds = table(spark, sf_dir, "documents").schema
    single = not spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet").getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")).isDirectory()
    reader = spark.readStream.schema(kinds)
    rows = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/documents.parquet")
    docs = rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.array(F.lit(0.0).cast("float")).alias("embedding"), F.col("lang").alias("collection"), F.col("doc_id").alias("ingest_seq"))
    streaming.stream_ingest(docs, f"{path}/docs", f"{path}/checkpoint", 1).awaitTermination()
    return store.open_store(spark, f"{path}/docs").select("id", "text", "collection")


# ---------------------------------------------------------------- metrics


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a query log: type, hybrid, seconds."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("collection"), (F.col("user_id") % 2 == 0).cast("string").alias("hybrid"), (F.col("value") / 1000).alias("seconds"))


@query
def ingest_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counter(_by_lang(spark, sf_dir), "collection")


@query
def search_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counter(_log(spark, sf_dir), "collection", "hybrid")


@query
def docs_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gauge(_log(spark, sf_dir), "event_id", "ts", "collection")


@query
def index_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.index_gauges(C.stats(_by_lang(spark, sf_dir), 64))


@query
def latency_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.histogram(_log(spark, sf_dir), "seconds", metrics.LATENCY_BOUNDS, "collection", "hybrid")
    return h.select("collection", "hybrid", "le", "count", F.round("sum", 4).alias("sum"), "total")


@query
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = metrics.counter(_by_lang(spark, sf_dir), "collection")
    lines = {name: metrics.sample_lines(docs, name, ["collection"]) for name in ("vector_ingest_total", "vector_docs_total")}
    found = metrics.histogram(_errors(spark, sf_dir), "error", metrics.QUANT_BOUNDS, "label").withColumn("sum", F.round("sum", 3))
    return metrics.exposition(lines | {"quant_error": metrics.histogram_lines(found, "quant_error", ["label"])})


@query
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.token_usage(table(spark, sf_dir, "documents"))


@query
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ratelimit.batch_limit(e.withColumn("s", F.expr("us div 60000000")), "user_id", "s", "event_id", most=3)


# ---------------------------------------------------------------- prompts


@query
def rag_last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.last_user(table(spark, sf_dir, "conversations"))


@query
def rag_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.route(rag.last_user(table(spark, sf_dir, "conversations"))).select("conv_id", "route")


def _context(spark: SparkSession, sf_dir: str, preset: rag.Preset) -> DataFrame:
    docs = collection(spark, sf_dir)
    found = S.with_documents(S.exact_topk(docs, query_vector(spark, sf_dir), rag.TOP_K), docs)
    return rag.context(S.rerank_length(found) if preset is rag.SERVER else found, preset)


@query
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _context(spark, sf_dir, rag.SERVER)
    return c.select("context", F.array_join("citations", "\n").alias("citations"))


def _messages(spark: SparkSession, sf_dir: str, preset: rag.Preset) -> DataFrame:
    chats = rag.messages(table(spark, sf_dir, "conversations"))
    out = rag.augment(chats.join(F.broadcast(_context(spark, sf_dir, preset).select("context")), F.lit(True)), preset)  # one row of context
    return out.select("conv_id", F.posexplode("messages").alias("n", "m")).select("conv_id", F.col("n").cast("long").alias("n"), "m.role", "m.content")


@query
def rag_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir, rag.SERVER)


@query
def rag_messages_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir, rag.ADAPTER)


@query
def rag_messages_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir, rag.EXAMPLE)
