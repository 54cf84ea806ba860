"""Search over a collection (id, text, embedding, metadata): exact top-k, batches of queries, hybrid, filters, reranking.

Results are ordered by score and then id. Ranks are given before scores are clamped, as clamping makes ties at 0.
Scoring reads ids and vectors only; texts are joined to the few results at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.functions import jsons, text, vectors
from lodestar.functions.arrays import matrix

#: From ids, vectors and a query: the ids and dots that are kept.
Pick = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Queries that one broadcast matrix holds at most; more go in blocks.
MOST_QUERIES = 2048
#: Documents in a block, where queries go in blocks.
DOC_BLOCK = 8192


def check_dim(query: Sequence[float], dim: int | None) -> None:
    if dim is not None and len(query) != dim:
        raise S.DimMismatch(dim, len(query))


def exact_topk(docs: DataFrame, query: Sequence[float], k: int, key: str = "id", dim: int | None = None, clamp: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """rank, key, score, distance of the k nearest: a projection and a top-k, without a shuffle of the collection."""
    check_dim(query, dim)
    scored = docs.select(F.col(key), vectors.dot(F.col("embedding"), vectors.literal(query)).alias("dot")).where("dot IS NOT NULL")
    top = scored.orderBy(F.desc("dot"), F.col(key)).limit(max(0, k))
    rank = F.row_number().over(Window.orderBy(F.desc("dot"), F.col(key)))  # over k rows
    score = vectors.clamp(F.col("dot"), *clamp)
    return top.select(rank.cast("int").alias("rank"), key, score.alias("score"), (1.0 - score).alias("distance"))


def _sequential(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products summed component by component, as the column expression sums them."""
    return np.cumsum(x * q, axis=1)[:, -1]


def _best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and dots of the k best of each block: a matrix product finds candidates, exact sums rank them."""
    rough = x @ q
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= edge - 1e-9)
    else:
        near = np.arange(len(rough))
    dots = _sequential(x[near], q)
    order = np.lexsort((ids[near], -dots))[:k]
    return ids[near][order], dots[order]


def _reaching(ids: np.ndarray, x: np.ndarray, q: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and dots of all rows whose exact sum reaches a threshold; a matrix product leaves few to sum."""
    near = np.flatnonzero(x @ q >= at_least - 1e-9)
    dots = _sequential(x[near], q) if len(near) else np.zeros(0)
    good = dots >= at_least
    return ids[near][good], dots[good]


def _met(docs: DataFrame, queries: DataFrame, pick: Pick, doc_key: str, query_key: str, exclude_self: bool) -> DataFrame:
    """q, d, dot: what pick() chooses of each block of documents for each query.

    Up to MOST_QUERIES queries are one broadcast matrix, and documents stay where they are. More are packed in blocks that
    meet blocks of documents by an equi-join on block numbers; no task holds more than a block of each.
    """
    spark = docs.sparkSession
    some = queries.select(F.col(query_key).cast("long").alias("q"), vectors.doubles(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    few = some.limit(MOST_QUERIES + 1).collect()
    base = docs.select(F.col(doc_key).cast("long").alias("d"), vectors.doubles(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    out = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("dot", pa.float64())])

    def found(q_ids: list, q: list, ids: np.ndarray, column: pa.Array) -> Iterator[pa.RecordBatch]:
        for dim in {len(v) for v in q}:
            good, x = matrix(column, dim)
            own = ids[good]
            rows: tuple[list, list, list] = ([], [], [])
            for q_id, v in zip(q_ids, q):
                if len(v) == dim and len(own):
                    keep = own != q_id if exclude_self else slice(None)
                    best, dots = pick(own[keep], x[keep], np.array(v, np.float64))
                    for c, values in zip(rows, ([q_id] * len(best), best.tolist(), dots.tolist())):
                        c.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, out.types)], schema=out)

    if len(few) <= MOST_QUERIES:
        shared = spark.sparkContext.broadcast(([r["q"] for r in few], [r["v"] for r in few]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from found(*shared.value, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))

        return base.mapInArrow(run, "q long, d long, dot double")
    q_blocks = max(1, -(-queries.count() // MOST_QUERIES))
    d_blocks = max(1, -(-docs.count() // DOC_BLOCK))
    packed_q = some.groupBy(F.pmod(F.xxhash64("q"), F.lit(q_blocks)).alias("qb")).agg(F.collect_list(F.struct("q", "v")).alias("qs"))
    packed_d = base.groupBy(F.pmod(F.xxhash64("d"), F.lit(d_blocks)).alias("db")).agg(F.collect_list(F.struct("d", "v")).alias("ds"))
    met = packed_q.withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d_blocks - 1).cast("long")))).join(packed_d, "db").select("qs", "ds")

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, ds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from found([r["q"] for r in qs], [r["v"] for r in qs], np.array([r["d"] for r in ds]), pa.array([r["v"] for r in ds]))

    return met.mapInArrow(run_blocks, "q long, d long, dot double")


def batch_knn(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "id", query_key: str = "query_id", exclude_self: bool = False) -> DataFrame:
    """query_key, rank, doc_key, dot of the k nearest documents of each query (query_key, embedding).

    Each partition or block keeps the k best of every query, and a window merges them, so what is shuffled is partitions x
    queries x k rows.
    """
    scored = _met(docs, queries, partial(_best, k=k), doc_key, query_key, exclude_self)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dot"), "d"))
    top = scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(query_key), "rank", F.col("d").cast(dict(docs.dtypes)[doc_key]).alias(doc_key), "dot")


def similarity_search(docs: DataFrame, queries: DataFrame, at_least: float, doc_key: str = "id", query_key: str = "query_id") -> DataFrame:
    """All documents whose cosine with a query of a stated set reaches a threshold, but the query's own row."""
    scored = _met(docs, queries, partial(_reaching, at_least=at_least), doc_key, query_key, True)
    return scored.select(F.col("q").alias(query_key), F.col("d").cast(dict(docs.dtypes)[doc_key]).alias(doc_key), vectors.clamp(F.col("dot"), -1.0, 1.0).alias("score"))


def min_score(results: DataFrame, at_least: float) -> DataFrame:
    return results.where(F.col("score") >= at_least)


def metadata_filter(docs: DataFrame, wanted: Any) -> DataFrame:
    return docs.where(jsons.matches(F.col("metadata"), wanted))


def with_documents(results: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """The results' texts and metadata. Results are few (a limit's rows), so their ids go to the scan of the documents,
    which reads texts of those row groups only."""
    rows = results.collect()
    found = docs.where(F.col(key).isin([r[key] for r in rows])).select(key, "text", "metadata")
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(rows, results.schema)), key)


def ranked(results: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """Order by score and id, cut to limit, and number the rows anew."""
    out = results.orderBy(F.desc("score"), F.col(key))
    out = out if limit is None else out.limit(limit)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.col(key))).cast("int"))


def search(docs: DataFrame, query: Sequence[float], limit: int = 10, at_least: float | None = None, wanted: Any = None, filter_mode: str = "post", truncate: bool = True, key: str = "id") -> DataFrame:
    """The request pipeline: clamp the limit, fetch more where a filter follows, filter, cut.

    filter_mode 'post' filters what a plain search finds, 'pre' finds the best of what passes. Without truncate, a
    filtered search may return up to five times the limit.
    """
    limit = S.clamp_limit(limit)
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is 'pre' or 'post'")
    if filter_mode == "pre":
        found = with_documents(exact_topk(metadata_filter(docs, wanted), query, limit, key), docs, key)
    else:
        fetch = limit * S.OVER_FETCH_FILTER if wanted is not None or at_least is not None else limit
        found = metadata_filter(with_documents(exact_topk(docs, query, fetch, key), docs, key), wanted)
    if at_least is not None:
        found = min_score(found, at_least)
    found = found.select(key, "text", "metadata", "score", "distance", "rank")
    return _cut(found, key, limit if truncate else None)


def _cut(found: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Keep the order of ranks, number anew, cut."""
    order = Window.orderBy("rank", F.col(key))
    out = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def hybrid(docs: DataFrame, query_text: str, query: Sequence[float], limit: int, key: str = "id", fold_query: bool = False) -> DataFrame:
    """The best 3 x limit by vector, rescored 0.7 vector + 0.3 keywords; nothing for a blank query."""
    if not query_text.strip():
        return docs.limit(0).select(key, "text", "metadata", F.lit(0.0).alias("score"), F.lit(1.0).alias("distance"), F.lit(0).alias("rank"))
    near = with_documents(exact_topk(docs, query, limit * S.OVER_FETCH_HYBRID, key), docs, key)
    keywords = text.keyword_score(F.col("text"), query_text, fold_query)
    score = vectors.clamp(S.HYBRID_VECTOR * F.col("score") + S.HYBRID_KEYWORDS * keywords, 0.0, 1.0)
    found = near.withColumn("score", score).withColumn("distance", 1.0 - F.col("score"))
    return ranked(found.select(key, "text", "metadata", "score", "distance"), key, limit)


def rerank_length(results: DataFrame, key: str = "id") -> DataFrame:
    """Longer texts first, a little; distance stays what it was."""
    return ranked(results.withColumn("score", text.length_boost(F.col("score"), F.col("text"))), key)


def retrieve(docs: DataFrame, query_text: str, query: Sequence[float], limit: int = 10, use_hybrid: bool = False, key: str = "id") -> DataFrame:
    if use_hybrid:
        return hybrid(docs, query_text, query, limit, key)
    return with_documents(exact_topk(docs, query, limit, key), docs, key).select(key, "text", "metadata", "score", "distance", "rank")


def routed(docs: DataFrame, query_text: str, query: Sequence[float], limit: int, key: str = "id") -> DataFrame:
    """Hybrid for more than three words, else by vector."""
    return retrieve(docs, query_text, query, limit, len(query_text.split()) > 3, key)


def brute_top_k(docs: DataFrame, query: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """Exact ground truth with scores from -1 to 1."""
    return exact_topk(docs, query, k, key, clamp=(-1.0, 1.0))


def formatted(results: DataFrame, width: int = 80, key: str = "id") -> DataFrame:
    """One printable line a result."""
    line: Column = F.format_string("%d. [%.4f] %s %s", F.col("rank"), F.col("score"), F.col(key).cast("string"), text.shortened(F.col("text"), width))
    return results.select("rank", line.alias("line"))
