"""Recall against exact search, and deterministic synthetic vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.search import batch_knn

# The generator of synthetic vectors.
MULTIPLIER, INCREMENT, SEED = 6364136223846793005, 1, 42


def recall(found: DataFrame, truth: DataFrame, k: int, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """One row: the mean over queries of the share of the true k that was found; 1 without queries or for k = 0.

    A query of which nothing was found counts 0.
    """
    a = found.groupBy(query_key).agg(F.collect_set(key).alias("a"))
    b = truth.groupBy(query_key).agg(F.collect_set(key).alias("b"))
    hits = F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)) / F.lit(float(max(k, 1)))
    mean = b.join(a, query_key, "left").agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(hits)).alias("recall"), F.count(F.lit(1)).alias("n_queries"))
    return mean.select(F.coalesce("recall", F.lit(1.0)).alias("recall") if k else F.lit(1.0).alias("recall"), "n_queries")


def compute_recall(docs: DataFrame, search: Callable[[DataFrame, DataFrame, int], DataFrame], queries: DataFrame, k: int, key: str = "id") -> DataFrame:
    """recall() of any search (docs, queries, k -> query_id, key) against the exact one."""
    return recall(search(docs, queries, k), batch_knn(docs, queries, k, key), k, key=key)


def jump(state: int, steps: int, multiplier: int = MULTIPLIER, increment: int = INCREMENT) -> int:
    """The generator's state after so many steps, by squaring."""
    a, c, wrap = multiplier, increment, (1 << 64) - 1
    while steps:
        if steps & 1:
            state = (state * a + c) & wrap
        c, a = (c * a + c) & wrap, a * a & wrap
        steps >>= 1
    return state


def synthetic(spark: SparkSession, n: int, dim: int = 384, seed: int = SEED) -> DataFrame:
    """idx, text, embedding, metadata of n unit vectors; each row jumps to its own state, so rows need no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sums = [1], [0]
        for _ in range(dim):
            powers.append(powers[-1] * MULTIPLIER & (1 << 64) - 1)
            sums.append((sums[-1] * MULTIPLIER + INCREMENT) & (1 << 64) - 1)
        a, c = np.array(powers[1:], np.uint64), np.array(sums[1:], np.uint64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for i in ids:
                state = np.uint64(jump(seed, i * dim))
                v = ((state * a + c) >> np.uint64(33)).astype(np.float32) / np.float32((1 << 31) - 1) * np.float32(2) - np.float32(1)
                size = np.sqrt((v.astype(np.float64) ** 2).sum())
                rows.append((v / size if size > 1e-8 else v).astype(np.float32))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column], names=["idx", "embedding"])

    made = spark.range(n).select(F.col("id").alias("idx")).mapInArrow(run, "idx long, embedding array<float>")
    return made.select("idx", F.concat(F.lit("synthetic-doc-"), F.col("idx")).alias("text"), "embedding", F.format_string('{"idx":%d,"type":"synthetic"}', "idx").alias("metadata"))


def load_or_generate(spark: SparkSession, n: int) -> DataFrame:
    return synthetic(spark, n)
