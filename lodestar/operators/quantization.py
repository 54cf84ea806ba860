"""Product quantization: deterministic Lloyd k-means, encoding and decoding, error, search over codes.

Training works on a sample of bounded size (``most`` vectors with the smallest hashes of their keys), so its arrays stay
small; encoding and decoding run over every row. A codebook is a table (sub, code, centroid) of at most m x 256 rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.functions.arrays import lists, matrix

ITERATIONS = 12
SHIFT = 1e-6
SAMPLE = 1024


@dataclass(frozen=True)
class Codebook:
    """centroids[m][k][sub_dim]; without any it is untrained, and codes are scalar ones."""

    centroids: np.ndarray | None

    @property
    def trained(self) -> bool:
        return self.centroids is not None

    @property
    def dim(self) -> int:
        return 0 if self.centroids is None else self.centroids.shape[0] * self.centroids.shape[2]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [] if self.centroids is None else [(s, c, [float(x) for x in v]) for s, part in enumerate(self.centroids) for c, v in enumerate(part)]
        return spark.createDataFrame(rows, "sub int, code int, centroid array<double>")

    @staticmethod
    def of(table: DataFrame) -> Codebook:
        rows = table.orderBy("sub", "code").collect()
        if not rows:
            return Codebook(None)
        m = rows[-1]["sub"] + 1
        return Codebook(np.array([r["centroid"] for r in rows]).reshape(m, len(rows) // m, -1))


def initial(samples: np.ndarray, k: int) -> np.ndarray:
    """Every seventh sample, round and round."""
    return samples[(np.arange(min(k, len(samples))) * 7) % len(samples)].copy()


def assign(samples: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid, the lowest among equals."""
    squares = np.zeros((len(samples), len(centroids)))
    for j in range(samples.shape[1]):  # component by component, as column expressions sum
        squares += (samples[:, j, None] - centroids[None, :, j]) ** 2
    return squares.argmin(axis=1)


def lloyd(samples: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """k-means from initial(): a centroid moves if it shifts by more than SHIFT, an empty cluster keeps its own."""
    centroids = initial(samples, k)
    for _ in range(iterations):
        near = assign(samples, centroids)
        moved = False
        for c in np.unique(near):
            mean = samples[near == c].mean(axis=0)
            if np.sqrt(((mean - centroids[c]) ** 2).sum()) > SHIFT:
                centroids[c], moved = mean, True
        if not moved:
            break
    return centroids


def train(samples: np.ndarray, m: int = 8, k: int = 256, iterations: int = ITERATIONS) -> Codebook:
    """A codebook of m subspaces, or of one if m doesn't divide the dimension; untrained without samples."""
    if m < 1:
        raise ValueError("m is 1 at least")
    if not 1 <= k <= 256:
        raise ValueError("k is 1 to 256, as a code is a byte")
    samples = np.asarray(samples, np.float64)
    if not len(samples):
        return Codebook(None)
    m = m if samples.shape[1] % m == 0 else 1
    return Codebook(np.array([lloyd(part, k, iterations) for part in np.split(samples, m, axis=1)]))


# The generator of the samples that the default codebook is trained on.
DEFAULT_SEED, MULTIPLIER, INCREMENT = 0x1234567890ABCDEF, 6364136223846793005, 1442695040888963407
DEFAULT_DIM, DEFAULT_M, DEFAULT_K = 384, 8, 256


def generated(n: int = SAMPLE, dim: int = DEFAULT_DIM, seed: int = DEFAULT_SEED) -> np.ndarray:
    """n unit vectors from a linear congruential generator, whose upper 32 bits are components from -1 to 1."""
    state, wrap = seed, (1 << 64) - 1
    tops = np.empty(n * dim)
    for i in range(n * dim):
        state = (state * MULTIPLIER + INCREMENT) & wrap
        tops[i] = state >> 32
    v = (tops / ((1 << 32) - 1) * 2 - 1).reshape(n, dim)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


@functools.cache
def default_codebook() -> Codebook:
    """The codebook for 384 components before anything is trained: 8 subspaces of 256 centroids, from generated vectors."""
    return train(generated(), DEFAULT_M, DEFAULT_K)


def sample(docs: DataFrame, key: str, most: int = SAMPLE) -> np.ndarray:
    """The vectors with the smallest hashes of their keys, most at most: a sample of all rows, and the same one always."""
    rows = docs.where("embedding IS NOT NULL").select(key, "embedding").orderBy(F.md5(F.col(key).cast("string")), key).limit(most).collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def lloyd_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """One distributed step: points (key, v) to the nearest of centroids (code, centroid): code, pos, mean, n."""
    near = nearest(points, centroids)
    at = near.select("code", F.posexplode("v").alias("pos", "x"))
    return at.groupBy("code", "pos").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points with code: the nearest centroid, the lowest code among equals. There are 256 centroids at most."""
    table = centroids.orderBy("code").limit(257).collect()
    if len(table) > 256:
        raise ValueError("there are more than 256 centroids")
    options = F.array(*[F.struct(vectors.squared_distance(F.col("v"), vectors.literal(r["centroid"])).alias("d"), F.lit(r["code"]).alias("code")) for r in table])
    return points.withColumn("code", F.array_min(options)["code"])


def encode(docs: DataFrame, book: Codebook, key: str = "id") -> DataFrame:
    """key and codes (array of short): by subspace, or scalar codes where the book is untrained or the length differs."""
    if not book.trained:
        return docs.select(key, vectors.quantize(F.col("embedding")).alias("codes"))
    shared = docs.sparkSession.sparkContext.broadcast(book.centroids)  # at most 256 centroids a subspace
    dim, kind = book.dim, dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            good, x = matrix(batch.column(1), dim)
            near = np.stack([assign(part, centroids[s]) for s, part in enumerate(np.split(x, len(centroids), axis=1))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(near.astype(np.int16), good, pa.int16()), batch.column(2)], names=["key", "codes", "scalar"])

    fits = F.size("embedding") == dim
    scalar = F.when(~fits, vectors.quantize(F.col("embedding")))
    out = docs.select(F.col(key).alias("key"), "embedding", scalar.alias("scalar")).mapInArrow(run, f"key {kind}, codes array<smallint>, scalar array<smallint>")
    return out.select(F.col("key").alias(key), F.coalesce("codes", "scalar").alias("codes"))


def decode(codes: DataFrame, book: Codebook, key: str = "id") -> DataFrame:
    """key and embedding. A code that the book doesn't have is skipped; codes of another length are scalar ones."""
    if not book.trained:
        return codes.select(key, vectors.dequantize(F.col("codes")).alias("embedding"))
    m = len(book.centroids)
    table = vectors.literal(book.centroids)
    parts = F.transform(F.col("codes"), lambda c, s: F.coalesce(F.try_element_at(F.element_at(table, s + 1), c.cast("int") + 1), F.array().cast("array<double>")))
    return codes.select(key, F.when(F.size("codes") == m, F.flatten(parts)).otherwise(vectors.dequantize(F.col("codes"))).alias("embedding"))


def pq_error(docs: DataFrame, book: Codebook, key: str = "id") -> DataFrame:
    """key and error: root mean squared difference after encoding and decoding."""
    back = decode(encode(docs, book, key), book, key).withColumnRenamed("embedding", "decoded")
    return docs.join(back, key).select(key, vectors.rms_error(F.col("embedding"), F.col("decoded")).alias("error"))


def search_codes(codes: DataFrame, book: Codebook, query: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """rank, key, score of the k best by codes: a table of products of the query with the centroids is summed by code."""
    q = np.asarray(query, np.float64)
    if not book.trained:
        score = vectors.dot(vectors.dequantize(F.col("codes")), vectors.literal(q))
    else:
        table = [part @ piece for part, piece in zip(book.centroids, np.split(q, len(book.centroids)))]
        lookup = vectors.literal(table)
        score = F.aggregate(F.transform(F.col("codes"), lambda c, s: F.element_at(F.element_at(lookup, s + 1), c.cast("int") + 1)), F.lit(0.0), lambda a, x: a + x)
    top = codes.select(key, score.alias("dot")).orderBy(F.desc("dot"), key).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("dot"), key))
    return top.select(rank.cast("int").alias("rank"), key, vectors.search_score(F.col("dot")).alias("score"))
