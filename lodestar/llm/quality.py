"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words, word pairs, and runs of one to three word shapes (letter case, digits, signs, whether
the word repeats the one before), each hashed into one of 2**bits places. A place's value is the square root of its
count, and a text's values have length 1. Training is FTRL-proximal, one document after the other, on a sample of labelled
rows that has at most ``max_rows`` documents and ``max_values`` feature values (those with the smallest hashes of doc_id);
scoring is a sparse dot product with the weights, whose size 2**bits bounds what is broadcast.

Nulls: a null text counts as empty (its score is that of the bias); labels that are null, neither 0 nor 1, or contradict
each other for a doc_id teach nothing; without any label all scores are 0.5. A null doc_id is scored and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BASE, clean_docs, give_back, lower_ascii, mix, run_hashes, span_hashes, stored, text_column, word_spans


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: The most labelled documents that training reads.
    max_rows: int = 5000
    #: The most feature values of those documents (6 bytes each) that the driver takes; it stops before one more document.
    max_values: int = 16_000_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3


#: Each byte's class: other, lower, upper, digit, sign, beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5


def features(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one text's UTF-8 bytes."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    exact = span_hashes(data, starts, ends)
    lower = span_hashes(lower_ascii(data), starts, ends)
    kind = _KIND[data]
    shape = (kind[starts] * 6 + kind[ends - 1]).astype(np.uint64)
    for k in (2, 3, 4):
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        n = sums[ends] - sums[starts]
        shape = shape * np.uint64(3) + np.minimum(n, 2).astype(np.uint64)
    same = np.zeros(len(exact), np.uint64)
    same[1:] = exact[1:] == exact[:-1]
    shape = mix(shape * np.uint64(2) + same + np.uint64(1 << 40))
    parts = [lower, run_hashes(lower, 2), *(run_hashes(shape, n) ^ np.uint64(n * BASE & (1 << 60) - 1) for n in (1, 2, 3))]
    places, counts = np.unique(np.concatenate(parts) & np.uint64((1 << bits) - 1), return_counts=True)
    values = np.sqrt(counts)
    return places.astype(np.uint32), (values / np.sqrt(counts.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: places, values and label, in the order of the first epoch; later ones shuffle it."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias, bias_n = 0.0, 1.0
    order = np.random.default_rng(7)
    for epoch in range(s.epochs):
        for k in order.permutation(len(rows)) if epoch else range(len(rows)):
            places, values, label = rows[k]
            zi, ni = z[places], n[places]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= s.l1, 0, -(zi - np.sign(zi) * s.l1) / ((s.beta + root) / s.alpha + s.l2))
            p = 1 / (1 + np.exp(-np.clip(w @ values + bias, -35, 35)))
            g = (p - label) * values
            n[places] = ni + g * g
            z[places] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
            bias_n += (p - label) ** 2
            bias -= 0.1 * (p - label) / np.sqrt(bias_n)
    w = np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w.astype(np.float32), float(bias)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most s.max_rows labelled documents that aren't held out, as features; their texts stay on the executors."""
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.max_rows)
        .select("doc_id", "quality")
        .collect()
    )
    if not known:
        return []
    chosen = F.broadcast(spark.createDataFrame(known, "doc_id long, quality int"))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("places", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch)
            made = [features(data[offsets[i] : offsets[i + 1]], s.bits) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p.tobytes() for p, _ in made], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in made], pa.binary())], schema=schema)

    found = clean_docs(docs).join(chosen, "doc_id").mapInArrow(run, "doc_id long, quality int, places binary, values binary")
    # repeated rows of a document teach once
    found = stored(found.groupBy("doc_id").agg(F.min(F.struct("places", "values", "quality")).alias("x")).select("doc_id", "x.*"), "quality-sample")
    size = {r[0]: r[1] // 4 for r in found.select("doc_id", F.octet_length("places")).collect()}
    order = [r["doc_id"] for r in known if r["doc_id"] in size]  # by hash, so a part of them is a sample too
    fits = int(np.searchsorted(np.cumsum([size[i] for i in order]), s.max_values, "right"))
    if fits < len(order):
        found = found.where(F.col("doc_id").isin(order[:fits]) if fits else F.lit(False))
    found = found.toPandas().sort_values("doc_id").sample(frac=1, random_state=7)
    return [(np.frombuffer(r.places, np.uint32), np.frombuffer(r.values, np.float16).astype(np.float32), int(r.quality)) for r in found.itertuples()]


def score(docs: DataFrame, weights: np.ndarray, bias: float, bits: int, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_column(batch)
            scores = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                places, values = features(data[offsets[i] : offsets[i + 1]], bits)
                scores[i] = w[places] @ values + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(scores, -35, 35))))], schema=schema)
        give_back()

    return (
        clean_docs(docs)
        .mapInArrow(run, "doc_id long, score double")
        .select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def keep_good(docs: DataFrame, weights: np.ndarray, bias: float, s: Settings, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, that score threshold or more; one pass, and no join."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    least = float(np.log(threshold / (1 - threshold))) - bias
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_column(batch.select([at]))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                places, values = features(data[offsets[i] : offsets[i + 1]], s.bits)
                good[i] = w[places] @ values >= least
            yield batch.filter(pa.array(good))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the labelled rows that aren't held out, and score every document."""
    weights, bias = train(training_rows(docs, labels, settings), settings)
    return score(docs, weights, bias, settings.bits)
