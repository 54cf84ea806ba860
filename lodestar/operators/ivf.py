"""Approximate search by inverted lists: train on a bounded sample, assign every vector, visit the nearest lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.functions.arrays import matrix
from lodestar.operators.quantization import SAMPLE, assign, lloyd, sample
from lodestar.operators.search import exact_topk

#: Parts of a list that vectors are dealt into where queries meet lists, so a list isn't one task.
PARTS = 16


@dataclass(frozen=True)
class Index:
    """Centroids by list, and the vectors with the list of each (partitioned by list where stored)."""

    centroids: np.ndarray
    assigned: DataFrame
    key: str

    def nearest_lists(self, query: Sequence[float], n_probe: int) -> list[int]:
        d = ((self.centroids - np.asarray(query, np.float64)) ** 2).sum(axis=1)
        return np.argsort(d, kind="stable")[: max(1, n_probe)].tolist()

    def search(self, query: Sequence[float], k: int, n_probe: int) -> DataFrame:
        """rank, key, score, distance among the vectors of the nearest lists; the filter prunes partitions."""
        some = self.assigned.where(F.col("list_id").isin(self.nearest_lists(query, n_probe)))
        return exact_topk(some, query, k, self.key)


def build(docs: DataFrame, n_lists: int = 32, key: str = "id", most: int = 8 * SAMPLE) -> Index:
    """Fit the lists' centroids on at most ``most`` vectors, and assign every vector to one."""
    points = sample(docs, key, most)
    if not len(points):
        return Index(np.zeros((1, 1)), docs.select(key, "embedding", F.lit(0).alias("list_id")), key)
    centroids = lloyd(points, n_lists)
    shared = docs.sparkSession.sparkContext.broadcast(centroids)  # n_lists rows
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            good, x = matrix(batch.column(1), table.shape[1])
            own = np.full(len(good), -1, np.int32)
            own[good] = assign(x, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["k", "embedding", "list_id"])

    vectors_kind = dict(docs.dtypes)["embedding"]
    out = docs.select(F.col(key).alias("k"), "embedding").mapInArrow(run, f"k {kind}, embedding {vectors_kind}, list_id int").where("list_id >= 0")
    return Index(centroids, out.withColumnRenamed("k", key), key)


def list_sizes(index: Index) -> DataFrame:
    return index.assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


def save(index: Index, path: str, version: str = "") -> None:
    """Write centroids, assignments partitioned by list, and the version of the data that was indexed."""
    spark = index.assigned.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    index.assigned.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/assigned")
    spark.createDataFrame([(version, index.key)], "version string, key string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_version_table")


def load(spark: SparkSession, path: str, version: str = "") -> Index | None:
    """The index, or None if there is none of this version of the data; callers then search exactly."""
    from pyspark.errors import AnalysisException

    try:
        head = spark.read.parquet(f"{path}/_version_table").first()
        if head is None or head["version"] != version:
            return None
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
        assigned = spark.read.parquet(f"{path}/assigned")
    except AnalysisException:
        return None
    return Index(np.array([r["centroid"] for r in rows]), assigned, head["key"])


def batch_search(index: Index, queries: DataFrame, k: int, n_probe: int, query_key: str = "query_id") -> DataFrame:
    """query_key, rank, key, dot: queries go to their nearest lists and meet vectors by an equi-join on parts of lists."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    lists = F.broadcast(queries.sparkSession.createDataFrame(rows, "list_id int, centroid array<double>"))
    near = queries.select(query_key, F.col("embedding").alias("q")).join(lists, F.lit(True))
    near = near.withColumn("d", vectors.squared_distance(F.col("q"), F.col("centroid")))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("d", "list_id"))
    probes = near.withColumn("p", place).where(F.col("p") <= n_probe).select(query_key, "q", "list_id")
    parts = F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))
    dealt = index.assigned.withColumn("part", F.pmod(F.xxhash64(index.key), F.lit(PARTS)))
    scored = probes.withColumn("part", F.explode(parts)).join(dealt, ["list_id", "part"]).select(query_key, index.key, vectors.dot(F.col("q"), F.col("embedding")).alias("dot"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("dot"), index.key))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(query_key, "rank", index.key, "dot")
