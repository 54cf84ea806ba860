"""Connected components of a table of edges, by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, shared_path, stored


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """node and root (the smallest node it is connected with) of all nodes of the edges (a, b).

    Each round is written to shared storage, and the one before it deleted. Minima are combined before the shuffle, and the joins of edges to minima are
    ones that Spark splits at hot nodes.
    """
    spark = edges.sparkSession
    path = shared_path(spark, what)
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what, path)
    seen = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(print_) == seen:
            break
        seen = tuple(print_)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, path = path, shared_path(spark, what)
        now = stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what, path)
        discard(spark, before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
