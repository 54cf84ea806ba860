"""Operational metrics as aggregates, and their text form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The bounds of the histograms, and the names, texts and kinds of the metrics.
QUANT_BOUNDS = (0.0005, 0.001, 0.003, 0.005, 0.01, 0.05, math.inf)
LATENCY_BOUNDS = (0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 1.0, math.inf)
METRICS = {
    "vector_ingest_total": ("Total documents ingested", "counter"),
    "vector_search_total": ("Total search requests", "counter"),
    "vector_docs_total": ("Current number of documents in collection", "gauge"),
    "hnsw_num_vectors": ("Number of vectors in HNSW index per collection", "gauge"),
    "hnsw_max_connections": ("Max connections (M) in HNSW per collection", "gauge"),
    "hnsw_ef_construction": ("efConstruction parameter in HNSW per collection", "gauge"),
    "hnsw_ef_search": ("Default efSearch parameter in HNSW per collection", "gauge"),
    "quant_error": ("Quantization error (RMS) histogram", "histogram"),
    "vector_search_latency_seconds": ("Search/ingest latency in seconds", "histogram"),
}


def bound_text(bound: float) -> str:
    return "+Inf" if math.isinf(bound) else f"{bound:g}"


def counter(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def gauge(observations: DataFrame, value: str, at: str, *labels: str) -> DataFrame:
    """The last value of each label set; of equal times the larger value."""
    return observations.groupBy(*labels).agg(F.max(F.struct(at, value))[value].alias("value"))


def histogram(observations: DataFrame, value: str, bounds: Sequence[float], *labels: str) -> DataFrame:
    """labels, le, count (cumulative), sum, total: one aggregate over the rows, then a row for each bound."""
    sums = [F.coalesce(F.sum((F.col(value) <= F.lit(b)).cast("long")), F.lit(0)).alias(f"__b{i}") for i, b in enumerate(bounds)]
    one = observations.groupBy(*labels).agg(*sums, F.sum(value).alias("sum"), F.count(value).alias("total"))
    rows = F.array(*[F.struct(F.lit(bound_text(b)).alias("le"), F.col(f"__b{i}").alias("count")) for i, b in enumerate(bounds)])
    return one.select(*labels, F.explode(rows).alias("b"), "sum", "total").select(*labels, "b.le", "b.count", "sum", "total")


def _labelled(name: str, labels: Sequence[str], extra: Column | None = None) -> Column:
    parts = [F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels]
    parts += [] if extra is None else [extra]
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "))


def sample_lines(values: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """line of each label set of a counter or gauge."""
    return values.select(F.concat(_labelled(name, labels), F.col("value").cast("string")).alias("line"))


def histogram_lines(buckets: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    le = F.concat(F.lit('le="'), F.col("le"), F.lit('"'))
    own = buckets.select(F.concat(_labelled(f"{name}_bucket", labels, le), F.col("count").cast("string")).alias("line"))
    last = buckets.where("le = '+Inf'")
    sums = last.select(F.concat(_labelled(f"{name}_sum", labels), F.col("sum").cast("string")).alias("line"))
    totals = last.select(F.concat(_labelled(f"{name}_count", labels), F.col("total").cast("string")).alias("line"))
    return own.unionByName(sums).unionByName(totals)


def exposition(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with the text of all metrics. parts: lines by metric; label sets are few, so their lines fit one row."""
    texts = []
    for name, lines in parts.items():
        about, kind = METRICS[name]
        joined = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
        head = f"# HELP {name} {about}\n# TYPE {name} {kind}"
        texts.append(joined.select(F.lit(len(texts)).alias("n"), F.concat_ws("\n", F.lit(head), F.expr("nullif(body, '')")).alias("text")))
    out = texts[0]
    for t in texts[1:]:
        out = out.unionByName(t)
    return out.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def index_gauges(stats: DataFrame) -> DataFrame:
    """name, collection, value of the index gauges, from collections.stats()."""
    columns = {"hnsw_num_vectors": "num_documents", "hnsw_max_connections": "max_connections", "hnsw_ef_construction": "ef_construction", "hnsw_ef_search": "ef_search"}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("value")) for n, c in columns.items()])
    return stats.select("collection", F.explode(pairs).alias("g")).select("g.name", "collection", "g.value")
