"""Row types, settings and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("distance", T.DoubleType()),
    ]
)
MESSAGE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

# Limits and defaults that callers of such an engine rely on.
LIMIT_RANGE = (1, 1000)
OVER_FETCH_FILTER, OVER_FETCH_HYBRID = 5, 3
HYBRID_VECTOR, HYBRID_KEYWORDS = 0.7, 0.3
DEFAULT_COLLECTION = "default"


@dataclass(frozen=True)
class IndexConfig:
    """What stats report about the index, and how the approximate index is built."""

    max_connections: int = 16
    ef_construction: int = 80
    ef_search: int = 32
    n_lists: int = 32

    @property
    def label(self) -> str:
        return f"HNSW (M={self.max_connections}, ef_c={self.ef_construction}, ef_search={self.ef_search})"

    def n_probe(self, ef: int | None = None) -> int:
        """How many lists a search visits: three quarters by default, for a recall over 0.9 on vectors without clusters
        too; the share grows with ef."""
        ef = self.ef_search if ef is None else ef
        return max(1, min(self.n_lists, -(-3 * self.n_lists * ef // (4 * self.ef_search))))


@dataclass(frozen=True)
class EngineConfig:
    dim: int = 384
    max_docs: int = 1_000_000
    index: IndexConfig = IndexConfig()


class EngineError(ValueError):
    """Base of what this engine raises about its input."""


class EmptyText(EngineError):
    def __init__(self) -> None:
        super().__init__("text is empty or blank")


class DimMismatch(EngineError):
    def __init__(self, expected: int, actual: int) -> None:
        super().__init__(f"the vector has {actual} components; {expected} are expected")
        self.expected, self.actual = expected, actual


def clamp_limit(limit: int) -> int:
    return max(LIMIT_RANGE[0], min(LIMIT_RANGE[1], limit))
