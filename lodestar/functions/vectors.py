"""Column builders for vectors: similarity, normalisation, scalar quantization. All stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence) -> Column:
    """An array of doubles, or of arrays of them, as one constant: planning and generated code stay small."""
    depth, inner = 1, values
    while len(inner) and isinstance(inner[0], (list, tuple, np.ndarray)):
        depth, inner = depth + 1, inner[0]
    flat = np.asarray(values, np.float64)
    if flat.size and np.isfinite(flat).all():
        return F.from_json(F.lit(json.dumps(flat.tolist())), "array<" * depth + "double" + ">" * depth)
    return F.array(*[literal(v) if depth > 1 else F.lit(float(v)) for v in values]).cast("array<" * depth + "double" + ">" * depth)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, over the components that both have."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, from -1 to 1."""
    return clamp(dot(a, b), -1.0, 1.0)


def search_score(d: Column) -> Column:
    """What a search reports for a dot product: from 0 to 1."""
    return clamp(d, 0.0, 1.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row, however often f uses it, within lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalize(v: Column) -> Column:
    """Unit vector; vectors of length up to 1e-8 stay as they are."""
    scaled = lambda w: bound(norm(w), lambda n: F.when(n > 1e-8, F.transform(w, lambda x: x / n)).otherwise(w))
    return bound(doubles(v), scaled)


def quantize(v: Column) -> Column:
    """Components from -1 to 1 as codes 0 to 255, cut off in single precision."""
    one, scale = F.lit(1.0).cast("float"), F.lit(127.5).cast("float")
    low, high = F.lit(0.0).cast("float"), F.lit(255.0).cast("float")
    return F.transform(v.cast("array<float>"), lambda x: F.greatest(low, F.least(high, (x + one) * scale)).cast("smallint"))


def dequantize(codes: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") / 127.5 - 1.0)


def rms_error(original: Column, decoded: Column) -> Column:
    """Root of the mean squared difference; 0 for empty vectors."""
    squares = F.zip_with(doubles(original), doubles(decoded), lambda a, b: (a - b) * (a - b))
    return F.when(F.size(original) == 0, 0.0).otherwise(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(original)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
