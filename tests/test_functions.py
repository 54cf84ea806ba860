import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import jsons, text, vectors

quick = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine_and_normalize(spark):
    lit = vectors.literal
    assert one(spark, vectors.cosine(lit([1, 0, 0]), lit([1, 0, 0]))) == pytest.approx(1)
    assert one(spark, vectors.cosine(lit([1, 0]), lit([0, 1]))) == pytest.approx(0)
    assert one(spark, vectors.norm(lit([3, 4]))) == pytest.approx(5)
    assert one(spark, vectors.normalize(lit([3, 4]))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalize(lit([0, 0]))) == [0, 0]
    assert one(spark, vectors.search_score(F.lit(-0.5))) == 0


def test_scalar_quantization(spark):
    v = F.array(*[F.lit(x).cast("float") for x in (-1.0, 0.0, 0.5, 1.0, 2.0)])
    assert one(spark, vectors.quantize(v)) == [0, 127, 191, 255, 255]
    back = one(spark, vectors.dequantize(vectors.quantize(v)))
    assert all(abs(a - b) < 0.01 for a, b in zip(back, (-1, 0, 0.5, 1)))
    assert one(spark, vectors.rms_error(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0


@quick
@given(st.lists(st.floats(-1, 1, width=32), min_size=1, max_size=20))
def test_quantize_round_trip(spark, values):
    v = F.array(*[F.lit(x).cast("float") for x in values])
    back = one(spark, vectors.dequantize(vectors.quantize(v)))
    assert max(abs(a - b) for a, b in zip(values, back)) <= 1 / 127.5 + 1e-6


def test_blank_and_words(spark):
    assert one(spark, text.is_blank(F.lit("  \t\n")))
    assert not one(spark, text.is_blank(F.lit(" a ")))
    assert one(spark, text.words(F.lit(" a b  c "))) == ["a", "b", "c"]


def test_keyword_score_keeps_the_querys_case(spark):
    assert one(spark, text.keyword_score(F.lit("Rust is fast"), "rust Rust fast xyz")) == pytest.approx(0.5)
    assert one(spark, text.keyword_score(F.lit("Rust is fast"), "Rust", fold_query=True)) == 1
    assert one(spark, text.keyword_score(F.lit("x"), "  ")) == 0


@quick
@given(st.text(max_size=40), st.integers(1, 9))
def test_shard_of(spark, name, shards):
    h = 0
    for b in name.encode("utf-8", "surrogatepass") if not any(0xD800 <= ord(c) < 0xE000 for c in name) else b"":
        h = (h * 31 + b) % 2**64
    if not any(0xD800 <= ord(c) < 0xE000 for c in name) and "\0" not in name:
        df = spark.createDataFrame([(name,)], "n string").select(text.shard_of(F.col("n"), shards).alias("x"))
        assert df.first()["x"] == h % shards


def test_shards_are_positive():
    with pytest.raises(ValueError):
        text.shard_of(None, 0)


def test_typed_json_equality(spark):
    values = [1, 1.0, "1", True, None, [1], {"a": 1, "b": 2}]
    docs = spark.createDataFrame([(i, json.dumps({"k": v})) for i, v in enumerate(values)] + [(99, "{}"), (100, "not json")], "i int, m string")
    for i, v in enumerate(values):
        assert [r["i"] for r in docs.where(jsons.matches(F.col("m"), {"k": v})).collect()] == [i]
    assert docs.where(jsons.matches(F.col("m"), {"k": {"b": 2, "a": 1}})).count() == 1
    assert docs.where(jsons.matches(F.col("m"), 5)).count() == 9
    assert docs.where(jsons.matches(F.col("m"), {"k": 1, "other": 1})).count() == 0


def test_shortened_counts_characters(spark):
    assert one(spark, text.shortened(F.lit("é" * 90))) == "é" * 80 + "..."


def test_poly_vectors_agree_with_numpy(spark):
    a, b = np.random.default_rng(0).normal(size=(2, 30))
    assert one(spark, vectors.dot(vectors.literal(a), vectors.literal(b))) == pytest.approx(a @ b)
