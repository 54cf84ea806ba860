"""Plans are the ones that hold at scale: pruned columns and partitions, pushed filters, top-k without a full sort."""

import contextlib
import io

import pytest
from helpers import SF
from pyspark.sql import functions as F

from lodestar.operators import collections as C
from lodestar.operators import search
from lodestar.plans.fixtures import collection, embeddings, query_vector
from lodestar.sources import store


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "store")
    store.ingest(collection(spark, SF).withColumn("id", F.col("id").cast("string")), path, 64)
    return store.open_store(spark, path)


def test_topk_is_no_full_sort_and_reads_two_columns(spark):
    p = plan(search.exact_topk(embeddings(spark, SF), query_vector(spark, SF), 10, "vec_id"))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p


def test_scoring_reads_no_texts(stored):
    p = plan(search.exact_topk(stored, [0.1] * 64, 10))
    assert "text:string" not in p and "codes" not in p


def test_collections_are_pruned_and_ids_pushed(stored):
    assert "PartitionFilters: [isnotnull(collection" in plan(C.in_collection(stored, "fr"))
    p = plan(store.get(stored, "7"))
    assert "EqualTo(id,7)" in p


def test_windows_keep_only_their_ranks(spark, stored):
    assert "WindowGroupLimit" in plan(C.cross_shard_topk(C.routed(stored, 3), [0.1] * 64, 5))
    asked = embeddings(spark, SF).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert "WindowGroupLimit" in plan(search.batch_knn(embeddings(spark, SF), asked, 5, "vec_id"))


def test_filter_before_reaches_below_the_topk(spark, stored):
    q = [0.1] * 64
    assert plan(search.search(stored, q, 5, wanted={"lang": "fr"}, filter_mode="pre")).count("TakeOrderedAndProject") >= 1
    found = search.search(stored, q, 5, wanted={"lang": "fr"}, filter_mode="pre").collect()
    assert len(found) == 5 and all('"lang":"fr"' in r["metadata"] for r in found)
