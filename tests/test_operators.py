import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.operators import collections as C
from lodestar.operators import embed, evaluate, ivf, metrics, quantization, rag, search
from lodestar.plans.engine import Engine
from lodestar.sources import store
from lodestar.streaming import ingest, ratelimit


@pytest.fixture(scope="module")
def unit():
    v = np.random.default_rng(3).normal(size=(200, 16))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def docs(spark, unit):
    rows = [(i, f"text {i} {'x' * (i % 7)}", v.tolist(), f'{{"n": {i % 3}}}', f"c{i % 4}") for i, v in enumerate(unit)]
    return spark.createDataFrame(rows, "id long, text string, embedding array<double>, metadata string, collection string").cache()


def ids(df, key="id"):
    return [r[key] for r in df.orderBy("rank").collect()]


def brute(unit, q, k):
    s = unit @ q
    return sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]


def test_topk_is_brute_force(docs, unit):
    assert ids(search.exact_topk(docs, unit[5].tolist(), 7)) == brute(unit, unit[5], 7)
    first = search.exact_topk(docs, unit[5].tolist(), 1).first()
    assert first["id"] == 5 and first["score"] > 0.98 and first["distance"] == pytest.approx(0, abs=1e-9)
    assert search.exact_topk(docs, unit[5].tolist(), 0).count() == 0
    with pytest.raises(S.DimMismatch):
        search.exact_topk(docs, [0.1] * 10, 3, dim=16)


def test_ranks_are_given_before_clamping(spark):
    d = spark.createDataFrame([(1, [-0.9, 0.0]), (2, [-0.1, 0.0]), (3, [0.0, 0.0])], "id long, embedding array<double>")
    assert ids(search.exact_topk(d, [1.0, 0.0], 3)) == [3, 2, 1]


@pytest.mark.parametrize("most", [search.MOST_QUERIES, 3])
def test_batches_agree_with_single_queries(spark, docs, unit, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_QUERIES", most)
    monkeypatch.setattr(search, "DOC_BLOCK", 64)
    asked = spark.createDataFrame([(i, unit[i].tolist()) for i in range(10)], "query_id long, embedding array<double>")
    found = search.batch_knn(docs, asked, 5).collect()
    for i in range(10):
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i] == brute(unit, unit[i], 5)


@pytest.mark.parametrize("most", [search.MOST_QUERIES, 3])
def test_similarity_reaches_the_threshold(spark, docs, unit, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_QUERIES", most)
    monkeypatch.setattr(search, "DOC_BLOCK", 64)
    asked = spark.createDataFrame([(i, unit[i].tolist()) for i in range(8)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["id"]) for r in search.similarity_search(docs, asked, 0.4).collect()}
    assert got == {(i, j) for i in range(8) for j in range(200) if i != j and unit[i] @ unit[j] >= 0.4}


def test_vectors_that_cant_be_compared_are_left_out(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.5])], "query_id long, embedding array<double>")
    assert [r["id"] for r in search.batch_knn(d, asked, 5).collect()] == [1]


def test_filters_before_and_after(docs, unit):
    q = unit[0].tolist()
    every = brute(unit, unit[0], 200)
    assert ids(search.search(docs, q, 3, wanted={"n": 1}, filter_mode="pre")) == [i for i in every if i % 3 == 1][:3]
    assert ids(search.search(docs, q, 3, wanted={"n": 1}, truncate=False)) == [i for i in every[:15] if i % 3 == 1]
    assert search.search(docs, q, 5000).count() == 200
    assert search.search(docs, q, 10, at_least=2.0).count() == 0


def test_hybrid_and_rerank(spark):
    d = spark.createDataFrame([(1, "Rust is a systems language", [1.0, 0.0], "{}"), (2, "bread and butter", [0.99, 0.14], "{}")], "id long, text string, embedding array<double>, metadata string")
    found = search.hybrid(d, "rust performance", [0.99, 0.14], 2)
    assert found.orderBy("rank").first()["text"].startswith("Rust")
    assert search.hybrid(d, "  ", [1.0, 0.0], 2).count() == 0
    again = search.rerank_length(search.retrieve(d, "q", [1.0, 0.0], 2)).orderBy("rank").collect()
    assert again[0]["score"] == 1.0 and all(r["score"] <= 1 for r in again)


def test_lloyd_and_pq(spark):
    v = np.array([[((7 * i + 3 * j) % 200) / 100 - 1 for j in range(16)] for i in range(200)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    book = quantization.train(v, 4, 16)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    codes = quantization.encode(d, book)
    assert all(len(r["codes"]) == 4 and all(0 <= c < 16 for c in r["codes"]) for r in codes.collect())
    assert quantization.pq_error(d, book).agg(F.max("error")).first()[0] < 0.5
    assert quantization.decode(codes, book).first()["embedding"].__len__() == 16
    assert np.allclose(quantization.Codebook.of(book.table(spark)).centroids, book.centroids)
    assert not quantization.train(np.zeros((0, 4))).trained
    for m, k in ((0, 4), (1, 257)):
        with pytest.raises(ValueError):
            quantization.train(v, m, k)
    assert quantization.train(v, 3, 4).centroids.shape == (1, 4, 16)
    odd = spark.createDataFrame([(1, [0.5] * 3)], "id long, embedding array<double>")
    assert quantization.encode(odd, book).first()["codes"] == [191] * 3


def test_product_tables_score_like_decoded_vectors(spark, docs, unit):
    book = quantization.train(unit, 4, 8)
    codes = quantization.encode(docs, book)
    by_codes = ids(quantization.search_codes(codes, book, unit[0].tolist(), 10))
    assert by_codes == ids(search.exact_topk(quantization.decode(codes, book), unit[0].tolist(), 10))


def test_ivf(spark, docs, unit, tmp_path):
    index = ivf.build(docs, 8)
    assert ids(index.search(unit[0].tolist(), 5, 8)) == brute(unit, unit[0], 5)
    assert ivf.list_sizes(index).agg(F.sum("n")).first()[0] == 200
    ivf.save(index, str(tmp_path / "i"))
    again = ivf.load(spark, str(tmp_path / "i"))
    assert ids(again.search(unit[0].tolist(), 5, 8)) == brute(unit, unit[0], 5)
    assert ivf.load(spark, str(tmp_path / "none")) is None


def test_recall(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "query_id long, id long")
    b = spark.createDataFrame([(0, 1), (0, 5), (1, 3), (1, 4), (2, 9), (2, 8)], "query_id long, id long")
    assert evaluate.recall(a, b, 2).first()["recall"] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert evaluate.recall(a, b.limit(0), 2).first()["recall"] == 1.0


def test_synthetic(spark):
    rows = evaluate.synthetic(spark, 10, 384, 123).orderBy("idx").collect()
    state = 123
    for r in rows:
        v = []
        for _ in range(384):
            state = (state * evaluate.MULTIPLIER + 1) % 2**64
            v.append(np.float32(state >> 33) / np.float32(2**31 - 1) * 2 - 1)
        v = np.array(v, float)
        assert np.allclose(r["embedding"], v / np.linalg.norm(v), atol=1e-5)
    assert rows[3]["text"] == "synthetic-doc-3" and rows[3]["metadata"] == '{"idx":3,"type":"synthetic"}'


def test_cross_shard_topk_is_global(docs, unit):
    d = C.routed(docs, 3)
    assert ids(C.cross_shard_topk(d, unit[9].tolist(), 6)) == brute(unit, unit[9], 6)
    assert C.placed(d.drop("shard"), 3, 2).count() == 400
    assert C.retain(docs, 10, "id").groupBy("collection").count().agg(F.max("count")).first()[0] == 10
    assert C.in_collection(docs, "none").count() == 0


def test_histogram_is_cumulative(spark):
    d = spark.createDataFrame([("a", 0.0004), ("a", 0.002), ("a", 7.0), ("b", None)], "k string, v double")
    h = {(r["k"], r["le"]): r["count"] for r in metrics.histogram(d, "v", metrics.QUANT_BOUNDS, "k").collect()}
    assert h["a", "0.0005"] == 1 and h["a", "0.003"] == 2 and h["a", "+Inf"] == 3 and h["b", "+Inf"] == 0
    out = metrics.exposition({"vector_ingest_total": metrics.sample_lines(metrics.counter(d, "k"), "vector_ingest_total", ["k"])}).first()["text"]
    assert out.splitlines() == ["# HELP vector_ingest_total Total documents ingested", "# TYPE vector_ingest_total counter", 'vector_ingest_total{k="a"} 3', 'vector_ingest_total{k="b"} 1']


def test_prompts(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", " hi "), (1, 2, "assistant", "yes"), (2, 0, "user", "what is all this here"), (3, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["query"], r["route"]) for r in rag.route(rag.last_user(turns)).collect()}
    assert got == {1: ("hi", "vector"), 2: ("what is all this here", "hybrid"), 3: ("", "none")}
    chats = rag.messages(turns).withColumn("context", F.when(F.col("conv_id") < 3, "C"))
    out = {r["conv_id"]: r["messages"] for r in rag.augment(chats).collect()}
    assert len(out[1]) == 3 and out[1][0]["content"].endswith("Context:\nC\n\nbe kind")
    assert len(out[2]) == 2 and out[2][0]["role"] == "system"
    assert [m["content"] for m in out[3]] == ["x"]


def test_store_validates_and_is_atomic(spark, tmp_path):
    path = str(tmp_path / "s")
    bad = spark.createDataFrame([("a", [1.0, 0.0]), ("  ", [1.0, 0.0]), ("b", [1.0])], "text string, embedding array<double>")
    with pytest.raises(S.EngineError):
        store.ingest_strict(bad, path, 2)
    assert store.open_store(spark, path).count() == 0
    store.ingest(bad.withColumn("metadata", F.lit("{broken")), path, 2)
    row = store.open_store(spark, path).first()
    assert (row["text"], row["metadata"], row["collection"], row["codes"]) == ("a", "{}", "default", [255, 127])
    assert len(row["id"]) == 36
    assert store.decoded(store.open_store(spark, path), "scalar").first()["embedding"][0] == pytest.approx(1)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), S.EngineConfig(dim=32))
    e.ingest(spark.createDataFrame([("Rust is a fast systems language", '{"lang": "en"}'), ("le pain est bon", '{"lang": "fr"}')], "text string, metadata string"))
    top = e.search("Rust is a fast systems language", 1).first()
    assert "Rust" in top["text"] and top["score"] > 0.98
    assert e.search("rust systems", 2, hybrid=True, metadata_filter={"lang": "fr"}).count() == 1
    assert e.search("x", collection="none").count() == 0
    assert e.stats().first()["num_documents"] == 2
    assert [r["rank"] for r in e.search_batch(["rust", "pain"], 2).orderBy("query_id", "rank").collect()] == [1, 2, 1, 2]
    said = e.chat_messages([("user", "tell me about fast rust")]).first()["messages"]
    assert said[0]["role"] == "system" and "- [1]: " in said[0]["content"]
    e.save_index()
    assert e.search_approximate("le pain est bon", 1, ef=200).count() == 1
    with pytest.raises(S.EmptyText):
        e.search("  ")
    with pytest.raises(S.DimMismatch):
        e.search([1.0], 1)
    before = e.search_approximate("a text that comes later", 1).first()["score"]
    e.ingest(spark.createDataFrame([("a text that comes later",)], "text string"))
    assert before < 0.9 < e.search_approximate("a text that comes later", 1).first()["score"]  # the index is of older data
    e.delete("default")
    assert e.docs().count() == 0


def test_the_oldest_rows_go(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), S.EngineConfig(dim=4, max_docs=10))
    made = lambda a, b, c: spark.createDataFrame([(f"{i:03d}", f"text {i}", i, c) for i in range(a, b)], "id string, text string, ingest_seq long, collection string")
    e.ingest(made(0, 8, "a"))
    e.ingest(made(0, 3, "b"))
    assert e.docs("a").count() == 8
    e.ingest(made(8, 15, "a"))
    assert sorted(r["id"] for r in e.docs("a").collect()) == [f"{i:03d}" for i in range(5, 15)] and e.docs("b").count() == 3
    e.ingest(made(15, 17, "a"))
    assert sorted(r["id"] for r in e.docs("a").collect()) == [f"{i:03d}" for i in range(7, 17)]


def test_codebooks_of_the_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), S.EngineConfig(dim=16))
    assert not e.codebook().trained
    e.ingest(spark.createDataFrame([(f"text number {i}",) for i in range(60)], "text string"))
    book = e.train_pq(m=4, k=16)
    assert np.allclose(e.codebook().centroids, book.centroids) and book.centroids.shape == (4, 16, 4)
    back = store.decoded(e.docs(), "pq", e.codebook()).join(e.docs().select("id", F.col("embedding").alias("v")), "id").collect()
    assert len(back) == 60 and np.mean([np.square(np.subtract(r["embedding"], r["v"])).mean() for r in back]) < 0.05
    with pytest.raises(ValueError):
        store.decoded(e.docs(), "pq")


def test_default_codebook():
    v = quantization.generated(2, 3)
    state, want = quantization.DEFAULT_SEED, []
    for _ in range(6):
        state = (state * quantization.MULTIPLIER + quantization.INCREMENT) % 2**64
        want.append((state >> 32) / (2**32 - 1) * 2 - 1)
    want = np.array(want).reshape(2, 3)
    assert np.allclose(v, want / np.linalg.norm(want, axis=1, keepdims=True))
    book = quantization.default_codebook()
    assert book.centroids.shape == (8, 256, 48) and book.dim == 384


def test_more_than_256_centroids_are_an_error(spark):
    points = spark.createDataFrame([(1, [299.0])], "id long, v array<double>")
    made = lambda n: spark.createDataFrame([(i, [float(i)]) for i in range(n)], "code int, centroid array<double>")
    assert quantization.nearest(points, made(256)).first()["code"] == 255
    with pytest.raises(ValueError):
        quantization.nearest(points, made(300))


def test_training_samples_cover_all_rows(docs, unit):
    some = quantization.sample(docs, "id", 50)
    at = [int(np.argmax(unit @ v)) for v in some]
    assert len(set(at)) == 50 and max(at) > 150 and min(at) < 50


def test_model_embedder_with_a_stub(spark):
    class Session:
        def run(self, _, feed):
            ids = feed["input_ids"]
            return [np.stack([ids, ids * 0 + 1.0], axis=2)]

    encode = lambda texts: [([len(w) for w in t.split()], [1] * len(t.split()), [0] * len(t.split())) for t in texts]
    model = embed.OnnxEmbedder("m", "t", 2, Session(), encode)
    v = model.embed_batch(["aaa b", "cc"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and np.allclose(v[1], np.array([2, 1]) / np.sqrt(5))
    assert model.embed_batch([]).shape == (0, 2)
    with pytest.raises(S.EmptyText):
        embed.embed_one(model, " ")


def test_stream_ingest(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(str(i), f"t{i}", [1.0], i) for i in range(20)], "id string, text string, embedding array<float>, ingest_seq long").write.parquet(src)
    rows = spark.readStream.schema("id string, text string, embedding array<float>, ingest_seq long").parquet(src)
    ingest.stream_ingest(rows, str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination()
    assert store.open_store(spark, str(tmp_path / "out")).count() == 20


def test_one_store_for_batches_and_streams(spark, tmp_path):
    """A batch, a stream, the stream again from another checkpoint, and a batch: all rows are there."""
    src, out, kinds = str(tmp_path / "in"), str(tmp_path / "out"), "id string, text string, embedding array<float>, ingest_seq long"
    rows = spark.createDataFrame([(str(i), f"t{i}", [1.0], i) for i in range(20)], kinds)
    rows.write.parquet(src)
    store.ingest(rows, out, 1)
    for k in range(2):
        ingest.stream_ingest(spark.readStream.schema(kinds).parquet(src), out, str(tmp_path / f"ck{k}"), 1).awaitTermination()
    store.ingest_strict(rows, out, 1)
    got = store.open_store(spark, out)
    assert got.count() == 80 and got.select("id").distinct().count() == 20
    assert got.select("epoch").distinct().count() == 3
    store.ingest_epoch(rows.limit(5), out, 1, "again")
    store.ingest_epoch(rows.limit(5), out, 1, "again")
    assert store.open_store(spark, out).count() == 85


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 5)), int(s)) for i, s in enumerate(np.sort(rng.integers(0, 2000, 400)))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long")
    state, want = {}, {}
    for i, u, s in rows:
        start, n = state.get(u, (None, 0))
        *state[u], want[i] = ratelimit.step(start, n, s, 60, 3)
    got = {r["event_id"]: r["allowed"] for r in ratelimit.batch_limit(events, "user_id", "s", "event_id", 60, 3).collect()}
    assert got == want
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, user_id long, s long").parquet(str(tmp_path / "e"))
    q = ratelimit.stream_limit(stream, "user_id", "s", "event_id", 60, 3).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == want


def test_forwarding_is_the_callers(spark):
    def call(messages):
        if messages[-1]["content"] == "bad":
            raise RuntimeError("no model")
        return messages[-1]["role"] + ":" + messages[-1]["content"]

    chats = spark.createDataFrame([(1, [("user", "hi")]), (2, [("user", "bad")])], "conv_id long, messages array<struct<role:string,content:string>>")
    got = {r["conv_id"]: (r["answer"], r["error"]) for r in rag.forward(chats, call).collect()}
    assert got == {1: ("user:hi", None), 2: (None, "RuntimeError: no model")}


def test_compute_recall_of_exact_search_is_one(spark, docs, unit):
    asked = spark.createDataFrame([(i, unit[i].tolist()) for i in range(3)], "query_id long, embedding array<double>")
    assert evaluate.compute_recall(docs, search.batch_knn, asked, 5).first()["recall"] == 1.0


def test_command_line(spark, tmp_path):
    from lodestar.__main__ import parser, run

    go = lambda *a: run(spark, parser().parse_args(["--path", str(tmp_path / "cli"), "--dim", "16", *a]))
    assert len(go("ingest", "--text", "hello there world", "--show-id")[0]) == 36
    assert go("ingest", "--text", "it's \"other\" text", "--meta", "{oops") == ["ingested"]
    assert go("search", "--query", "hello there world", "--limit", "1")[0].endswith("hello there world")
    assert len(go("retrieve", "--query", "hello there world text", "--hybrid")) == 2
    assert '"num_documents": 2' in go("stats")[0] and go("list") == ["default"]
    assert go("embed", "--text", "abc")[0].startswith("dim 16") and go("embed", "--text", "abc")[0].endswith("norm 1.0000")


def test_running_counters(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "ab"[i % 2]) for i in range(40)]
    spark.createDataFrame(rows, "i long, at string, k string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("i long, at timestamp, k string").parquet(str(tmp_path / "e"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {(r["k"], r["value"]) for r in run(ingest.running_counter(events, "k"), "plain", "update")} == {("a", 20), ("b", 20)}
    by_window = run(ingest.running_counter(events, "k", at="at", window="10 minutes"), "windows", "update")
    assert {(r["window"]["start"].minute, r["k"], r["value"]) for r in by_window} == {(m, k, 5) for m in (0, 10, 20, 30) for k in "ab"}
