"""Media, WARC, pivots, quality, mixing, queries and the pipeline."""

import hashlib
import random
import re
import time
import zlib

import brute
import numpy as np
import pytest
from helpers import SF, same_as_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import media, mixing, pivots, quality, queries, warc
from lodestar.llm.common import shared_path

# ---------------------------------------------------------------- media


def plain_scan(jpeg):
    """Coefficients of a one-component scan, bit by bit."""
    head = media.parse_markers(jpeg)
    codes = {}
    for name, (counts, symbols) in head["huffman"].items():
        code, left = 0, list(symbols)
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                codes[name, f"{code:0{n}b}"] = left.pop(0)
                code += 1
            code *= 2
    out = []
    for piece in re.split(rb"\xff[\xd0-\xd7]", head["data"]):
        bits = "".join(f"{x:08b}" for x in piece.replace(b"\xff\x00", b"\xff"))
        at, last = 0, 0

        def symbol(table):
            nonlocal at
            n = next(n for n in range(1, 17) if (table, bits[at : at + n]) in codes)
            at += n
            return codes[table, bits[at - n : at]]

        def amplitude(size):
            nonlocal at
            at += size
            v = int(bits[at - size : at] or "0", 2)
            return v if not size or v >> (size - 1) else v - 2**size + 1

        for _ in range(head["restart"]):
            if len(out) == head["frame"][0] * head["frame"][1] // 64:
                break
            last += amplitude(symbol(0))
            block = [last]
            while len(block) < 64:
                s = symbol(0x10)
                if s == 0:
                    block += [0] * (64 - len(block))
                else:
                    block += [0] * (s >> 4)
                    block.append(amplitude(s & 15))
            out.append(block)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500) | st.text("ab \0", max_size=900).map(str.encode), min_size=1, max_size=4), st.booleans())
def test_jpeg_round_trip(raws, side_by_side):
    payloads = [media.pad(raw) for raw in raws]
    jpegs = media.encode_batch(payloads)
    assert jpegs == [media.encode_jpeg(p) for p in payloads]
    before, media.FEW_LANES = media.FEW_LANES, 0 if side_by_side else 1 << 30
    try:
        found = media.decode_batch(jpegs)
    finally:
        media.FEW_LANES = before
    for payload, jpeg, f in zip(payloads, jpegs, found):
        assert f["payload"] == payload
        blocks = plain_scan(jpeg)
        order = [0, *[s * (k + 1) for k in range(128) for s in (1, -1)]]  # the k-th byte of the table has the k-th of these
        assert [order.index(c) for c in sum(blocks, [])[: len(payload)]] == [([0, *dict.fromkeys([*media.FREQUENT, *range(1, 256)])]).index(x) for x in payload]
        across, down = f["width"] // 8, f["height"] // 8
        grid = [[min(255, max(0, (blocks[y * across + x][0] + 1028) // 8)) for x in range(across)] for y in range(down)]
        assert f["thumbnail"].tolist() == grid
        mean = sum(map(sum, grid)) / (across * down)
        bits = ""
        for i in range(8):
            for j in range(8):
                ys, xs = (range(k * n // 8, max(k * n // 8 + 1, (k + 1) * n // 8)) for k, n in ((i, down), (j, across)))
                bits += str(int(sum(grid[y][x] for y in ys for x in xs) / (len(ys) * len(xs)) > mean + 1e-9))
        assert media.thumbnail_hash(f["thumbnail"])[:16] == f"{int(bits, 2):016x}"


def test_damaged_files_are_told():
    jpeg = media.encode_jpeg(media.pad(b"some prose that is long enough " * 40))
    for cut in (len(jpeg) // 2, len(jpeg) - 40):
        with pytest.raises(media.NotBaseline):
            media.decode_jpeg(jpeg[:cut])
    good, bad = media.decode_batch([jpeg, jpeg[:-90] + jpeg[-2:]])
    assert good["payload"] and isinstance(bad, media.NotBaseline)


def colour_jpeg(rnd, across, down):
    """A file of three components, the first with 2 x 2 blocks a unit, without restart markers; and its first DCs."""
    bits, last, first = [], [0, 0, 0], np.zeros((2 * down, 2 * across), int)
    for y in range(down):
        for x in range(across):
            for part, n in ((0, 4), (1, 1), (2, 1)):
                for b in range(n):
                    dc = rnd.randint(-60, 60)
                    d, last[part] = dc - last[part], dc
                    size = abs(d).bit_length()
                    bits.append(f"{size:03b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else ""))
                    bits += ["100" + rnd.choice("01") * 3 for _ in range(rnd.randint(0, 9))] + ["0"]
                    if not part:
                        first[2 * y + b // 2, 2 * x + b % 2] = dc
    bits = "".join(bits)
    scan = int(bits + "1" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8).replace(b"\xff", b"\xff\x00")
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2) + b
    # AC: end of block "0", two zeros and size 3 "100"
    dht = seg(0xC4, bytes([0, 0, 0, 8, *[0] * 13, *range(8)])) + seg(0xC4, bytes([0x10, 1, 0, 1, *[0] * 13, 0, 0x23]))
    frame = seg(0xC0, b"\x08" + (16 * down).to_bytes(2) + (16 * across).to_bytes(2) + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8]) * 64) + frame + dht + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", first


def test_large_colour_file_in_linear_time():
    rnd = random.Random(5)
    jpeg, first = colour_jpeg(rnd, 7, 3)
    assert media.decode_jpeg(jpeg)["thumbnail"].tolist() == (first + 128).tolist()
    jpeg, first = colour_jpeg(rnd, 250, 120)
    assert len(jpeg) > 500_000
    begin = time.perf_counter()
    assert media.decode_jpeg(jpeg)["thumbnail"].tolist() == (first + 128).tolist()
    assert time.perf_counter() - begin < 10


def foreign_jpeg(dcs, restart=0):
    """A baseline file with other tables: sizes 0 to 7 for DC in 3 bits each, end of block in 1 bit; 8 for each quant."""
    bits = ""
    last = 0
    parts = []
    for k, dc in enumerate(dcs):
        if restart and k and k % restart == 0:
            parts.append(bits)
            bits, last = "", 0
        d = dc - last
        last = dc
        size = abs(d).bit_length()
        bits += f"{size:03b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    parts.append(bits)
    pack = lambda b: int((b + "1" * (-len(b) % 8)) or "0", 2).to_bytes(max(1, (len(b) + 7) // 8)).replace(b"\xff", b"\xff\x00")
    scan = b"".join(pack(p) + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2) + b
    dht = seg(0xC4, bytes([0, 0, 0, 7, *[0] * 13, *range(7)])) + seg(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    frame = seg(0xC0, bytes([8, 0, 8, 0, 8 * len(dcs), 1, 1, 0x11, 0]))
    return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8]) * 64) + frame + dht + (seg(0xDD, restart.to_bytes(2)) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_foreign_files(restart):
    dcs = [10, -20, 30, 30, 0]
    found = media.decode_jpeg(foreign_jpeg(dcs, restart))
    assert found["thumbnail"].tolist() == [[128 + x for x in dcs]] and (found["width"], found["height"]) == (40, 8) and found["payload"] is None


def test_media_columns(spark, edge_docs, no_docs):
    rows = {(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()}
    got = media.read_media(media.store_texts(edge_docs)).collect()
    want = set()
    for i, t in rows:
        p = media.pad((t or "").encode())
        want.add((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got} == want
    assert all(r["error"] is None and r["media_sha256"] for r in got)
    assert media.read_media(media.store_texts(no_docs)).count() == 0
    bad = spark.createDataFrame([(1, 1, None), (2, 1, bytearray(b"GIF89a")), (3, 1, bytearray(b"\xff\xd8\xff\xda"))], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] and r["feature"] is None for r in media.read_media(bad).collect())


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("most_broadcast", [0, 1000])
def test_archives(spark, most_broadcast):
    big = "<html>" + "x" * 200
    rows = [(5, "http://a", big), (3, None, big), (9, "http://c\r\nX: y", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (None, "n", big), (7, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", "é" * 60), (3, "u", "other" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, file_bytes=300, most_broadcast=most_broadcast)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, folder).collect())
    want = [("1", 5, "response", None), ("2", 5, "response", None), ("3", 206, "response", None), ("3", 250, "response", None), ("4", 0, "response", None), ("5", 206, "revisit", 3)]
    want += [("7", 120, "response", None), ("7", 120, "response", None), ("8", 120, "revisit", 7), ("9", 206, "revisit", 3), ("None", 206, "revisit", 3)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive(pages.limit(0)).count() == 0


def test_a_revisit_needs_its_response(spark):
    folder = shared_path(spark, "warc-lost")
    record = warc._member(warc._record(7, "u", b"y" * 300, hashlib.sha256(b"y" * 300).hexdigest(), 3))
    warc.put_file(f"{folder}/warc", "pages-0.warc.gz", record)
    spark.createDataFrame([("pages-0.warc.gz", 1, len(record))], "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    with pytest.raises(Exception, match="lacks its response"):
        warc.read_archives(spark, folder).collect()


# ---------------------------------------------------------------- pivots


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 5), st.sampled_from([6, 10**4, 2**40]), st.integers(1, 4))
def test_block_top_k_is_brute_force(seed, n, k, size, n_blocks):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-size, size + 1, (n, 4)).astype(float)
    ids = rnd.permutation(n * 2)[:n]
    pivots_ = pivots.far_pivots(x, 3)
    top = float((x * x).sum(axis=1).max())
    q, q_ids = x[:5], ids[:5]
    best = pivots.Best(np.full(len(q), -np.inf), k)
    before, pivots.STEP = pivots.STEP, 7
    got = []
    for part in np.array_split(np.arange(n), n_blocks):  # thresholds go from block to block
        if len(part):
            got += pivots.block_top_k(q_ids, q, pivots.to_pivots(q, pivots_), ids[part], x[part], pivots.to_pivots(x[part], pivots_, top), top, best)
    pivots.STEP = before
    want = []
    exact = [[int(v) for v in row] for row in x]
    for i in range(min(5, n)):
        s = sorted((-sum(a * b for a, b in zip(exact[i], exact[j])), int(ids[j])) for j in range(n) if j != i)[:k]
        want += [(int(ids[i]), j, -v) for v, j in s]
    ranked = []
    for i in q_ids.tolist():
        ranked += [(i, j, v) for v, j in sorted(((-v, j) for a, j, v in got if a == i))[:k]]
    assert [(a, j, -v) for a, j, v in ranked] == want


def test_clusters_are_left_out_unseen():
    """Where vectors have clusters, most candidates are never evaluated; far pivots find the clusters."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(8, 16)) * 60
    x = np.floor(centres[rnd.integers(0, 8, 4000)] + rnd.normal(size=(4000, 16)) * 3)
    x *= (1000 / np.linalg.norm(x, axis=1))[:, None]
    x = np.floor(x)
    pivots_, top, ids = pivots.far_pivots(x[:500], 16), float((x * x).sum(axis=1).max()), np.arange(4000)
    q = x[:20]
    best = pivots.Best(np.full(20, -np.inf), 10)
    got = pivots.block_top_k(ids[:20], q, pivots.to_pivots(q, pivots_), ids, x, pivots.to_pivots(x, pivots_, top), top, best)
    scores = (q @ x.T).astype(int)
    for i in range(20):
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if j != i)[:10]
        assert sorted((-s, j) for a, j, s in got if a == i)[:10] == want
    assert best.evaluated < 0.5 * best.met


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, None), (3, [1.0, None]), (4, []), (5, [0.5, 0.5]), (6, [float("inf"), 0.0]), (7, [1.0]), (8, [-1.0, 0.3])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    got = [tuple(r) for r in pivots.top_k(v, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 64 * 32 + 128 * 32), (0, 2, 8, -64 * 64 + 128 * 19)]
    assert pivots.top_k(v.limit(0), F.col("vec_id") == 0).count() == 0


# ---------------------------------------------------------------- quality


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n > 0.95
    rows = quality.classify(docs, labels.where("doc_id < 0")).select("score").distinct().collect()
    assert [r["score"] for r in rows] == [0.5]
    # what held-out labels say changes nothing
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.classify(docs, labels), quality.classify(docs, flipped)
    assert a.join(b.select("doc_id", F.col("score").alias("s")), "doc_id").where("score <> s").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "The", "THE", "42", "a1!", "é", "ÉÀ", "x", "--", "\n", "word word"]), max_size=20).map(" ".join))
def test_features_are_brute_force(text):
    places, values = quality.features(np.frombuffer(text.encode(), np.uint8), 18)
    assert dict(zip(places.tolist(), values.tolist())) == pytest.approx(brute.quality_features(text, 18), rel=1e-6)


def test_training_and_scores_are_brute_force(spark):
    """Weights of every coordinate, and the score of every document, from plain loops."""
    settings_ = quality.Settings(max_rows=12, epochs=3)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.training_rows(docs, labels, settings_)
    assert len(rows) == 12
    weights, bias = quality.train(rows, settings_)
    shuffle = np.random.default_rng(7)
    orders = [range(12), *(shuffle.permutation(12).tolist() for _ in range(2))]
    plain = [(dict(zip(p.tolist(), v.astype(float).tolist())), y) for p, v, y in rows]
    want, want_bias = brute.follow_the_leader(plain, orders, settings_.alpha, settings_.beta, settings_.l1, settings_.l2)
    assert bias == pytest.approx(want_bias, rel=1e-6)
    assert {i: w for i, w in enumerate(weights.tolist()) if w} == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-4, abs=1e-7)
    got = {r["doc_id"]: r for r in quality.score(docs, weights, bias, settings_.bits).collect()}
    good = {r["doc_id"] for r in quality.keep_good(docs, weights, bias, settings_).collect()}
    for r in docs.limit(40).collect():
        x = sum(want.get(i, 0.0) * v for i, v in brute.quality_features(r["text"], settings_.bits).items()) + want_bias
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-4)
        assert g["predicted"] == (g["score"] >= 0.5) == (r["doc_id"] in good)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (6, None), (9, 0), (None, 1), (8, 7)], "doc_id long, quality int")
    got = quality.classify(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(no_docs, labels).count() == 0


def test_bound_on_training_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert len(quality.training_rows(docs, labels, quality.Settings(max_rows=7))) == 7
    some = quality.training_rows(docs, labels, quality.Settings(max_values=5000))
    assert 0 < len(some) < 50 and sum(len(p) for p, _, _ in some) <= 5000
    assert quality.training_rows(docs, labels, quality.Settings(max_values=0)) == []


# ---------------------------------------------------------------- mixing


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_raked_margins(seed):
    rnd = np.random.default_rng(seed)
    cells = [(s, x, t) for s in "ab" for x in "cd" for t in "ef"]
    tokens = rnd.integers(1, 100, len(cells)).astype(float)
    targets = [dict(zip(k, v)) for k, v in zip(("ab", "cd", "ef"), rnd.dirichlet([2, 2], 3))]
    w = mixing.rake(tokens, cells, targets)
    for m, t in enumerate(targets):
        for name, share in t.items():
            assert sum(x for x, c in zip(w, cells) if c[m] == name) == pytest.approx(share, abs=1e-6)
    p = mixing.calibrate(tokens, w, 0.5)
    assert (p <= 1).all() and (p * tokens).sum() == pytest.approx(0.5 * tokens.sum(), rel=1e-6)


def test_mix_is_brute_force(spark, edge_docs, no_docs):
    targets = mixing.Targets(given={"lang": {"en": 0.5, "(null)": 0.5}}, keep=0.6)
    got = mixing.mix(edge_docs, targets).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        t = r["text"] or ""
        digest = hashlib.md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        assert r["draw"] == pytest.approx(int(digest[:12], 16) / 2**48, abs=1e-12)
        assert r["kept"] == (r["draw"] < r["probability"])
        assert r["n_tokens"] == len(t.encode().split())
    assert mixing.mix(no_docs, targets).count() == 0
    many = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), mixing.Targets(most_values=3))
    assert many.where("probability IS NULL").count() == 0


def test_probabilities_are_brute_force(spark):
    """Raked in plain loops, where no cell is asked for more than it has."""
    rows = [(i, f"{'12 ' * (i % 4)}{'some words here ' * (5 + i % 9)}{'| ' * (i % 3)}", ["en", "fr", "de", "xx"][i * 7 % 4], f"s{i * i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = mixing.Targets(given={"lang": {"en": 0.5, "fr": 0.2}}, keep=0.15)
    got = {r["doc_id"]: r["probability"] for r in mixing.mix(docs, targets).collect()}
    want = brute.raked([(s_, g, t) for _, t, g, s_ in rows], targets.given, targets.power, targets.keep)
    assert max(want) < 1
    assert [got[i] for i in range(300)] == pytest.approx(want, rel=1e-4)


def test_mixture_meets_its_targets(spark):
    """The registered mixture asks for more of the rare languages than four fifths of the tokens would hold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.achieved(docs, queries.MIXTURE)
    assert {v: x for m, v, x, _ in found if m == "lang"} == pytest.approx({"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2})
    assert all(x == pytest.approx(y, abs=1e-6 if m == "lang" else 1e-4) for m, _, x, y in found)
    rows = mixing.mix(docs, queries.MIXTURE).collect()
    kept = [r for r in rows if r["kept"]]
    total = sum(r["n_tokens"] for r in kept)
    assert 0.2 < total / sum(r["n_tokens"] for r in rows) <= 0.8 and all(0 <= r["probability"] <= 1 for r in rows)
    for lang, share in queries.MIXTURE.given["lang"].items():
        assert sum(r["n_tokens"] for r in kept if r["lang"] == lang) / total == pytest.approx(share, abs=0.05)


@pytest.mark.parametrize("seed", range(6))
def test_caps_leave_given_shares(seed):
    """Cells of any size, some missing; two margins given: shares fit, and no cell gives more than it has."""
    rnd = np.random.default_rng(seed)
    keys = [(s, x, t) for s in "abc" for x in "de" for t in "fgh" if (s, x) != ("a", "e")]
    tokens = np.floor(10 ** rnd.uniform(0, 5, len(keys)))
    t = mixing.Targets(given={"lang": {"d": 0.7, "e": 0.3}, "topic": {"f": 0.5, "g": 0.25, "h": 0.25}})
    p = mixing.probabilities(keys, tokens, t)
    assert (p >= 0).all() and (p <= 1).all() and p.max() > 0
    for m, given_ in ((1, t.given["lang"]), (2, t.given["topic"])):
        for v, share in given_.items():
            assert (tokens * p)[[k[m] == v for k in keys]].sum() / (tokens * p).sum() == pytest.approx(share, abs=1e-5)


def test_mixture_keeps_languages_without_a_share(spark):
    """Null and unlisted languages get shares of their own beside the given ones, also where no listed one occurs."""
    rows = [(i, f"some words of text {i} " * 5, (["en"] * 6 + ["fr", "de", "es", None, "it", "pl"])[i % 12], f"s{i % 2}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {v: (x, y) for m, v, x, y in mixing.achieved(docs, queries.MIXTURE) if m == "lang"}
    own = (1 / 12) ** queries.MIXTURE.power
    for v in found:
        share = queries.MIXTURE.given["lang"].get(v, own) / (1 + 3 * own)
        assert found[v] == (pytest.approx(share, rel=1e-2), pytest.approx(share, rel=1e-2))
    kept = {r["lang"] for r in mixing.mix(docs, queries.MIXTURE).where("kept").select("lang").distinct().collect()}
    assert kept == {"en", "fr", "de", "es", None, "it", "pl"}
    unlisted = mixing.mix(docs.where("lang IS NULL OR lang IN ('it', 'pl')"), queries.MIXTURE)
    assert {r["lang"] for r in unlisted.where("kept").collect()} == {None, "it", "pl"}


def test_every_source_has_its_own_target(spark):
    """More values than most_values: each source and each given language has its share, on the driver or not."""
    rows = [(i, "w " * (1 + i % 7 + (50 if i % 100 < 20 else 0)), f"l{i % 90}", f"s{i % 100}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tempered = mixing.achieved(docs, mixing.Targets(keep=0.3))
    own = {f"s{k}": sum(len(r[1].split()) for r in rows if r[3] == f"s{k}") ** 0.7 for k in range(100)}
    assert {v: y for m, v, _, y in tempered if m == "source"} == pytest.approx({v: n / sum(own.values()) for v, n in own.items()}, rel=1e-3)
    given_ = {"lang": {f"l{k}": 1 / 90 for k in range(90)}}
    langs = [y for m, _, _, y in mixing.achieved(docs, mixing.Targets(given=given_, keep=0.3)) if m == "lang"]
    assert langs == pytest.approx([1 / 90] * 90, rel=1e-4)


def test_wide_is_the_same(spark):
    rnd = np.random.default_rng(5)
    keys = [(s, x, t) for s in "abcdefgh" for x in "xyz" for t in "pq"]
    tokens = np.floor(10 ** rnd.uniform(1, 3, len(keys)))
    cells = spark.createDataFrame([(*k, float(n)) for k, n in zip(keys, tokens)], "__source string, __lang string, __topic string, tokens double")
    t = mixing.Targets(given={"lang": {"x": 0.3, "y": 0.3}}, keep=0.5)
    got = {tuple(r)[:3]: r["probability"] for r in mixing.fit_wide(cells, t).collect()}
    assert [got[k] for k in keys] == pytest.approx(mixing.probabilities(keys, tokens, t).tolist(), abs=1e-2)


def test_mix_is_the_same_at_any_size(spark):
    """The number of cells decides where they are raked, not what comes out: equal to the bit, with cells at probability 1."""
    rows = [(i, f"{'12 ' * (40 * (i % 10 == 0))}{'some words here ' * (i % 7)}", ["en", "en", "fr", "de", None, "xx"][i * 7 % 6], f"s{i * i % 5}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given_ = {"lang": {"en": 0.3, "fr": 0.3, "xx": 0.0, "none": 1.0}}
    here, wide = (mixing.mix(docs, mixing.Targets(given=given_, power=0.6, keep=0.9, most_values=n)) for n in (64, 2))
    here, wide = ({r["doc_id"]: r for r in rows.collect()} for rows in (here, wide))
    assert here == wide
    p = [r["probability"] for r in here.values()]
    assert max(p) == 1 and 0 in p and len(set(p)) == 5
    assert {r["lang"] for r in here.values() if r["kept"]} == {"en", "fr", "de", None}


@pytest.mark.parametrize("seed", range(4))
def test_capped_probabilities_are_brute_force(seed):
    """Cells that reach probability 1, against factors found one by one; the order of cells doesn't matter to a bit."""
    rnd = np.random.default_rng(seed)
    keys = [(s, x, t) for s in "abc" for x in "de" for t in "fg"]
    tokens = np.floor(10 ** rnd.uniform(1, 2, len(keys)))
    t = mixing.Targets(given={"lang": {"d": 0.5, "e": 0.5}}, keep=0.7)
    p = mixing.probabilities(keys, tokens, t)
    some = rnd.permutation(len(keys))
    assert mixing.probabilities([keys[i] for i in some], tokens[some], t).tolist() == p[some].tolist()
    total, targets = mixing.margin_targets(keys, tokens, t)
    want = brute.capped(dict(zip(keys, tokens)), targets, total, 60)
    assert p == pytest.approx([want[k] for k in keys], abs=1e-5)


# ---------------------------------------------------------------- queries, pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    same_as_sql(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark):
    """Each stage against what it should keep; the last against the library."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    done = []
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF).cache()
        done.append({r["doc_id"]: r for r in out.collect()})
        docs = out
    text = lambda rows: [(i, r["text"]) for i, r in sorted(rows.items())]
    first, second, third, fourth, last = done
    assert all(list(next(iter(d.values())).asDict()) == list(C.COLUMNS) for d in done[:4])
    kept = [labels[i] for i in labels if i in first]
    assert sum(kept) / len(kept) > 0.95 and sum(labels.values()) - sum(kept) <= 0.05 * len(labels)
    classes = brute.near(text(first))
    assert set(second) == {c for _, c in classes}
    assert all(second[i]["text"] == (first[i]["text"] or "") for i in second)
    rows = text(second)
    cuts = brute.suffix(rows, keep_first=True)
    for (i, _), cut, kept_bytes in zip(rows, cuts, brute.suffix_kept(rows, keep_first=True)):
        want = kept_bytes.decode("utf-8", "ignore")
        if i in third:
            assert third[i]["text"] == want and third[i]["n_chars"] == len(want)
        else:
            assert cut[1] and not want.strip(" ")
    assert set(fourth) <= set(third) and set(last) == set(fourth)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    for i, r in last.items():
        ids = library.encode(fourth[i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    again = {r["doc_id"]: r["ids_sha256"] for r in C.run(spark, SF).collect()}
    assert again == {i: r["ids_sha256"] for i, r in last.items()}
