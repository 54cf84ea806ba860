import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import exact, repeats
from lodestar.llm.suffix import Suffixes, longest_factors, longest_previous_factor, smaller_before


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=80).map(str.encode))
def test_longest_previous_factor(data):
    want = []
    for i in range(len(data)):
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(data) and data[j + n] == data[i + n]:
                n += 1
            best = max(best, n)
        want.append(best)
    assert longest_previous_factor(data).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40))
def test_smaller_neighbours(pairs):
    v, shared = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    to, least = smaller_before(v, shared)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
    assert to.tolist() == want
    assert least.tolist() == [min(shared[j + 1 : i + 1]) if j >= 0 else 0 for i, j in enumerate(want)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("ab\0", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=5), st.data())
def test_factors_of_several_strings(texts, data):
    whole = b"".join(texts)
    room = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
    at = np.array(sorted(data.draw(st.sets(st.integers(0, len(whole) - 1)))), np.int64)
    previous, following = longest_factors(Suffixes(np.frombuffer(whole, np.uint8), room, 100), at)

    def shared(i, j):
        n = 0
        while n < min(room[i], room[j]) and whole[i + n] == whole[j + n]:
            n += 1
        return n

    assert previous.tolist() == [max((shared(i, j) for j in at if j < i), default=0) for i in at]
    assert following.tolist() == [max((shared(i, j) for j in at if j > i), default=0) for i in at]


def test_both_neighbours_decide(monkeypatch):
    """In the buckets of a corpus, some matches are with the previous smaller position and some with the next one only."""
    seen = {"before": 0, "after": 0}
    whole = (b"abcdefgh" * 6 + b"1") + (b"abcdefgh" * 6 + b"2") + b"zz" + (b"abcdefgh" * 6 + b"0")
    n = len(whole)
    s = Suffixes(np.frombuffer(whole, np.uint8), n - np.arange(n), n)
    order = np.argsort(s.levels[-1][1])
    shared = np.append(0, s.shared(order[1:], order[:-1]))
    _, before = smaller_before(order, shared)
    _, after = smaller_before(order[::-1], np.append(shared[1:], 0)[::-1])
    after = after[::-1]
    seen["before"], seen["after"] = int((before > after).sum()), int((after > before).sum())
    assert min(seen.values()) > 0


def corpus(seed, n=60):
    """Documents with shared passages, near copies, repeats within, hot copies and low complexity."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [text(70) for _ in range(4)]
    out = []
    for i in range(n):
        kind = rnd.randint(0, 6)
        if kind == 0:
            t = passages[0]
        elif kind == 1:
            t = text(rnd.randint(0, 60)) + " " + rnd.choice(passages) + "\n" + text(rnd.randint(0, 60))
        elif kind == 2:
            p = rnd.choice(passages).split()
            p[rnd.randrange(len(p))] = "changed"
            t = " ".join(p)
        elif kind == 3:
            t = (rnd.choice(words) + " ") * rnd.randint(1, 300)
        elif kind == 4:
            t = passages[1] + " " + passages[1][:-3] + text(5)
        else:
            t = text(rnd.randint(0, 200))
        out.append((i * 3, t))
    rnd.shuffle(out)
    return out


def check(spark, monkeypatch, rows, f, brute_f, columns, **options):
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, gid string")
    got = sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in f(df, **options).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute_f(rows)))


SUFFIX, WINDOWS = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), ("n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup(spark, monkeypatch, small, keep_first):
    limits = {}
    if small:  # many buckets and batches, hot minimisers, super-k-mers in pieces
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
        limits = {"batch_bytes": 500, "hot": 3, "most_windows": 50}
    rows = corpus(1)
    check(spark, monkeypatch, rows, exact.suffix_dedup, lambda r: brute.suffix(r, keep_first=keep_first), SUFFIX, keep_first=keep_first, **limits)


@pytest.mark.parametrize("seed", [2, 3])
def test_window_dedup(spark, monkeypatch, seed):
    check(spark, monkeypatch, corpus(seed), exact.window_dedup, brute.windows, WINDOWS, batch_bytes=3000, **({"hot": 2, "most_windows": 7} if seed == 3 else {}))


def test_runs_and_periods(spark, monkeypatch):
    """Runs of a byte, short periods and repeated words, within and across documents; long ones in several pieces."""
    rows = [(1, "x" * 200), (2, "y" * 201), (3, "a" + "x" * 1000 + "b"), (4, "ab" * 300), (5, "z" + "ba" * 120), (6, "abc" * 67 + "q"), (7, "w " * 21), (8, "w w v " * 30), (9, "v w w " * 9)]
    for keep_first in (False, True):
        check(spark, monkeypatch, rows, exact.suffix_dedup, lambda r: brute.suffix(r, keep_first=keep_first), SUFFIX, keep_first=keep_first, most_windows=128, hot=3 if keep_first else 1000)
    check(spark, monkeypatch, rows, exact.window_dedup, brute.windows, WINDOWS, most_windows=5)


def test_a_run_is_few_strings():
    n = 1 << 20
    chunk = repeats.Chunk(0, np.array([1]), np.array([n]), np.full(n, 120, np.uint8))
    units = repeats.Units(False, 200, 32)
    s = repeats.segments(chunk, units)
    assert int(s.count.sum()) == n - 199 and len(s.first) <= n // repeats.MOST_WINDOWS + 1
    strings = set(s.texts(chunk.data.tobytes(), np.arange(len(s.first))))
    assert sum(map(len, strings)) < 1 << 16


def test_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    got = exact.suffix_dedup(edge_docs, keep_first=False).collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in SUFFIX]) for r in got) == sorted((str(i), *x) for (i, _), x in zip(rows, brute.suffix(rows)))
    got = exact.window_dedup(edge_docs).collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in WINDOWS]) for r in got) == sorted((str(i), *x) for (i, _), x in zip(rows, brute.windows(rows)))
    assert exact.suffix_dedup(no_docs).count() == 0 and exact.window_dedup(no_docs).count() == 0


def test_kept_text_and_carried_columns(spark, edge_docs):
    got = exact.suffix_dedup(edge_docs, carry=("lang", "source")).collect()
    want = {(r["doc_id"], r["lang"], r["source"]) for r in edge_docs.collect()}
    assert {(r["doc_id"], r["lang"], r["source"]) for r in got} == want
    assert {r["text"] for r in got if r["doc_id"] == 5} == {"one two three"}
    assert next(r["text"] for r in got if r["doc_id"] == 10) != "é" * 300


def test_minimisers_fall_into_all_buckets():
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 123, 1 << 16).astype(np.uint8)
    s = repeats.segments(repeats.Chunk(0, np.array([1]), np.array([len(data)]), data), repeats.Units(False, 200, 32))
    for buckets in (8, 64, 206):
        _, _, borders = repeats._sent_minimisers(s, buckets)
        sizes = np.diff(borders)
        assert sizes.min() > 0 or buckets > 64
        assert sizes.max() < 4 * len(s.first) / buckets + 20
