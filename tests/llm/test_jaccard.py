import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_exact import corpus

from lodestar.llm import jaccard
from lodestar.llm.common import word_hashes
from lodestar.llm.graph import components


def same(df, rows, **options):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(df, **options).collect())
    assert got == sorted((str(i), n, str(c)) for (i, _), (n, c) in zip(rows, brute.near(rows)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force(spark):
    rows = corpus(5, 120)
    same(frame(spark, rows), rows)
    same(frame(spark, rows), rows, block_sets=3)  # groups in many blocks


def test_chain_of_links(spark):
    """Neighbours are similar, ends aren't; one class all the same."""
    w = [f"w{i}" for i in range(140)]
    rows = [(50 - k, " ".join(w[k * 4 : k * 4 + 60])) for k in range(12)]
    assert len({c for _, c in brute.near(rows)}) == 1
    same(frame(spark, rows), rows)


def near_copies(n, seed=1):
    """Large groups of near copies, of which some are only linked through others, and chance meetings of others."""
    rnd = random.Random(seed)
    out = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(90)]
        for k in range(n):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 3])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(6)}"
            out.append((rnd.randrange(10**6), " ".join(w)))
    common = " ".join(f"common{i}" for i in range(12))
    for k in range(n):  # sets of several classes that share shingles of their prefix
        out.append((rnd.randrange(10**6), common + " " + " ".join(f"o{k % (n // 2)}v{i}" for i in range(8)) + f" end{k}"))
    return out


@pytest.mark.parametrize("block_sets", [5, 16, 1000])
def test_large_groups_in_blocks(spark, block_sets):
    rows = near_copies(40)
    same(frame(spark, rows), rows, block_sets=block_sets)


def test_words_of_one_structure_are_different(spark):
    """Strings that collide under every polynomial hash modulo a power of two."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue + " x"), (2, other + " x"), (3, thue + " x"), (4, "abababab"), (5, "babababa"), (6, "a" * 64), (7, "a" * 65), (8, "a" * 72)]
    same(frame(spark, rows), rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=30))
def test_word_hashes_depend_on_the_bytes_alone(words):
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    got = word_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    assert len(set(got.tolist())) == len(set(words))
    for w, h in zip(words, got):
        assert word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] == h


def test_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    got = {(str(r["doc_id"]), r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(edge_docs).collect()}
    assert got["0", 0] == 0 and got["1", 0] == 1 and got["2", 0] == 2
    assert got["7", 1] == 6  # case doesn't count
    assert got["100", 1] == 9 and got["None", 1] == 5
    assert jaccard.near_duplicates(edge_docs).count() == len(rows)
    assert jaccard.near_duplicates(no_docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1), min_size=2, max_size=12, unique=True), st.sampled_from([50, 75, 90]))
def test_tree_finds_all_similar_sets(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    tree = jaccard.PrefixTree([a.astype(np.int64) for a in arrays])
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(s & t) >= percent * len(s | t)}
        assert set(tree.walk(i, percent).tolist()) == want
    forest = jaccard.Forest(len(sets))
    classes = [np.array([x % 3 for x in sorted(s)], np.uint8) for s in sets]
    for i, j in jaccard.tree_join(arrays, classes, percent):
        forest.join(i, j)
    other = jaccard.Forest(len(sets))
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            if 100 * len(s & t) >= percent * len(s | t):
                other.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [other.root(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(31), 100], 0), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_packed_without_loss():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 33, 500).astype(np.uint64))
    assert (jaccard._unsqueeze(jaccard._squeeze(v)) == v).all()
    assert len(jaccard._unsqueeze(jaccard._squeeze(v[:0]))) == 0
