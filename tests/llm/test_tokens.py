import hashlib
import json
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import bpe, tokenfiles
from lodestar.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def own():
    return bpe.load(tokenizer_file())


def ids(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


alphabet = st.sampled_from(list("ab é\n\t'sdtZ9!<|日 \x1c\x85\0") + [" the", "  ", "ing", "\n\n", "<|endoftext|>", "'ll"])


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, max_size=40).map("".join))
def test_ids_and_text_are_the_librarys(library, own, text):
    want = ids(library, text)
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    assert [x.tolist() for x in tokenfiles.encoder(tokenizer_file()).encode_batch(pa.array([text, "and " + text]))] == [want, ids(library, "and " + text)]


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 5000, "=-" * 4000, "the" * 3000, "é" * 2000, " " * 3000])
def test_long_pieces_stream_in_bounded_memory(library, own, text):
    assert own.encode(text) == ids(library, text)
    raw = text.encode()
    if not text.isspace():
        for step in (1, 7, 4096):  # tokens don't depend on how bytes arrive
            assert list(own.transduce(raw[k : k + step] for k in range(0, 3000, step))) == list(own.transduce([raw[: -(-3000 // step) * step]]))


def test_tokens_leave_before_the_end(own):
    given_ = 0

    def stream():
        nonlocal given_
        for _ in range(200):
            given_ += 64
            yield b"ab" * 32

    first = next(own.transduce(stream()))
    assert first >= 0 and given_ < 200 * 64 and own.lookahead >= own.longest


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet | st.sampled_from(["<|endo", "'re", "   ", "x" * 20, "\n" * 20, "!" * 18]), max_size=40).map("".join), st.sampled_from([1, 3, 20]), st.sampled_from([4, 60]))
def test_blocks_of_any_size(library, own, text, step, block):
    before, bpe.BLOCK = bpe.BLOCK, block
    try:
        got = [int(i) for part in own.encode_blocks(bpe.blocks_of(np.frombuffer(text.encode(), np.uint8), step)) for i in part]
    finally:
        bpe.BLOCK = before
    assert got == ids(library, text)


def test_every_piece_goes_through_the_transducer(library):
    fresh, calls = bpe.Bpe(tokenizer_file()), []
    plain = fresh.transduce
    fresh.transduce = lambda stream: calls.append(1) or plain(stream)
    texts = ["some words, and some words again", "x" * 5000, "12 34\n"]
    assert [fresh.encode(t) for t in texts] == [ids(library, t) for t in texts]
    assert len(calls) == len({w for t in texts for w in fresh.splitter.findall(t)})


def test_memory_is_flat_in_the_length_of_a_text(own):
    prose = ("The quick brown fox, and 12 others - jumped over\n" * 3000).encode()
    peaks = []
    for n in (1, 8):
        raw = np.resize(np.frombuffer(prose, np.uint8), n << 20)
        tracemalloc.start()
        bpe._digest(own, raw)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (1 << 20)


def test_unbroken_text_in_linear_time(own):
    letters = np.random.default_rng(1).integers(97, 123, 1 << 18).astype(np.uint8)
    begin = time.perf_counter()
    assert bpe._digest(own, letters)[0] > 1 << 16
    assert time.perf_counter() - begin < 8


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(tokenizer_file(), encoding="utf-8"))
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {**spec["pre_tokenizer"], "add_prefix_space": True})):
        path = tmp_path / "file.json"
        path.write_text(json.dumps({**spec, key: value}), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Bpe(str(path))


def test_digests(spark, library, edge_docs, no_docs):
    texts = [r["text"] for r in edge_docs.select("text").collect()]
    want = []
    for t in texts:
        i = ids(library, t)
        want.append((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.tokenizer_digests(edge_docs, tokenizer_file()).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert bpe.tokenizer_digests(no_docs, tokenizer_file()).count() == 0
    assert sorted(r["ids"] for r in bpe.token_ids(edge_docs, tokenizer_file()).collect()) == sorted(ids(library, t) for t in texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_shard_round_trip_and_random_access(values, start, n):
    v = np.array(values, np.uint32)
    shard = tokenfiles.Shard(tokenfiles.pack(v, np.array([7]), np.array([len(v)]), 6))
    assert shard.ids().tolist() == values
    assert shard.read(start, n).tolist() == values[start : start + n]
    before, tokenfiles.READ_IDS = tokenfiles.READ_IDS, 1 + start % 50
    assert shard.documents() == ([len(values)], [zlib.crc32(v.astype("<u4").tobytes())] if values else [])
    tokenfiles.READ_IDS = before


def pairs(symbols):
    """How often each pair occurs without overlap."""
    counts, at = Counter(), {}
    for i, p in enumerate(zip(symbols, symbols[1:])):
        if at.get(p) != i - 1 or p[0] != p[1]:
            counts[p] += 1
            at[p] = i
    return counts


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 30), st.integers(0, 3000))
def test_no_frequent_pair_is_left(seed, kinds, n):
    rnd = random.Random(seed)
    words = [[rnd.randrange(kinds) for _ in range(rnd.randint(1, 6))] for _ in range(8)]
    ids_ = [i for _ in range(n // 4) for i in (rnd.choice(words) if rnd.random() < 0.8 else [rnd.randrange(kinds)] * rnd.randint(1, 9))]
    for base in (kinds, 70_000):  # keys of 32 and of 64 bits
        symbols, rules = tokenfiles.compress(np.array(ids_, np.int64), base)
        lengths = tokenfiles.expansions(rules, base)
        assert tokenfiles.expand(symbols, rules, lengths, base).tolist() == ids_
        assert max(pairs(symbols.tolist()).values(), default=0) < tokenfiles.LEAST
        assert len(symbols) + (tokenfiles.LEAST - 1) * len(rules) <= len(ids_)  # each rule is used that often


def test_repair_shrinks_what_repeats():
    rnd = random.Random(0)
    piece = [rnd.randrange(50000) for _ in range(500)]
    v = np.array(piece * 100, np.uint32)
    body = tokenfiles.pack(v, np.array([0]), np.array([len(v)]), 50257)
    shard = tokenfiles.Shard(body)
    assert len(body) < len(v) and (shard.ids() == v).all() and (shard.read(30_000, 5000) == v[30_000:35_000]).all()
    with pytest.raises(ValueError):
        tokenfiles.Shard(body[:100] + bytes([body[100] ^ 1]) + body[101:])


def check_files(rows, library, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    start, want = 0, []
    for i, t in sorted(rows, key=key):
        own = [*ids(library, t), 2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files(spark, library, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_IDS", 1000)
    for df in (edge_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        check_files(rows, library, [tuple(r) for r in tokenfiles.token_files(df, tokenizer_file()).collect()])
    assert tokenfiles.token_files(no_docs, tokenizer_file()).count() == 0
