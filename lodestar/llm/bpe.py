"""Byte-level BPE as a streaming transducer, and decoding as a byte-to-text state machine.

Encoding reads bytes from left to right and keeps, for each prefix of a pre-token, the last token of that prefix's
encoding. An automaton of all tokens tells which of them end at a byte; one may follow another if no merge across their
border would have come before both were complete; just one token can end each prefix. Later bytes can only continue from
the last ``longest`` prefixes, so tokens up to the common ancestor of these are stable and leave at once. The merge list
gives a sufficient lookahead: a rule needs the bytes of its product to the right of where the earlier rules have looked, so
the sum of the products' lengths always suffices. The transducer looks for stable tokens ever more rarely while there are
none, but at the latest when it holds so many bytes (in practice a few tokens).

Texts arrive in blocks. A block is cut where a pre-token surely begins; a pre-token that goes on is passed to the
transducer part by part, so memory doesn't grow with a text or a word. What the transducer gave for short pieces is
remembered, up to a bound.

Texts are null (taken as empty), empty or of any length; ids are those of the tokenizers library without added special
tokens, though strings of special tokens in a text become their ids, as they do there. Files whose normalizer or
pre-tokenizer is another one are refused.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.common import clean_docs, text_column

#: Fixed values of the file format: how byte-level files split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the memories of pieces (and words in them) and of pairs of tokens; each starts anew when it is full.
MEMORY, PAIRS = 500_000, 1_000_000
#: Longer pieces are encoded as they come and not remembered.
REMEMBERED = 48
#: Bytes of a text that are decoded at a time, and the ids of a long pre-token.
BLOCK = 1 << 16

#: White space next to white space (or at an end) joins tokens across a single blank; these separators differ between regex engines.
_RUN = re.compile(r"\s\s+")
_ODD = re.compile("[\0\x1c-\x1f\x85᠎​﻿]")


#: What a pre-token goes on with; white space last.
_KINDS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def independent_pieces(text: str) -> list[str] | None:
    """Pieces that encode on their own to the text's ids, cut before blanks; None if the text has to be split by rule."""
    if _ODD.search(text):
        return None
    if not _RUN.search(text) and not text[:1].isspace() and not text[-1:].isspace():
        return _cut(text) if text else []
    out: list[str] = []
    at, lead = 0, ""
    for run in _RUN.finditer(text + "\0"):  # the sentinel keeps white space at the end from looking like a separator
        body = lead + text[at : run.start()]
        out += _words(body)
        at = run.end()
        space = run.group()
        if at >= len(text):
            out.append(space)
            return [x for x in out if x]
        out.append(space[:-1])
        lead = space[-1]
    body = lead + text[at:]
    if body and body[-1].isspace():
        out += _words(body[:-1])
        out.append(body[-1])
    else:
        out += _words(body)
    return [x for x in out if x]


def _cut(text: str) -> list[str]:
    """Cuts before single blanks and around single line breaks; text has no NUL and no other white space beside them."""
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def _words(body: str) -> list[str]:
    """body has white space only singly, and none at its end; a first blank belongs to the first word."""
    if not body:
        return []
    if body[0].isspace() and body[0] != " ":
        return [body[0], *_words(body[1:])]
    return _cut(body)


def _safe_cut(text: str) -> int:
    """The last place at which a pre-token surely begins, whatever follows text: a single blank between others. Or 0."""
    at = text.rfind(" ", 0, len(text) - 1)
    while at > 0:
        around = text[at - 1] + text[at + 1]
        if not around[0].isspace() and not around[1].isspace() and not _ODD.search(around):
            return at
        at = text.rfind(" ", 0, at)
    return 0


class Source:
    """Text that arrives in blocks: what has come and isn't used yet, and whether that is all."""

    def __init__(self, blocks: Iterable[str]) -> None:
        self.blocks, self.text, self.ended = iter(blocks), "", False

    def more(self) -> bool:
        for block in self.blocks:
            if block:
                self.text += block
                return True
        self.ended = True
        return False


class Parts:
    """The parts of a text between special tokens, one after the other, as blocks."""

    def __init__(self, blocks: Iterable[str], special: regex.Pattern, longest: int) -> None:
        self.blocks, self.special, self.hold, self.text, self.found = iter(blocks), special, longest - 1, "", None

    def part(self) -> Iterator[str]:
        """The blocks up to the next special token, which then is in found (None at the end of the text)."""
        text, self.found = self.text, None
        ended = False
        while True:
            m = self.special.search(text)
            if m and (ended or m.end() + self.hold <= len(text)):
                self.found, self.text = m.group(), text[m.end() :]
                yield text[: m.start()]
                return
            if ended:
                self.text = ""
                yield text
                return
            if not m and len(text) > self.hold:  # a special token may have begun in the end of it
                yield text[: len(text) - self.hold]
                text = text[len(text) - self.hold :]
            block = next(self.blocks, None)
            ended = block is None
            text += block or ""


class Bpe:
    """The merge list of a byte-level tokenizer file, with the transducer and the decoder that it defines."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level files without normalizer and prefix blank")
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(s): i for s, i in model["vocab"].items()}
        if any(bytes([b]) not in vocab for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for b, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = b
        self.lengths = [*map(len, self.bytes_of)]
        self.text_of = [str(i) for i in range(self.size)]
        #: rank, left part and right part of each token; rank -1 for single bytes
        self.rank, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.merge: dict[tuple[int, int], int] = {}
        self.lookahead = 0
        for rank, pair in enumerate(model["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            i = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = rank, vocab[a], vocab[b]
            self.lookahead += len(a) + len(b)
        self.longest = max(map(len, vocab))
        #: all tokens that merges make, as texts of one character a byte
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in vocab.items():
            if len(b) == 1 or self.rank[i] >= 0:
                self.finder.add_word(b.decode("latin-1"), i)
        self.finder.make_automaton()
        self.splitter = regex.compile(SPLIT)
        self.special_splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._follows: dict[int, bool] = {}
        self._memory: dict[str, bytes] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and b's bytes together is just a and b."""
        rank, merge = self.rank, self.merge
        x, y = a, b
        x_until = y_until = len(merge)  # the ranks at which the parts at the border go into larger ones
        fine = True
        while True:
            across = merge.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                fine = False
                break
            if rank[x] < 0 and rank[y] < 0:
                break
            if rank[x] > rank[y]:
                x_until, x = rank[x], self.right[x]
            else:
                y_until, y = rank[y], self.left[y]
        if len(self._follows) > PAIRS:
            self._follows.clear()
        self._follows[a * self.size + b] = fine
        return fine

    def transduce(self, stream: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one pre-token that arrives in parts, each as soon as nothing to come can change it."""
        known, follows, size, lengths = self._follows, self.follows, self.size, self.lengths
        search = self.finder.iter("")
        base = 0  # the last stable border; what follows is about the bytes from there on
        last, back = [-1], [0]  # of each prefix: its last token, and the prefix before that; of the empty one, the last stable token
        read, patience = 0, 4 * self.longest
        for part in stream:
            search.set(part.decode("latin-1"))
            read += len(part)
            for end, token in search:  # all tokens that end at a byte, the longest first
                i = end + 1 - base
                if i < len(last):
                    continue
                j = i - lengths[token]
                if j < 0:
                    continue
                p = last[j]
                if p < 0 or (f if (f := known.get(p * size + token)) is not None else follows(p, token)):
                    last.append(token)
                    back.append(j)
            held = read - base
            if held != len(last) - 1:
                raise ValueError("no token ends here: the merges are not in order")
            if held >= patience:
                stable = self._common(back, held)
                if stable:
                    yield from self._path(last, back, stable)
                    last, back = last[stable:], [0, *(k - stable for k in back[stable + 1 :])]
                    base += stable
                    patience = 4 * self.longest
                elif held > self.lookahead + self.longest:
                    raise ValueError("tokens are not stable after the lookahead")
                else:
                    patience = min(2 * held, self.lookahead + self.longest)
        yield from self._path(last, back, read - base)

    @staticmethod
    def _path(last: list[int], back: list[int], k: int) -> list[int]:
        """The tokens of the prefix of length k."""
        path = []
        while k:
            path.append(last[k])
            k = back[k]
        return path[::-1]

    def _common(self, back: list[int], n: int) -> int:
        """The longest prefix that the encodings of all prefixes within reach of later bytes pass through."""
        live = set(range(max(0, n - self.longest + 1), n + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top])
        return live.pop()

    def _parts(self, word: str) -> Iterator[bytes]:
        """The bytes of a pre-token in parts."""
        for k in range(0, len(word), self.longest):
            yield word[k : k + self.longest].encode()

    def _piece(self, piece: str) -> bytes:
        """The ids of an independent piece as 32-bit integers."""
        out = []
        words = self._memory  # a word is a piece too
        for word in [piece] if piece.isspace() else self.splitter.findall(piece):
            if (got := words.get(word)) is None:
                got = array("I", self.transduce(self._parts(word))).tobytes()
                if len(word) <= REMEMBERED:
                    words[word] = got
            out.append(got)
        return b"".join(out)

    def _pieces(self, pieces: list[str]) -> Iterator[np.ndarray]:
        """The ids of pieces that encode on their own, some thousand at a time."""
        memory = self._memory
        for k in range(0, len(pieces), 8192):
            some = pieces[k : k + 8192]
            if len(memory) > MEMORY:
                memory.clear()
            fresh = set(some).difference(memory)
            memory.update([(x, self._piece(x)) for x in fresh])
            yield np.frombuffer(b"".join(map(memory.__getitem__, some)), np.uint32)
            for x in fresh:
                if len(x) > REMEMBERED:
                    del memory[x]

    def _run(self, source: Source, first: int) -> Iterator[bytes]:
        """The bytes of the pre-token that source begins with and that may go on; first: what is sure of it."""
        text, source.text = source.text[:first], source.text[first:]
        kind = next(k for k in _KINDS if k.fullmatch(text[-1]))
        kept = ""
        while True:
            if kind is _KINDS[-1] and not source.text:  # the last white space before other characters begins the next
                text, kept = text[:-1], text[-1]
            for k in range(0, len(text), BLOCK):
                yield from self._parts(text[k : k + BLOCK])
            if source.text or not source.more():
                break
            n = kind.match(source.text).end()
            if kept and n < len(source.text):  # the white space ends here
                if n:
                    yield kept.encode()
                    yield from self._parts(source.text[: n - 1])
                source.text = source.text[n - 1 :] if n else kept + source.text
                return
            text, source.text = kept + source.text[:n], source.text[n:]
            kept = ""
        if kept:
            yield kept.encode()

    def encode_blocks(self, blocks: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of a text that arrives in blocks, some thousand pieces at a time."""
        if self.special_splitter is None:
            yield from self._plain(Source(blocks))
            return
        parts = Parts(blocks, self.special_splitter, max(map(len, self.special)))
        while True:
            yield from self._plain(Source(parts.part()))
            if parts.found is None:
                return
            yield np.array([self.special[parts.found]], np.uint32)

    def _plain(self, source: Source) -> Iterator[np.ndarray]:
        while True:
            if not source.ended:
                source.more()
            if not source.ended and len(source.text) < max(16, BLOCK // 4):
                continue
            text = source.text
            if not text:
                return
            cut = len(text) if source.ended else _safe_cut(text)
            if cut:
                source.text = text[cut:]
                pieces = independent_pieces(text[:cut])
                yield from self._pieces(self.splitter.findall(text[:cut]) if pieces is None else pieces)
                continue
            # what ends before the last three characters ends there whatever follows ('re may be to come)
            certain = []
            for m in self.splitter.finditer(text):
                if m.end() > len(text) - 3:
                    break
                certain.append(m.group())
            if certain:
                source.text = text[sum(map(len, certain)) :]
                yield from self._pieces(certain)
            else:
                ids = self.transduce(self._run(source, self.splitter.match(text).end()))
                while some := array("I", islice(ids, BLOCK)):
                    yield np.frombuffer(some, np.uint32)

    def encode(self, text: str) -> list[int]:
        return [int(i) for block in self.encode_blocks([text]) for i in block]

    def decode_blocks(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as it becomes certain: bytes of an unfinished character wait for the next ids."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        known = self.bytes_of
        for ids in blocks:
            yield machine.decode(b"".join([known[i] if i < self.size else b"" for i in ids.tolist()]))
        yield machine.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_blocks([np.fromiter(ids, np.int64)]))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def blocks_of(raw: np.ndarray, step: int = BLOCK) -> Iterator[str]:
    """UTF-8 bytes as text, a block at a time."""
    machine = codecs.getincrementaldecoder("utf-8")()
    for k in range(0, len(raw), step):
        yield machine.decode(raw[k : k + step].tobytes(), k + step >= len(raw))


def _digest(bpe: Bpe, raw: np.ndarray) -> tuple[int, str, str]:
    """Count of ids, and the SHA-256 of their decimal list and of the text decoded from them."""
    numbers, texts = hashlib.sha256(), hashlib.sha256()
    count = 0

    def through(blocks: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        nonlocal count
        for ids in blocks:
            if len(ids):
                listed = ",".join(map(bpe.text_of.__getitem__, ids.tolist()))
                numbers.update((("," if count else "") + listed).encode())
                count += len(ids)
                yield ids

    for decoded in bpe.decode_blocks(through(bpe.encode_blocks(blocks_of(raw)))):
        texts.update(decoded.encode())
    return count, numbers.hexdigest(), texts.hexdigest()


def tokenizer_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; path: a byte-level tokenizer file on each machine."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            data, offsets = text_column(batch)
            rows = [_digest(bpe, data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:])]], schema=schema)

    return clean_docs(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            data, offsets = text_column(batch)
            for i in range(batch.num_rows):
                blocks = list(bpe.encode_blocks(blocks_of(data[offsets[i] : offsets[i + 1]])))
                ids = np.concatenate(blocks).astype(np.int32) if blocks else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids], schema.types[1])], schema=schema)

    return clean_docs(docs).mapInArrow(run, "doc_id long, ids array<int>")
