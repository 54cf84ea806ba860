"""Token-id files: shards of documents in ascending id order, compressed by Re-Pair grammars, with random access.

A shard replaces frequent pairs of ids by new symbols, round after round, until no pair occurs ``LEAST`` times. Each round
counts adjacent pairs exactly (in a run of one symbol, those that don't overlap), and replaces the frequent ones where they
don't overlap a more frequent one; a pair that then has fewer replacements than ``LEAST`` waits for a later round. Pairs
that were too rare and have no new symbol can only have become rarer, so a round counts the others. A file holds the rules,
how many ids each expands to, the symbols, the ids before every 1024th symbol, and each document's id and end; so
``Shard.read(start, n)`` expands only the symbols it needs, and puts each where the expansion lengths tell.

Files have names by partition, attempt and number, so a task that runs again writes files of its own; the stored manifest
names those that count. Documents with a null doc_id come last; rows that tie are ordered by text. Null texts count as empty (just the end
id); a shard holds one document at least, whatever its length.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.bpe import independent_pieces
from lodestar.llm.common import byte_groups, clean_docs, give_back, shared_path, shuffle_partitions, text_column
from lodestar.llm.repeats import NULL_ID, ranges
from lodestar.llm.warc import put_file

END_ID = 2
#: Pieces that a worker remembers, and the bytes of them and their ids; it starts anew when they are more.
PIECES, MEMORY_BYTES = 2_000_000, 128 << 20
SHARD_IDS = 1 << 19
#: The least count of a pair.
LEAST = 8
SAMPLE = 1024
#: Ids that are read from a shard at a time.
READ_IDS = 1 << 17
#: White space of any kind, as a regular expression's set, and some that engines don't agree on.
WHITE = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
#: Bytes of texts that are cut and numbered at a time, if a text isn't longer.
CUT_BYTES = 6 << 20
#: A letter before a sign: no token holds both in that order, so texts can be cut between them.
SIGNED = r"(\pL)([!-/:-@\[-`{-~])"
MAGIC = b"RPIDS001"
_HEAD = struct.Struct("<8sIIQQQB")


class Encoder:
    """The tokenizers library, with a memory of pieces that encode on their own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: what keeps a text from being cut before each blank and around each line break
        marks = "|".join(re.escape(s) for s in self.special)
        self.odd = f"[{WHITE}][{WHITE}]|\\A[{WHITE}]|[{WHITE}]\\z|[\\x00\\x1c-\\x1f]" + (f"|{marks}" if marks else "")
        self.row = f"\\A [^{WHITE}]"
        self.forget()
        #: a character of a token's name stands for a byte
        self.token_bytes = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab().items():
            self.token_bytes[i] = len(token)

    def forget(self) -> None:
        """The pieces that are remembered, their ids in a row, and where each one's begin and how many they are."""
        self.known = pa.array([], pa.large_string())
        self.flat, self.first, self.size_of = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, as the library gives them one by one, and how many each has."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _in_a_row(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """_library() of words that begin with their blank: they encode in a row as they do alone, so the library gets them
        as one text, and the lengths of the tokens' bytes tell where each ends."""
        words = pa.concat_arrays([words])
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        ids, _ = self._library([words.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode()])
        stop, reached = ends[1:] - ends[0], np.cumsum(self.token_bytes[ids])
        cut = np.searchsorted(reached, stop) + 1
        if not (reached[np.minimum(cut, len(ids)) - 1] == stop).all():  # tokens across words: then each alone
            return self._library(words.to_pylist())
        return ids, np.diff(cut, prepend=0)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Where different pieces that encode on their own are remembered; new ones are asked for."""
        if len(self.known) > PIECES or self.known.nbytes + self.flat.nbytes > MEMORY_BYTES:
            self.forget()
        found = pc.index_in(pieces, value_set=self.known)
        new = found.is_null()
        out = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = pieces.filter(new)
        if not len(fresh):
            return out
        out[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        row = pc.match_substring_regex(fresh, self.row)
        first, size, done = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), len(self.flat)
        parts = [self.flat]
        for some, ask in ((row, self._in_a_row), (pc.invert(row), lambda x: self._library(x.to_pylist()))):
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if len(at):
                ids, sizes = ask(fresh.filter(some))
                first[at], size[at] = done + np.cumsum(sizes) - sizes, sizes
                parts.append(ids)
                done += len(ids)
        self.known = pa.concat_arrays([self.known, fresh])
        self.flat, self.first, self.size_of = np.concatenate(parts), np.concatenate([self.first, first]), np.concatenate([self.size_of, size])
        return out

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        numbered = pieces.dictionary_encode()
        at = self.numbers(numbered.dictionary)[numbered.indices.to_numpy()]
        size = self.size_of[at]
        return self.flat[ranges(self.first[at], size)], size

    def _odd_text(self, text: str) -> np.ndarray:
        """A text that isn't cut at single blanks throughout."""
        pieces = None if any(s in text for s in self.special) else independent_pieces(text)
        if pieces is None:
            return self._library([text])[0]
        return self._joined(pa.array(pieces, pa.large_string()))[0]

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column without nulls. Texts are cut and numbered in Arrow, and each different
        piece of the batch is looked up once."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._odd_text(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        cut = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), "\n", "\0\n\0"), " ", "\0 ")
        cut = pc.replace_substring_regex(cut, SIGNED, "\\1\0\\2")
        parts = pc.split_pattern(cut, "\0")
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())
        ids, size = self._joined(parts.flatten())
        stops = np.concatenate([[0], np.cumsum(size)])[ends]
        for i, some in zip(plain.tolist(), np.split(ids, stops[:-1])):
            out[i] = some
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: No pair begins at a position.
NONE = np.int32(np.iinfo(np.int32).max)


def _picked(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of the positions at which pairs begin, those that are replaced: where pairs overlap, the lower rank goes first."""
    done = []
    while len(at):
        touch = np.diff(at) == 1
        less = rank[1:] < rank[:-1]
        pick = np.ones(len(at), bool)
        pick[1:] = ~touch | less
        pick[:-1] &= ~(touch & less)
        done.append(at[pick])
        stay = ~pick
        stay[1:] &= ~(pick[:-1] & touch)
        stay[:-1] &= ~(pick[1:] & touch)
        at, rank = at[stay], rank[stay]
    return np.concatenate(done) if done else at


def _every_second(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions without every second one of a run of one symbol, whose pairs overlap."""
    same = symbols[at] == symbols[at + 1]
    if not same.any():
        return at
    runs = at[same]
    begin = np.ones(len(runs), bool)
    begin[1:] = np.diff(runs) != 1
    heads = runs[begin][np.cumsum(begin) - 1]
    keep = np.ones(len(at), bool)
    keep[np.flatnonzero(same)[(runs - heads) % 2 == 1]] = False
    return at[keep]


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and the rules (pairs of ids or earlier symbols) of base, base + 1, ..."""
    symbols = ids.astype(np.int32)
    rules: list[np.ndarray] = []
    n_rules, last = 0, 0  # symbols from last on are of the last round
    frequent = np.ones(len(symbols), bool)  # whether the pair that begins here was frequent when it was counted
    while len(symbols) > 1:
        kind, bits = (np.uint32, 16) if base + n_rules <= 1 << 16 else (np.uint64, 32)
        wide = symbols.astype(kind)
        keys = wide[:-1] << kind(bits) | wide[1:]
        if rules:
            fresh = symbols >= last
            at = _every_second(symbols, np.flatnonzero(frequent[:-1] | fresh[:-1] | fresh[1:]))
        else:
            at = _every_second(symbols, np.arange(len(symbols) - 1))
        if len(at) < len(keys):
            keys = keys[at]
        if bits == 16:  # sorted together with their numbers, which is faster than an argsort
            both = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
            order, in_order = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
        else:
            order = np.argsort(keys)
            in_order = keys[order]
        first = np.flatnonzero(np.concatenate([in_order[:1] == in_order[:1], in_order[1:] != in_order[:-1]]))
        counts = np.diff(first, append=len(keys))
        top = np.flatnonzero(counts >= least)
        if not len(top):
            break
        top = top[np.argsort(-counts[top], kind="stable")]
        rank = np.full(len(symbols), NONE, np.int32)
        rank[at[order[ranges(first[top], counts[top])]]] = np.repeat(np.arange(len(top), dtype=np.int32), counts[top])
        frequent = rank != NONE
        place = np.flatnonzero(frequent)
        doubled = place[symbols[place] == symbols[place + 1]]
        if len(doubled):  # the pairs of a run that weren't counted are as frequent
            same = np.flatnonzero(symbols[:-1] == symbols[1:])
            frequent[same[np.isin(symbols[same], symbols[doubled])]] = True
        place = _picked(place, rank[place])
        which = rank[place]
        used = np.bincount(which, minlength=len(top)) >= least
        some = used[which]
        place, which = place[some], which[some]
        number = np.cumsum(used, dtype=np.int32) - 1
        example = at[order[first[top[used]]]]
        rules.append(np.stack([symbols[example], symbols[example + 1]], axis=1).astype(np.int64))
        symbols[place] = base + n_rules + number[which]
        last = base + n_rules
        n_rules += len(example)
        stay = np.ones(len(symbols), bool)
        stay[place + 1] = False
        symbols, frequent = symbols[stay], frequent[stay]
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.full(len(rules), 2, np.int64)
    while len(rules):
        size = np.where(rules >= base, out[np.maximum(rules - base, 0)], 1).sum(axis=1)
        if (size == out).all():
            break
        out = size
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for; the lengths tell where each begins."""
    size = np.concatenate([np.ones(base, np.int32), lengths.astype(np.int32)])
    left, right = rules[:, 0].astype(np.int32), rules[:, 1].astype(np.int32)
    symbols = symbols.astype(np.int32)
    stop = np.cumsum(size[symbols], dtype=np.int64)
    at = stop - size[symbols]
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
    while len(symbols):
        deep = symbols >= base
        out[at[~deep]] = symbols[~deep]
        at, rule = at[deep], symbols[deep] - np.int32(base)
        first, second = left[rule], right[rule]
        symbols, at = np.concatenate([first, second]), np.concatenate([at, at + size[first]])
    return out


def pack(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """A shard's file. ends: of each document, among ids."""
    base = max(base, int(ids.max(initial=0)) + 1)
    symbols, rules = compress(ids, base)
    lengths = expansions(rules, base)
    wide = int(symbols.max(initial=0)) >= 1 << 16
    size = np.where(symbols >= base, lengths[np.maximum(symbols - base, 0)], 1) if len(rules) else np.ones(len(symbols), np.int64)
    before = (np.cumsum(size) - size)[::SAMPLE]
    body = b"".join(
        (
            _HEAD.pack(MAGIC, base, len(rules), len(doc_ids), len(symbols), len(ids), wide),
            doc_ids.astype("<i8").tobytes(),
            ends.astype("<i8").tobytes(),
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            before.astype("<i8").tobytes(),
            symbols.astype("<u4" if wide else "<u2").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's file, read."""

    def __init__(self, body: bytes) -> None:
        if zlib.crc32(memoryview(body)[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("the file is damaged")
        magic, self.base, n_rules, n_docs, n_symbols, self.n_ids, wide = _HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = _HEAD.size
        parts = []
        for kind, n in (("<i8", n_docs), ("<i8", n_docs), ("<u4", 2 * n_rules), ("<u4", n_rules), ("<i8", -(-n_symbols // SAMPLE)), ("<u4" if wide else "<u2", n_symbols)):
            parts.append(np.frombuffer(body, kind, n, at))
            at += parts[-1].nbytes
        self.doc_ids, self.ends, rules, lengths, self.before, self.symbols = parts
        self.rules, self.lengths = rules.reshape(-1, 2).astype(np.int64), lengths.astype(np.int64)

    def ids(self) -> np.ndarray:
        return self.read(0, self.n_ids)

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; of the symbols between two samples, expands those that reach into them and no others."""
        stop = min(start + n, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.int32)
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, stop, "left"))
        some = self.symbols[a * SAMPLE : b * SAMPLE]
        deep = some >= self.base
        size = np.ones(len(some), np.int64)
        size[deep] = self.lengths[some[deep] - self.base]
        ends = np.cumsum(size) + self.before[a]
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        first = int(ends[i] - size[i])
        return expand(some[i:j], self.rules, self.lengths, self.base)[start - first : stop - first]

    def documents(self) -> tuple[list[int], list[int]]:
        """The end of each document and the CRC-32 of its ids as 32-bit integers, read some ids at a time."""
        ends, crcs = self.ends.tolist(), []
        at = crc = 0
        for start in range(0, self.n_ids, READ_IDS):
            raw = self.read(start, READ_IDS).astype("<u4").tobytes()
            upto = start + len(raw) // 4
            while len(crcs) < len(ends) and at < upto:
                stop = min(ends[len(crcs)], upto)
                crc = zlib.crc32(raw[4 * (at - start) : 4 * (stop - start)], crc)
                at = stop
                if ends[len(crcs)] > stop:
                    break
                crcs.append(crc)
                crc = 0
        return ends, crcs


MANIFEST = "part long, number long, file string, docs long, ids long, bytes long"


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards under folder in ascending doc_id order, and return the stored manifest."""
    spark = docs.sparkSession
    key = F.col("doc_id").asc_nulls_last()
    rows = clean_docs(docs).repartitionByRange(shuffle_partitions(spark), key).sortWithinPartitions(key, F.col("text"))
    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        ctx = TaskContext.get()
        part, number = ctx.partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            body = pack(np.concatenate(held), np.array(names, np.int64), ends, enc.size)
            file = f"ids-{part:06d}-{ctx.taskAttemptId()}-{number:06d}.rpids"
            put_file(f"{folder}/ids", file, body)
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, number, file, len(names), size, len(body)), schema.types)], schema=schema)

        for batch in batches:
            for i, j in byte_groups(text_column(batch)[1], CUT_BYTES):
                some = batch.slice(i, j - i)
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode_batch(some.column(1))):
                    if held and size + len(ids) >= SHARD_IDS:
                        yield close()
                        number, held, names, size = number + 1, [], [], 0
                    held.append(np.concatenate([ids, end]))
                    names.append(NULL_ID if doc_id is None else doc_id)
                    size += len(ids) + 1
        if held:
            yield close()

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that the manifest names."""
    names = "doc_id long, start long, n_tokens long, ids_crc32 long"
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], names)
    # one row for each partition that wrote, so its size is bounded by the partitions of the shuffle
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    base, bases = 0, []
    for p in parts:
        bases.append((p["part"], base))
        base += p["ids"]
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    first = (
        manifest.withColumn("within", F.coalesce(within, F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part")
        .select("file", (F.col("base") + F.col("within")).alias("first"))
    )
    there = spark.read.format("binaryFile").load(f"{folder}/ids").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, start = Shard(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                ends, crcs = shard.documents()
                begin = [0, *ends[:-1]]
                out = [
                    pa.array([None if d == NULL_ID else d for d in shard.doc_ids.tolist()], pa.int64()),
                    pa.array([start + a for a in begin], pa.int64()),
                    pa.array([b - a for a, b in zip(begin, ends)], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return there.join(first, "file").select("content", "first").mapInArrow(run, names)


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token-id files to shared storage and read every document back from them."""
    folder = shared_path(docs.sparkSession, "token-ids")
    write_token_files(docs, tokenizer, folder)
    return read_token_files(docs.sparkSession, folder)
