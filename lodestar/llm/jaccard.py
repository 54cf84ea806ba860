"""N-gram Jaccard join: sets in a prefix tree, for near-duplicate documents and their classes.

A document's set holds 64-bit hashes of its different 5-word shingles (with fewer words the whole sequence is one), so
counts are exact but for hashes that agree by chance: 2**-64 for two shingles. The steps:

1. Document frequencies: chunks send their different shingles to buckets (packed, in 40 bits), which answer with the
   frequency's class. Class and hash give a global order of shingles.
2. Two sets with a similarity of t share a shingle among the n - ceil(t n) + 1 rarest of each, its prefix. Prefix shingles
   that occur elsewhere go to buckets, a chunk's once each, whose stars connect the sets into candidate groups.
3. The sets of a candidate group, in the global order with frequent shingles first, make a prefix tree. A set walks it from
   the root: what it shares with a path counts once for all sets below, and a subtree is left where its remaining lengths
   can't reach the similarity, or where all its sets are in the walker's class already.
4. Groups of over ``block_sets`` sets first join blocks of sets that have their leading shingle in common; every block of
   one leading shingle has the same few of its sets too, so copies of one text fall into one class. Then only sets of
   different classes that share a prefix shingle are left: classes are dealt into blocks, and of the pairs of blocks those
   are joined in which such sets meet.
5. Links between different sets make classes; documents with equal sets are one node throughout.

Null and empty texts have an empty set and are linked with nothing. Rows that repeat a doc_id share one answer if their
texts are equal. A class with only null ids has a null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.llm.common import byte_groups, give_back, lower_ascii, run_hashes, shuffle_partitions, stored, word_hashes, word_spans
from lodestar.llm.graph import components
from lodestar.llm.repeats import _CHUNKS, BUCKET_BYTES, NULL_ID, Chunk, open_chunk, pack_chunks, ranges, rows_of

N = 5
#: The least similarity, in hundredths.
PERCENT = 75
#: Different sets that a task joins with one another, or half of those of a pair of blocks.
BLOCK_SETS = 400
#: Bytes of texts that are hashed at a time, if a text isn't longer.
GROUP_BYTES = 1 << 17
KEY_BITS = 40
#: Parts into which the sets of each group are dealt where they meet facts about it.
SALTS = 16


def shingle_sets(chunk: Chunk, n: int = N) -> list[np.ndarray]:
    """The sorted shingle hashes of each document of a chunk."""
    out: list[np.ndarray] = []
    raw = chunk.data.tobytes()
    offsets = np.concatenate([[0], chunk.ends])
    for i, j in byte_groups(offsets, GROUP_BYTES):
        # a blank after each document
        some = b" ".join(raw[a:b] for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist()))
        data = lower_ascii(np.frombuffer(some, np.uint8))
        starts, ends = word_spans(data)
        words = word_hashes(data, starts, ends)
        shingles = run_hashes(words, n)
        stops = offsets[i + 1 : j + 1] - offsets[i] + np.arange(j - i)
        a = 0
        for b in np.searchsorted(starts, stops, "right").tolist():
            if b - a >= n:
                out.append(np.unique(shingles[a : b - n + 1]))
            elif b > a:
                out.append(run_hashes(words[a:b], b - a))
            else:
                out.append(np.zeros(0, np.uint64))
            a = b
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(n: int, percent: int = PERCENT) -> int:
    """The least intersection of a set of n with one that is similar enough."""
    return -(-percent * n // 100)


# ---------------------------------------------------------------- document frequencies


def _squeeze(values: np.ndarray) -> bytes:
    """Ascending numbers as the byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes())


def _unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _sent(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of a chunk by bucket, their counts of documents, and bucket borders."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    keys, counts = np.unique(every >> np.uint64(64 - KEY_BITS), return_counts=True)
    bucket = keys % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return keys[order], counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _distinct_sets(chunk: Chunk) -> tuple[list[np.ndarray], list[bytes], list[int]]:
    """Sets and keys of the documents, and the documents that have the first copy of a set that isn't empty."""
    sets = shingle_sets(chunk)
    keys = [set_key(s) for s in sets]
    first: dict[bytes, int] = {}
    for i, k in enumerate(keys):
        if len(sets[i]):
            first.setdefault(k, i)
    return sets, keys, list(first.values())


def _send_keys(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("gid", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squash = zstandard.ZstdCompressor(level=1)
        for row in rows_of(batches):
            chunk = open_chunk(*row)
            sets, _, heads = _distinct_sets(chunk)
            keys, counts, borders = _sent([sets[i] for i in heads], buckets)
            counts = np.minimum(counts, 255).astype(np.uint8)
            out = []
            for b in np.flatnonzero(np.diff(borders)).tolist():
                part = slice(borders[b], borders[b + 1])
                out.append((b, chunk.gid, _squeeze(keys[part] // np.uint64(buckets)), squash.compress(counts[part].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _answer_classes(table: pa.Table) -> pa.Table:
    sent = [_unsqueeze(x.as_py()) for x in table.column("keys")]
    unpack, squash = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    counts = np.concatenate([np.frombuffer(unpack.decompress(x.as_py()), np.uint8) for x in table.column("counts")])
    _, inverse = np.unique(np.concatenate(sent), return_inverse=True)
    df = np.bincount(inverse, counts)
    cls = np.where(df > 1, 1 + np.floor(np.log2(np.maximum(df, 1))), 0).astype(np.uint8)[inverse]
    parts = np.split(cls, np.cumsum([len(k) for k in sent])[:-1])
    give_back()
    return pa.table({"gid": table.column("gid"), "bucket": table.column("bucket"), "mask": pa.array([squash.compress(p.tobytes()) for p in parts], pa.binary())})


# ---------------------------------------------------------------- candidates

DOCS = "kind int, gid long, place int, doc_id long, n_shingles long, set_key binary, lead long, bucket int, packed binary"
_DOCS = pa.schema(
    [("kind", pa.int32()), ("gid", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("lead", pa.int64())]
    + [("bucket", pa.int32()), ("packed", pa.binary())]
)
_PAIR = np.dtype([("token", "<u8"), ("node", "<i8")])
_EDGE = np.dtype([("a", "<i8"), ("b", "<i8")])
#: Kinds of rows: documents, prefix shingles with sets, edges between sets.
ROWS, PAIRS, EDGES = 0, 1, 2


def node_of(key: bytes) -> int:
    """The number by which a set goes in the candidate graph; two sets of one number are candidates of each other."""
    return int.from_bytes(key[:8], "little", signed=True)


def _prefix(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set's prefix that occur elsewhere."""
    first = np.argsort(classes, kind="stable")[: len(tokens) - needed(len(tokens), percent) + 1]
    return tokens[first[classes[first] > 0]]


class Classed:
    """The sets of a chunk with the frequency classes of their shingles."""

    def __init__(self, chunk: Chunk, answers: list, buckets: int) -> None:
        unpack = zstandard.ZstdDecompressor()
        self.sets, self.keys, self.heads = _distinct_sets(chunk)
        sent, _, borders = _sent([self.sets[i] for i in self.heads], buckets)
        classes = np.zeros(len(sent), np.uint8)
        for a in answers or ():
            classes[borders[a["bucket"]] : borders[a["bucket"] + 1]] = np.frombuffer(unpack.decompress(a["mask"]), np.uint8)
        order = np.argsort(sent)
        self.known, self.classes = sent[order], classes[order]

    def of(self, i: int) -> np.ndarray:
        return self.classes[np.searchsorted(self.known, self.sets[i] >> np.uint64(64 - KEY_BITS))]

    def prefix(self, i: int, percent: int) -> np.ndarray:
        return _prefix(self.sets[i], self.of(i), percent)

    def lead(self, i: int) -> int:
        """The most frequent shingle's hash, of those of one class the smallest."""
        return int(self.sets[i][int(np.argmax(self.of(i)))].astype(np.int64)) if len(self.sets[i]) else 0


def _send_prefixes(buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, answers in rows_of(batches):
            chunk = open_chunk(*row)
            own = Classed(chunk, answers, buckets)
            n = len(own.sets)
            lead = [0] * n
            found = []
            for i in own.heads:
                lead[i] = own.lead(i)
                first = own.prefix(i, percent)
                if len(first):
                    pairs = np.empty(len(first), _PAIR)
                    pairs["token"], pairs["node"] = first, node_of(own.keys[i])
                    found.append(pairs)
            columns = [[ROWS] * n, [chunk.gid] * n, list(range(n)), [None if d == NULL_ID else d for d in chunk.ids.tolist()], [len(s) for s in own.sets], own.keys, lead, [None] * n, [None] * n]
            if found:
                pairs, edges = _combined(np.concatenate(found))
                for c, v in zip(columns, (EDGES, chunk.gid, None, None, None, None, None, None, edges.tobytes())):
                    c.append(v)
                bucket = pairs["token"] % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    for c, v in zip(columns, (PAIRS, chunk.gid, None, None, None, None, None, b, pairs[by[cuts[b] : cuts[b + 1]]].tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DOCS.types)], schema=_DOCS)

    return run


class Forest:
    """Classes of numbers 0 to n - 1 under union."""

    def __init__(self, n: int) -> None:
        self.up, self.classes = list(range(n)), n

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.classes -= 1
        return True


def _combined(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token once, with the first set of the class that those which share it make; and edges from sets to these."""
    pairs = pairs[np.argsort(pairs["token"], kind="stable")]
    nodes, at = np.unique(pairs["node"], return_inverse=True)
    forest = Forest(len(nodes))
    same = np.flatnonzero(pairs["token"][1:] == pairs["token"][:-1])
    links = np.unique(at[same] << 32 | at[same + 1])
    for i, j in zip((links >> 32).tolist(), (links & 0xFFFFFFFF).tolist()):
        forest.join(i, j)
    root = np.array([forest.root(i) for i in range(len(nodes))], np.int64)
    apart = np.flatnonzero(root != np.arange(len(nodes)))
    edges = np.empty(len(apart), _EDGE)
    edges["a"], edges["b"] = nodes[apart], nodes[root[apart]]
    heads = np.flatnonzero(np.concatenate([[True], pairs["token"][1:] != pairs["token"][:-1]]))
    out = pairs[heads].copy()
    out["node"] = nodes[root[at[heads]]]
    return out, edges


def _edge_table(edges: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(edges["a"], pa.int64()), "b": pa.array(edges["b"], pa.int64())})


def _connect(table: pa.Table) -> pa.Table:
    """Edges that connect the sets which share a token of the bucket: for each class, from its smallest node."""
    return _edge_table(_combined(np.concatenate([np.frombuffer(x.as_py(), _PAIR) for x in table.column("packed")]))[1])


def _unpack_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield from _edge_table(np.frombuffer(x.as_py(), _EDGE)).to_batches()


# ---------------------------------------------------------------- the prefix tree


class PrefixTree:
    """A path-compressed trie of sets (ascending arrays of token numbers) in flat arrays.

    A node continues its parent's path with a run of tokens; ``ends`` says which set ends at a node, or -1.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        up, lo, hi, own, ends = [-1], [0], [0], [-1], [-1]
        stack, before = [0], np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            last = -1
            while hi[stack[-1]] > common:
                last = stack.pop()
            if hi[stack[-1]] < common:  # the path parts within the run of `last`
                up.append(stack[-1])
                lo.append(hi[stack[-1]])
                hi.append(common)
                own.append(own[last])
                ends.append(-1)
                up[last], lo[last] = len(up) - 1, common
                stack.append(len(up) - 1)
            up.append(stack[-1])
            lo.append(common)
            hi.append(len(s))
            own.append(i)
            ends.append(i)
            stack.append(len(up) - 1)
            before = s
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self.up, self.depth, self.ends = np.array(up), np.array(hi), np.array(ends)
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.concatenate([*sets, np.zeros(1, np.int64)])
        self.run = np.array(hi) - np.array(lo)
        self.at = begin[own] + np.array(lo)
        self.at[0] = 0
        last_token = np.full(len(up), -1, np.int64)
        some = self.depth > 0
        last_token[some] = self.tokens[(begin[own] + self.depth - 1)[some]]
        self.last = last_token
        level = np.zeros(len(up), np.int64)
        by_depth = np.lexsort((-self.run, self.depth))  # parents before children: they are shallower
        for v in by_depth.tolist():
            if v:
                level[v] = level[self.up[v]] + 1
        self.levels = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)]
        kids = np.argsort(self.up[1:], kind="stable") + 1
        self.kids = kids
        self.kid_cut = np.searchsorted(self.up[kids], np.arange(len(up) + 1))
        self.shortest = self.below(self.sizes, np.minimum, np.iinfo(np.int64).max)
        self.longest = self.below(self.sizes, np.maximum, -1)

    def below(self, values: np.ndarray, merge: np.ufunc, none: int) -> np.ndarray:
        """values (by set) merged over the sets at and below each node."""
        out = np.full(len(self.up), none, np.int64)
        some = self.ends >= 0
        out[some] = values[self.ends[some]]
        for nodes in reversed(self.levels[1:]):
            merge.at(out, self.up[nodes], out[nodes])
        return out

    def walk(self, i: int, percent: int, skip: np.ndarray | None = None) -> np.ndarray:
        """The sets that are similar enough to set i, itself included. skip: nodes that needn't be entered."""
        own = self.sets[i]
        size = len(own)
        member = np.zeros(int(self.tokens.max(initial=0)) + 1, bool)
        member[own] = True
        front, shared = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = []
        while len(front):
            counts = self.kid_cut[front + 1] - self.kid_cut[front]
            nodes = self.kids[ranges(self.kid_cut[front], counts)]
            have = np.repeat(shared, counts)
            if skip is not None:
                keep = ~skip[nodes]
                nodes, have = nodes[keep], have[keep]
            if not len(nodes):
                break
            run = self.run[nodes]
            hits = np.concatenate([[0], np.cumsum(member[self.tokens[ranges(self.at[nodes], run)]])])
            stop = np.cumsum(run)
            have = have + hits[stop] - hits[stop - run]
            left = size - np.searchsorted(own, self.last[nodes], "right")
            # the length at which the most that can be shared is largest against what is needed
            length = np.clip(self.depth[nodes] + left, self.shortest[nodes], self.longest[nodes])
            most = have + np.minimum(length - self.depth[nodes], left)
            fine = (100 + percent) * most >= percent * (length + size)
            nodes, have = nodes[fine], have[fine]
            there = self.ends[nodes]
            whole = (there >= 0) & ((100 + percent) * have >= percent * (self.sizes[there] + size))
            found.append(there[whole])
            front, shared = nodes, have
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def tree_join(sets: list[np.ndarray], classes: list[np.ndarray], percent: int = PERCENT, labels: list[str | None] | None = None) -> list[tuple[int, int]]:
    """Links that connect the classes of similar sets (enough of them to connect, not all within a class).

    classes: the frequency class of each token, which with the token itself is the global order; labels: classes that
    sets are known to be in, or None.
    """
    every, where = np.unique(np.concatenate(sets), return_index=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -np.concatenate(classes)[where].astype(np.int64)))] = np.arange(len(every))
    tree = PrefixTree([np.sort(rank[np.searchsorted(every, s)]) for s in sets])
    forest = Forest(len(sets))
    known: dict[str, int] = {}
    for i, name in enumerate(labels or ()):
        if name is not None:
            forest.join(i, known.setdefault(name, i))
    links: list[tuple[int, int]] = []
    label = low = high = None
    stale = 0
    for i in range(len(sets)):
        if forest.classes == 1:
            break
        if label is None or len(links) - stale >= 8:
            label = np.array([forest.root(j) for j in range(len(sets))])
            low, high = tree.below(label, np.minimum, len(sets)), tree.below(label, np.maximum, -1)
            stale = len(links)
        for j in tree.walk(i, percent, (low == high) & (low == label[i])).tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def _join_group(percent: int):
    def run(table: pa.Table) -> pa.Table:
        # a set that comes by several ways counts once
        first = {key: i for i, key in reversed(list(enumerate(table.column("set_key").to_pylist())))}
        keys, at = list(first), list(first.values())
        sets, classes = ([np.frombuffer(table.column(name)[i].as_py(), kind) for i in at] for name, kind in (("tokens", np.uint64), ("classes", np.uint8)))
        labels = [table.column("label")[i].as_py() for i in at]
        links = tree_join(sets, classes, percent, labels) if len(sets) > 1 else []
        if len(sets) > 200:
            give_back()
        return pa.table({"a": pa.array([keys[i].hex() for i, _ in links], pa.string()), "b": pa.array([keys[j].hex() for _, j in links], pa.string())})

    return run


SETS = "root long, pair long, set_key binary, label string, tokens binary, classes binary, own boolean"


def _send_sets(buckets: int):
    """The sets that are asked for, once for each group they go to; the first one is marked."""
    schema = pa.schema([("root", pa.int64()), ("pair", pa.int64()), ("set_key", pa.binary()), ("label", pa.string()), ("tokens", pa.binary()), ("classes", pa.binary()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, answers, asked in rows_of(batches):
            own = Classed(open_chunk(*row), answers, buckets)
            out = []
            for a in asked:
                sent = (own.sets[a["place"]].tobytes(), own.of(a["place"]).tobytes())
                out += [(a["root"], pair, a["set_key"], None, *sent, k == 0) for k, pair in enumerate(a["pairs"])]
            for k in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 500]), schema.types)], schema=schema)

    return run


def _prefix_tokens(percent: int):
    """The prefix shingles of sets with the blocks that these are in, each once a batch."""
    schema = pa.schema([("root", pa.int64()), ("token", pa.int64()), ("block", pa.int64()), ("pure", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: dict[tuple, list[np.ndarray]] = {}
            for root, block, pure, own, cls in zip(*(batch.column(i).to_pylist() for i in range(5))):
                tokens.setdefault((root, block, pure), []).append(_prefix(np.frombuffer(own, np.uint64), np.frombuffer(cls, np.uint8), percent))
            for (root, block, pure), some in tokens.items():
                some = np.unique(np.concatenate(some)).astype(np.int64)
                columns = [np.full(len(some), root), some, np.full(len(some), block), [pure] * len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """Links of the sets that meet in a group (root, pair)."""
    return sets.select("root", "pair", "set_key", "label", "tokens", "classes").groupBy("root", "pair").applyInArrow(_join_group(percent), "a string, b string")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of groups, one for each salt, so that the sets of a hot group meet them in many tasks."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _salted(heads: DataFrame) -> DataFrame:
    return heads.withColumn("salt", F.pmod(F.xxhash64("set_key", F.lit(2)), F.lit(SALTS)))


def _first_blocks(heads: DataFrame, sizes: DataFrame, block_sets: int) -> DataFrame:
    """Small groups whole; of large ones, the sets of one leading shingle in blocks that have four of them in common."""
    key = "set_key"
    heads = _salted(heads).join(_spread(sizes.where(F.col("n") > block_sets)), ["root", "salt"], "left")
    shared = F.array(F.min(key), F.max(key), F.min_by(key, F.xxhash64(key)), F.max_by(key, F.xxhash64(key)))
    leads = heads.where("n IS NOT NULL").groupBy("root", "lead").agg(F.ceil(F.count(F.lit(1)) / block_sets).cast("long").alias("blocks"), shared.alias("shared"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64(key, F.lit(1)), "blocks"))
    numbers = F.when(F.array_contains("shared", F.col(key)), every).otherwise(own)
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(numbers, lambda i: F.xxhash64("lead", i)))
    return heads.join(_spread(leads), ["root", "lead", "salt"], "left").select("gid", "place", "root", key, pairs.alias("pairs"))


def _other_blocks(sets: DataFrame, classes: DataFrame, sizes: DataFrame, block_sets: int, percent: int) -> DataFrame | None:
    """The sets of large groups that are in several classes, in pairs of blocks where a prefix shingle spans classes."""
    large = _spread(sizes.where(F.col("n") > block_sets))
    sets = _salted(sets.where("own").drop("pair", "label", "own")).join(large, ["root", "salt"]).withColumn("set", F.lower(F.hex("set_key")))
    heads = sets.select("root", "salt", "set_key", "set").join(classes, "set", "left").withColumn("label", F.coalesce("class", "set"))
    per_class = heads.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n_class"))
    small = F.sum(F.when(F.col("n_class") < block_sets, F.col("n_class")).otherwise(0))
    per_root = per_class.groupBy("root").agg(F.count(F.lit(1)).alias("n_classes"), small.alias("n_small")).where("n_classes > 1")
    placed = heads.join(_spread(per_class.join(per_root, "root")), ["root", "label", "salt"])
    of_large = F.xxhash64("label", F.pmod(F.xxhash64("set_key"), F.ceil(F.col("n_class") / block_sets).cast("long")))
    of_small = F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("label"), F.ceil(F.col("n_small") / block_sets).cast("long")))
    big = F.col("n_class") >= block_sets
    placed = placed.withColumn("block", F.when(big, of_large).otherwise(of_small)).withColumn("pure", F.when(big, F.col("label")))
    placed = placed.select("set_key", "label", "block", "pure").join(sets.select("root", "set_key", "tokens", "classes"), "set_key")
    placed = stored(placed, "jaccard-placed")
    if placed.isEmpty():
        return None
    tokens = placed.select("root", "block", "pure", "tokens", "classes").mapInArrow(_prefix_tokens(percent), "root long, token long, block long, pure string")
    meeting = tokens.groupBy("root", "token").agg(F.sort_array(F.collect_set(F.struct("block", "pure"))).alias("blocks"))
    # shingles of the same sets have the same blocks
    meeting = meeting.select("root", "blocks").distinct()
    others = lambda x: F.filter("blocks", lambda y: (y["block"] >= x["block"]) & ~F.coalesce(y["pure"] == x["pure"], F.lit(False)))
    met = F.flatten(F.transform("blocks", lambda x: F.transform(others(x), lambda y: F.struct(x["block"].alias("i"), y["block"].alias("j")))))
    met = meeting.select("root", F.explode(met).alias("p")).select("root", "p.i", "p.j").distinct()
    both = F.array_distinct(F.array("i", "j"))
    goes = met.select("root", F.explode(both).alias("block"), F.xxhash64("i", "j").alias("pair"))
    return placed.join(goes, ["root", "block"]).select("root", "pair", "set_key", "label", "tokens", "classes")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; component_id is the smallest doc_id it is connected with."""
    return _classes(pack_chunks(docs, "jaccard-chunks"), percent, block_sets).select("doc_id", "n_shingles", "component_id")


def _kept(names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, places in rows_of(batches):
            chunk = open_chunk(*row)
            data, starts, places = chunk.data.tobytes(), chunk.starts, sorted(places)
            columns = {
                "doc_id": pa.array([None if (d := int(chunk.ids[i])) == NULL_ID else d for i in places], pa.int64()),
                "text": pa.array([data[starts[i] : chunk.ends[i]].decode() for i in places], pa.string()),
            }
            if len(names) > 2:
                others = chunk.carried.take(pa.array(places))
                columns |= {name: others.column(name).combine_chunks() for name in others.column_names}
            yield pa.RecordBatch.from_arrays([columns[name].cast(schema.field(name).type) for name in names], schema=schema)

    return run


def one_of_each(docs: DataFrame, carry: tuple[str, ...] = (), percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, text and the columns to carry, of one row of each class of near duplicates: the one with the smallest doc_id.

    Rows are told apart by where they stand, so ids may be null (these come last) or repeat with other texts. Rows without
    words are all kept; a null text comes back empty.
    """
    chunks = pack_chunks(docs, "jaccard-chunks", carry=carry)
    rows = _classes(chunks, percent, block_sets).select("gid", "place", "doc_id", "set", "class")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "set", "gid", "place")
    least = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("at")).select("at.gid", "at.place")
    places = rows.where("class IS NULL").select("gid", "place").unionByName(least).groupBy("gid").agg(F.collect_list("place").alias("places"))
    kinds = {"doc_id": "bigint", "text": "string"} | {c: t for c, t in docs.dtypes if c in carry}
    names = ["doc_id", "text", *carry]
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ", ".join(f"`{n}` {kinds[n]}" for n in names)).schema)
    asked = chunks.join(places, "gid").select(*_CHUNKS.names, "places")
    return asked.mapInArrow(_kept(names, schema), ", ".join(f"`{n}` {kinds[n]}" for n in names))


def _classes(chunks: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Of each row: gid, place, doc_id, n_shingles, component_id, the key of its set, and its class (null for empty sets)."""
    spark = chunks.sparkSession
    total = chunks.agg(F.sum("raw_bytes")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    columns = [*_CHUNKS.names[:5]]
    sent = chunks.select(*columns).mapInArrow(_send_keys(buckets), "bucket int, gid long, keys binary, counts binary")
    frequencies = sent.groupBy("bucket").applyInArrow(_answer_classes, "gid long, bucket int, mask binary")
    frequencies = stored(frequencies.groupBy("gid").agg(F.collect_list(F.struct("bucket", "mask")).alias("classes")), "jaccard-frequencies")
    found = chunks.join(frequencies, "gid", "left").select(*columns, "classes").mapInArrow(_send_prefixes(buckets, percent), DOCS)
    found = stored(found, "jaccard-docs")
    edges = found.where(F.col("kind") == PAIRS).select("bucket", "packed").groupBy("bucket").applyInArrow(_connect, "a long, b long")
    edges = edges.unionByName(found.where(F.col("kind") == EDGES).select("packed").mapInArrow(_unpack_edges, "a long, b long"))
    groups = components(edges, "jaccard-candidates")
    rows = found.where(F.col("kind") == ROWS).select("gid", "place", "doc_id", "n_shingles", "set_key", "lead")
    # one chunk provides each different set
    heads = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("gid", "place", "lead")).alias("at")).select("set_key", "at.*")
    heads = stored(heads.withColumn("node", _node(F.col("set_key"))).join(groups, "node").select("set_key", "gid", "place", "lead", "root"), "jaccard-heads")
    sizes = heads.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    asked = _first_blocks(heads, sizes, block_sets).groupBy("gid").agg(F.collect_list(F.struct("place", "root", "set_key", "pairs")).alias("asked"))
    asked = chunks.join(frequencies, "gid").join(asked, "gid").select(*columns, "classes", "asked")
    sets = stored(asked.mapInArrow(_send_sets(buckets), SETS), "jaccard-sets")
    classes = components(_linked(sets, percent), "jaccard-classes").withColumnsRenamed({"node": "set", "root": "class"})
    if not sizes.where(F.col("n") > block_sets).isEmpty():
        left = _other_blocks(sets, classes, sizes, block_sets, percent)
        if left is not None:
            more = _linked(left, percent).unionByName(classes.select(F.col("set").alias("a"), F.col("class").alias("b")))
            classes = components(more, "jaccard-classes").withColumnsRenamed({"node": "set", "root": "class"})
    keyed = rows.select("gid", "place", "doc_id", "n_shingles", F.lower(F.hex("set_key")).alias("set"))
    keyed = keyed.join(classes, "set", "left").withColumn("class", F.when(F.col("n_shingles") > 0, F.coalesce("class", "set")))
    # stored, so that the join with it is one that Spark can split at hot classes
    least = stored(keyed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return keyed.join(least, "class", "left").select("gid", "place", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set", "class")


def _node(key):
    """node_of() of a column: the first 8 bytes as a signed little-endian number."""
    low = [F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("long") for i in range(8)]
    out = low[0]
    for i in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(low[i], 8 * i))
    return out
