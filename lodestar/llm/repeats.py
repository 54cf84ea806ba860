"""Exact repeats of windows in a corpus: super-k-mers travel to the bucket of their minimiser and are compared there.

A window is ``width`` consecutive units (bytes or words) of a document. Its minimiser is the smallest hash of its k-mers,
so equal windows have the same one. Consecutive windows with the same minimiser in one place form a super-k-mer: one string
(a run of one byte or of a period of ``PERIOD`` is one too, in pieces of ``most_windows``). Texts are kept in chunks of about 1 MB in a stored
table, and four passes over hashes and chunks find all repeats:

1. each chunk sends its different minimisers and their counts to their buckets (9 bytes each);
2. a bucket answers each chunk with two bits a minimiser: whether it occurs again anywhere, and whether it is hot;
3. for those that occur again, a chunk sends its different super-k-mers, packed and compressed, each once with its first
   place. Those of a hot minimiser are parted once more, by the smallest of other hashes of each window's k-mers, and go
   to the buckets of both, so the different contexts of a common passage meet in many places;
4. a bucket compares the windows of its different super-k-mers, and answers with one bit a window.

Chunks combine equal super-k-mers before anything is sent, buckets combine those of all chunks, and a group of copies
costs a bucket one string. Bits go back in the order in which strings came, so no window or string is sent twice.
Buckets work through their minimisers in batches, and their number follows from the bytes of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import CHUNK_BYTES, clean_docs, give_back, mix, run_hashes, shuffle_partitions, span_hashes, stored, text_column

NULL_ID = np.iinfo(np.int64).max
#: Raw bytes of texts for each bucket.
BUCKET_BYTES = 4 << 20
#: Bytes of different super-k-mers that a bucket compares at a time, if a single minimiser doesn't have more.
BATCH_BYTES = 1 << 19
#: Hash bits and place bits of the keys whose minimum is a minimiser. Blocks of windows stay in a core's cache, and are
#: smaller than the places.
PLACE_BITS = 16
BLOCK = 1 << 15
#: Windows that are marked at a time.
WINDOWS = 1 << 20
#: Windows of a super-k-mer at most; and the super-k-mers of a minimiser (a chunk counts 255 at most) that make it hot.
MOST_WINDOWS = 1 << 10
HOT = 4096
#: Units by which the place of a minimiser may move without a new super-k-mer.
PERIOD = 16
#: Makes other hashes of k-mers.
SALT = np.uint64(0x2545F4914F6CDD1D)

CHUNKS = "gid long, ids binary, ends binary, raw_bytes long, body binary, carried binary"
_CHUNKS = pa.schema([("gid", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("raw_bytes", pa.int64()), ("body", pa.binary()), ("carried", pa.binary())])


def pack_chunks(docs: DataFrame, what: str, squeeze: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """A stored table of chunks of documents, with the columns to carry.

    squeeze: words joined by single blanks instead of the text as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        parts: list[bytes] = []
        others: list[pa.RecordBatch] = []
        held = number = 0
        squash = zstandard.ZstdCompressor(level=3)

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            row = (base + number, np.array(ids, np.int64).tobytes(), ends.tobytes(), held, squash.compress(b"".join(parts)), _packed(others) if carry else b"")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNKS.types)], schema=_CHUNKS)

        for batch in batches:
            data, offsets = text_column(batch)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                raw = b" ".join(raw.split()) if squeeze else raw
                if ids and held + len(raw) > CHUNK_BYTES:
                    yield close()
                    number, ids, parts, others, held = number + 1, [], [], [], 0
                if carry:
                    others.append(batch.slice(i, 1).select(list(carry)))
                ids.append(NULL_ID if doc_id is None else doc_id)
                parts.append(raw)
                held += len(raw)
        if ids:
            yield close()

    return stored(clean_docs(docs, *carry).mapInArrow(run, CHUNKS), what)


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    merged = pa.Table.from_batches(rows).combine_chunks()
    with pa.ipc.new_stream(sink, merged.schema) as out:
        out.write_table(merged)
    return sink.getvalue().to_pybytes()


@dataclass
class Chunk:
    gid: int
    ids: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    packed: bytes = b""

    @property
    def carried(self) -> pa.Table:
        return pa.ipc.open_stream(self.packed).read_all()

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def open_chunk(gid: int, ids: bytes, ends: bytes, raw_bytes: int, body: bytes, carried: bytes = b"") -> Chunk:
    data = zstandard.ZstdDecompressor().decompress(body, max_output_size=raw_bytes) if raw_bytes else b""
    return Chunk(gid, np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8), carried)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(batch.num_columns))
    give_back()


@dataclass(frozen=True)
class Units:
    """What windows are made of: the bytes of a text, or its words (of texts with single blanks between words)."""

    words: bool
    width: int
    k: int
    hot: int = HOT
    most_windows: int = MOST_WINDOWS
    batch_bytes: int = BATCH_BYTES

    def layout(self, chunk: Chunk) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
        """Byte starts and ends of the units (None: each byte is one), and the document of each."""
        data = chunk.data
        if not self.words:
            if len(chunk.ids) == 1:
                return None, None, np.broadcast_to(np.int32(0), len(data))
            return None, None, np.repeat(np.arange(len(chunk.ids), dtype=np.int32), np.diff(chunk.ends, prepend=0))
        inside = np.ones(len(data) + 1, bool)
        inside[:-1] = data != 32
        first = np.zeros(len(data) + 1, bool)
        first[1:] = ~inside[:-1]
        sizes = np.diff(chunk.ends, prepend=0)
        first[chunk.starts[sizes > 0]] = True
        starts = np.flatnonzero(first[: len(data)] & inside[: len(data)])
        last = np.zeros(len(data) + 1, bool)
        last[: len(data)] = ~inside[: len(data)]
        last[chunk.ends] = True
        breaks = np.flatnonzero(last)
        ends = breaks[np.searchsorted(breaks, starts, "right")]
        return starts, ends, np.searchsorted(chunk.ends, starts, "right").astype(np.int32)


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _byte_kmers(value: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k bytes, k a power of two."""
    out, n = value, 1
    while n < k:
        if len(out) <= n:
            return np.zeros(0, np.uint64)
        out = out[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + (out[n:] ^ out[n:] >> np.uint64(29))
        n *= 2
    return mix(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of span values."""
    n, reach = len(values) - span + 1, 1
    while 2 * reach <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[span - reach : span - reach + n]) if reach < span else values


@dataclass
class Segments:
    """Super-k-mers of a chunk: first window, count of windows, minimiser, and whether its k-mer occurs in several places;
    and the units they are made of."""

    first: np.ndarray
    count: np.ndarray
    minimiser: np.ndarray
    several: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    doc: np.ndarray
    width: int

    def spans(self, which: np.ndarray) -> tuple[list[int], list[int]]:
        """Where the strings of some segments begin and end."""
        first, last = self.first[which], self.first[which] + self.count[which] + self.width - 2
        begin, end = (first, last + 1) if self.starts is None else (self.starts[first], self.ends[last])
        return begin.tolist(), end.tolist()

    def texts(self, data: bytes, which: np.ndarray) -> list[bytes]:
        return [data[a:b] for a, b in zip(*self.spans(which))]


def _pieces(most: int, first: np.ndarray, count: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of at most so many windows."""
    if count.max(initial=0) <= most:
        return first, count, *others
    parts = -(-count // most)
    number = ranges(np.zeros(len(parts), np.int64), parts)
    left = np.repeat(count, parts) - number * most
    return np.repeat(first, parts) + number * most, np.minimum(left, most), *(np.repeat(x, parts) for x in others)


def segments(chunk: Chunk, units: Units) -> Segments:
    starts, ends, doc = units.layout(chunk)
    span = units.width - units.k + 1  # k-mers in a window
    n = len(doc) - units.width + 1
    keep = np.uint64((1 << 64) - (1 << PLACE_BITS))
    words = run_hashes(span_hashes(chunk.data, starts, ends), units.k) if units.words else None
    firsts, keys, edges, moves = [], [], [], []
    before, at, whole_before = np.uint64(1), -1, False  # no minimiser is odd
    for b in range(0, n, BLOCK):
        m = min(BLOCK, n - b)
        hashes = words[b : b + m + span - 1] if units.words else _byte_kmers(_BYTE_VALUES[chunk.data[b : b + m + units.width - 1]], units.k)
        low = _least(hashes & keep | np.arange(m + span - 1, dtype=np.uint64), span)
        key = low & keep
        place = (low & ~keep).astype(np.int64) + b
        whole = doc[b : b + m] == doc[b + units.width - 1 : b + units.width - 1 + m]
        moved = np.diff(place, prepend=at)
        new = np.concatenate([[key[0] != before or not whole_before], (key[1:] != key[:-1]) | ~whole[:-1]]) | (moved > PERIOD)
        before, at, whole_before = key[-1], place[-1], bool(whole[-1])
        some = np.flatnonzero(new & whole)
        firsts.append(some + b)
        keys.append(mix(key[some]))  # its low bits are zeros, and buckets go by them
        edges.append(np.flatnonzero(new | ~whole) + b)
        moves.append(np.flatnonzero((moved > 0) & ~new & whole) + b)
    if not firsts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none.astype(np.uint64), none.astype(bool), starts, ends, doc, units.width)
    first, edge = np.concatenate(firsts), np.append(np.concatenate(edges), n)
    count = edge[np.searchsorted(edge, first, "right")] - first
    several = np.zeros(len(first), bool)
    several[np.searchsorted(first, np.concatenate(moves), "right") - 1] = True
    return Segments(*_pieces(units.most_windows, first, count, np.concatenate(keys), several), starts, ends, doc, units.width)


def _parted(s: Segments, hot: np.ndarray, chunk: Chunk, units: Units) -> tuple[Segments, np.ndarray]:
    """The segments with the hot ones parted by a second minimiser, and which of s each one comes from."""
    which = np.flatnonzero(hot)
    if not len(which):
        return s, np.arange(len(s.first))
    first, count = s.first[which], s.count[which]
    length = count + units.width - 1
    at = ranges(first, length)
    if units.words:
        words = run_hashes(span_hashes(chunk.data, s.starts, s.ends), units.k)
        hashes = words[np.minimum(at, len(words) - 1)]
    else:
        hashes = np.concatenate([_byte_kmers(_BYTE_VALUES[chunk.data[at]], units.k), np.zeros(units.k - 1, np.uint64)])
    # the k-mers that don't begin in a segment's windows are not looked at
    least = _least(mix(hashes ^ SALT), units.width - units.k + 1)
    windows = ranges(np.cumsum(length) - length, count)
    second, owner = least[windows], np.repeat(np.arange(len(which)), count)
    new = np.ones(len(second), bool)
    new[1:] = (second[1:] != second[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    source = which[owner[heads]]
    keys = mix(s.minimiser[source] ^ second[heads])
    cold = np.flatnonzero(~hot)
    begin = ranges(first, count)[heads]
    parts = [np.concatenate(x) for x in ((s.first[cold], begin), (s.count[cold], np.diff(heads, append=len(second))), (s.minimiser[cold], keys))]
    source = np.concatenate([cold, source])
    order = np.argsort(parts[0], kind="stable")
    several = np.concatenate([s.several[cold], np.ones(len(heads), bool)])
    return Segments(*(x[order] for x in parts), several[order], s.starts, s.ends, s.doc, s.width), source[order]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of [s, s + c) for all pairs, one range after the other."""
    stop = np.cumsum(counts, dtype=np.int64)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - (stop - counts), counts)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by bucket and key, and the border of each bucket in that order."""
    bucket = keys % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _sent_minimisers(s: Segments, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different minimisers in the order in which they are sent, how often each occurs here, bucket borders."""
    keys, inverse, counts = np.unique(s.minimiser, return_inverse=True, return_counts=True)
    counts[inverse[s.several]] += 1
    order, borders = _by_bucket(keys, buckets)
    return keys[order], np.minimum(counts[order], 255).astype(np.uint8), borders


def _send_minimisers(units: Units, buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("gid", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = open_chunk(*row)
            keys, counts, borders = _sent_minimisers(segments(chunk, units), buckets)
            some = np.flatnonzero(np.diff(borders))
            out = [(int(b), chunk.gid, keys[borders[b] : borders[b + 1]].tobytes(), counts[borders[b] : borders[b + 1]].tobytes()) for b in some]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _answer(table: pa.Table, masks: list[bytes]) -> pa.Table:
    return pa.table({"gid": table.column("gid"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})


def _answer_minimisers(hot: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _minimisers_again(table, hot)


def _minimisers_again(table: pa.Table, hot: int) -> pa.Table:
    sent = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
    _, inverse = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(inverse, counts)[inverse]
    marks = np.split(np.stack([total > 1, total >= hot], axis=1), np.cumsum([len(k) for k in sent])[:-1])
    return _answer(table, [np.packbits(m).tobytes() for m in marks])


def _wanted(chunk: Chunk, units: Units, answers: list, buckets: int) -> tuple[Segments, np.ndarray]:
    """The segments of a chunk, parted where the minimiser is hot, and which have one that occurs again."""
    s = segments(chunk, units)
    keys, _, borders = _sent_minimisers(s, buckets)
    found = np.zeros((len(keys), 2), bool)
    for a in answers or ():
        b, n = a["bucket"], int(borders[a["bucket"] + 1] - borders[a["bucket"]])
        found[borders[b] : borders[b + 1]] = np.unpackbits(np.frombuffer(a["mask"], np.uint8), count=2 * n).reshape(n, 2)
    order = np.argsort(keys)
    again, hot = found[order][np.searchsorted(keys[order], s.minimiser)].T
    parted, source = _parted(s, hot, chunk, units)
    return parted, again[source]


@dataclass
class Different:
    """The different super-k-mers of a chunk that are sent, in order; of all wanted ones: index and place."""

    chosen: np.ndarray  # wanted segments
    which: np.ndarray  # of each, the number of its string in the order of sending
    head: np.ndarray  # of each string, the segment with its first place
    twice: np.ndarray
    borders: np.ndarray


def _different(chunk: Chunk, s: Segments, wanted: np.ndarray, buckets: int) -> Different:
    data = chunk.data.tobytes()
    chosen = np.flatnonzero(wanted)
    offset = s.first[chosen] - np.searchsorted(s.doc, s.doc[s.first[chosen]]) if len(chosen) else chosen
    # in the order of places, so that a string's first entry is its first place
    order = np.lexsort((offset, chunk.ids[s.doc[s.first[chosen]]])) if len(chosen) else chosen
    chosen = chosen[order]
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(*s.spans(chosen))], np.int64)
    _, head = np.unique(which, return_index=True)
    counts = np.bincount(which, minlength=len(number))
    sent, borders = _by_bucket(s.minimiser[chosen[head]] if len(head) else np.zeros(0, np.uint64), buckets)
    back = np.empty(len(sent), np.int64)
    back[sent] = np.arange(len(sent))
    return Different(chosen, back[which] if len(which) else which, chosen[head][sent], counts[sent] > 1, borders)


def _doc_offsets(s: Segments, docs: np.ndarray) -> np.ndarray:
    """Number of the first unit of each document."""
    return np.searchsorted(s.doc, docs)


_HEAD = np.dtype([("minimiser", "<u8"), ("id", "<i8"), ("start", "<i8"), ("count", "<i4"), ("length", "<i4"), ("twice", "u1"), ("several", "u1")])


def _send_segments(units: Units, buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("gid", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squash = zstandard.ZstdCompressor(level=1)
        for *row, answers in rows_of(batches):
            chunk = open_chunk(*row)
            s, wanted = _wanted(chunk, units, answers, buckets)
            d = _different(chunk, s, wanted, buckets)
            data = chunk.data.tobytes()
            out = []
            for b in np.flatnonzero(np.diff(d.borders)):
                sent = slice(d.borders[b], d.borders[b + 1])
                own = d.head[sent]
                texts = s.texts(data, own)
                head = np.zeros(len(own), _HEAD)
                docs = s.doc[s.first[own]]
                head["minimiser"], head["count"], head["twice"], head["several"] = s.minimiser[own], s.count[own], d.twice[sent], s.several[own]
                head["id"], head["start"] = chunk.ids[docs], s.first[own] - _doc_offsets(s, docs)
                head["length"] = [len(t) for t in texts]
                out.append((int(b), chunk.gid, len(own), squash.compress(head.tobytes() + b"".join(texts))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


#: Of different super-k-mers in the order of their first places, with their counts of windows: whether each window (all
#: in a row) stands at an earlier place too, and at a later one.
Compare = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]


def _answer_segments(compare: Compare, keep_first: bool, batch_bytes: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        heads, bodies, unpack = [], [], zstandard.ZstdDecompressor()
        for n, packed in zip(table.column("n").to_pylist(), table.column("packed")):
            raw = unpack.decompress(packed.as_py())
            heads.append(np.frombuffer(raw, _HEAD, n))
            bodies.append(raw[n * _HEAD.itemsize :])
        head = np.concatenate(heads)
        body = b"".join(bodies)
        ends = np.cumsum(head["length"], dtype=np.int64)
        begin = ends - head["length"]
        at = np.cumsum(head["count"], dtype=np.int64) - head["count"]
        marks = np.zeros(int(head["count"].sum()), bool)
        order = np.lexsort((head["start"], head["id"], head["minimiser"]))
        group = np.flatnonzero(np.diff(head["minimiser"][order], prepend=head["minimiser"][order[0]] ^ np.uint64(1)))
        group = np.append(group, len(order))
        k = 0
        while k < len(group) - 1:
            # whole minimisers up to the bytes of a batch
            size, j = 0, k
            while j < len(group) - 1 and (j == k or size < batch_bytes):
                size += int(head["length"][order[group[j] : group[j + 1]]].sum())
                j += 1
            entries = order[group[k] : group[j]]
            entries = entries[np.lexsort((head["start"][entries], head["id"][entries]))]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(body[begin[e] : ends[e]], len(number)) for e in entries.tolist()], np.int64)
            firsts = entries[np.unique(which, return_index=True)[1]]
            counts = head["count"][firsts]
            total = np.bincount(which, 1 + head["twice"][entries], minlength=len(number))
            border = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            # where the k-mer stands in one place, the windows of a super-k-mer differ: one without others has no match
            _, own, company = np.unique(head["minimiser"][firsts], return_inverse=True, return_counts=True)
            some = np.flatnonzero((company[own] > 1) | (head["several"][firsts] > 0))
            earlier, later = np.zeros(border[-1], bool), np.zeros(border[-1], bool)
            if len(some):
                strings = list(number)
                at_windows = ranges(border[some], counts[some])
                earlier[at_windows], later[at_windows] = compare([strings[i] for i in some.tolist()], counts[some])
            for e, w in zip(entries.tolist(), which.tolist()):
                f = firsts[w]
                if keep_first:
                    same_place = head["id"][e] == head["id"][f] and head["start"][e] == head["start"][f]
                    mark = earlier[border[w] : border[w + 1]] if same_place else True
                else:
                    mark = True if total[w] > 1 else earlier[border[w] : border[w + 1]] | later[border[w] : border[w + 1]]
                marks[at[e] : at[e] + head["count"][e]] = mark
            k = j
        borders = np.cumsum([0, *[h["count"].sum() for h in heads]])
        if len(body) > batch_bytes:
            give_back()
        return _answer(table, [np.packbits(marks[a:b]).tobytes() for a, b in zip(borders[:-1], borders[1:])])

    return run


#: From a chunk, its layout and the units to remove: a record batch.
Finish = Callable[[Chunk, Segments, np.ndarray], pa.RecordBatch]


def _apply(units: Units, buckets: int, keep_first: bool, finish: Finish) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, first_answers, answers in rows_of(batches):
            chunk = open_chunk(*row)
            s, wanted = _wanted(chunk, units, first_answers, buckets)
            d = _different(chunk, s, wanted, buckets)
            counts = s.count[d.head]
            border = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            marks = np.zeros(int(border[-1]), bool)
            for a in answers or ():
                b0, b1 = border[d.borders[a["bucket"]]], border[d.borders[a["bucket"] + 1]]
                marks[b0:b1] = np.unpackbits(np.frombuffer(a["mask"], np.uint8), count=int(b1 - b0))
            edges = np.zeros(len(s.doc) + 1, np.int32)
            if keep_first and len(d.chosen):
                docs = s.doc[s.first[d.chosen]]
                ids, offset = chunk.ids[docs], s.first[d.chosen] - _doc_offsets(s, docs)
                heads = np.empty(len(d.head), np.int64)
                heads[d.which[::-1]] = np.arange(len(d.chosen))[::-1]  # the first entry of each string
                h = heads[d.which]
                elsewhere = (ids != ids[h]) | (offset != offset[h])  # not its string's first place
            reached = np.cumsum(s.count[d.chosen])
            cuts = np.searchsorted(reached, np.arange(0, reached[-1], WINDOWS)) if len(reached) else []
            for k0, k1 in zip(cuts, [*cuts[1:], len(reached)]):
                first, n = s.first[d.chosen[k0:k1]], s.count[d.chosen[k0:k1]]
                on = marks[ranges(border[d.which[k0:k1]], n)]
                if keep_first:
                    on |= np.repeat(elsewhere[k0:k1], n)
                window = ranges(first, n)[on]
                edges[window] += 1  # segments share no windows
                edges[window + units.width] -= 1
            yield finish(chunk, s, np.cumsum(edges, out=edges)[:-1] > 0)

    return run


def remove_repeats(docs: DataFrame, what: str, units: Units, compare: Compare, keep_first: bool, finish: Finish, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mark the units that repeated windows cover (but for the first copy, if keep_first) and return finish()'s rows."""
    chunks = pack_chunks(docs, f"{what}-chunks", squeeze=units.words, carry=carry)
    total = chunks.agg(F.sum("raw_bytes")).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    gathered = lambda df, name: df.groupBy("gid").agg(F.collect_list(F.struct("bucket", "mask")).alias(name))
    reply = "gid long, bucket int, mask binary"
    sent = chunks.mapInArrow(_send_minimisers(units, buckets), "bucket int, gid long, keys binary, counts binary")
    again = stored(gathered(sent.groupBy("bucket").applyInArrow(_answer_minimisers(units.hot), reply), "again"), f"{what}-again")
    asked = chunks.join(again.hint("merge"), "gid").select(*_CHUNKS.names, "again")
    strings = asked.mapInArrow(_send_segments(units, buckets), "bucket int, gid long, n int, packed binary")
    marks = stored(gathered(strings.groupBy("bucket").applyInArrow(_answer_segments(compare, keep_first, units.batch_bytes), reply), "marks"), f"{what}-marks")
    done = chunks.join(again.hint("merge"), "gid", "left").join(marks.hint("merge"), "gid", "left").select(*_CHUNKS.names, "again", "marks")
    return done.mapInArrow(_apply(units, buckets, keep_first, finish), schema)
