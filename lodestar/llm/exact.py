"""Removal of exact repeats: byte strings by suffix arrays, word windows by sorting super-k-mers.

``suffix_dedup`` removes the bytes that repeated strings of ``width`` bytes cover. Where super-k-mers meet in a bucket, a
suffix array of them in the order of their places gives longest-previous-factor arrays, from the previous and next smaller
positions in suffix order: a factor of ``width`` bytes or more starts earlier or, with larger positions, later. With
``keep_first`` the first copy of every string stays; without, all copies go.

``window_dedup`` removes the words that repeated windows of ``width`` words cover. In a bucket, the windows of its
different super-k-mers are sorted as strings, and equal neighbours are counted.

Both judge strings on the input. Null texts count as empty; texts without a whole window lose nothing. Places are ordered
by doc_id (nulls last) and start; two rows of one doc_id and text are copies of each other in ``suffix_dedup`` without
keep_first, and otherwise neither is earlier than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.repeats import NULL_ID, Chunk, Segments, Units, remove_repeats
from lodestar.llm.suffix import Suffixes, longest_factors

BYTES, WORDS = 200, 20


def compare_bytes(texts: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(data))
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    previous, following = longest_factors(Suffixes(data, room, width), at)
    return previous >= width, following >= width


def compare_words(texts: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    windows: list[bytes] = []
    for text, n in zip(texts, counts.tolist()):
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
        starts = [0, *(g + 1 for g in gaps)]
        ends = [*gaps, len(text)]
        windows += [text[starts[i] : ends[i + width - 1]] for i in range(n)]
    order = sorted(range(len(windows)), key=windows.__getitem__)  # stable: equal windows in the order of places
    equal = np.array([windows[a] == windows[b] for a, b in zip(order, order[1:])], bool)
    earlier, later = np.zeros(len(windows), bool), np.zeros(len(windows), bool)
    if len(order) > 1:
        places = np.array(order)
        earlier[places[1:]] = equal
        later[places[:-1]] = equal
    return earlier, later


def _finish(words: bool, with_text: bool, chunk: Chunk, s: Segments, removed: np.ndarray) -> pa.RecordBatch:
    data = chunk.data.tobytes()
    bounds = np.searchsorted(s.doc, np.arange(len(chunk.ids) + 1))
    unit = "n_words" if words else "n_bytes"
    out: dict[str, list] = {"doc_id": [], unit: [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
    for i, (doc_id, a, b) in enumerate(zip(chunk.ids.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())):
        gone = removed[a:b]
        n = int(gone.sum())
        if not n:
            kept = data[chunk.starts[i] : chunk.ends[i]] if not words else data[s.starts[a] : s.ends[b - 1]] if b > a else b""
        elif words:
            kept = b" ".join([data[s.starts[k] : s.ends[k]] for k in (a + np.flatnonzero(~gone)).tolist()])
        else:
            kept = chunk.data[a:b][~gone].tobytes()
        out["doc_id"].append(None if doc_id == NULL_ID else doc_id)
        out[unit].append(b - a)
        out["n_removed"].append(n)
        out["n_spans"].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if n else 0)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["text"].append(kept.decode("utf-8", "ignore") if with_text else None)
    columns = [pa.array(v, pa.string() if k in ("kept_sha256", "text") else pa.int64()) for k, v in out.items()]
    names = list(out)
    if chunk.packed:
        carried = chunk.carried
        names += carried.column_names
        columns += [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in carried.columns]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _dedup(docs: DataFrame, what: str, units: Units, compare: Callable, keep_first: bool, with_text: bool, carry: tuple[str, ...]) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = f"doc_id long, {'n_words' if units.words else 'n_bytes'} long, n_removed long, n_spans long, kept_sha256 string, text string"
    schema += "".join(f", `{c}` {kinds[c]}" for c in carry)
    done = remove_repeats(docs, what, units, partial(compare, width=units.width), keep_first, partial(_finish, units.words, with_text), schema, carry)
    return done if with_text else done.drop("text")


def suffix_dedup(docs: DataFrame, width: int = BYTES, keep_first: bool = True, with_text: bool = True, carry: tuple[str, ...] = (), **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the kept text (characters cut in two go), carried columns. limits: of Units."""
    return _dedup(docs, "suffix", Units(False, width, 32 if width >= 64 else 8, **limits), compare_bytes, keep_first, with_text, carry)


def window_dedup(docs: DataFrame, width: int = WORDS, keep_first: bool = True, with_text: bool = True, carry: tuple[str, ...] = (), **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, the kept words joined by blanks, carried columns. limits: of Units."""
    return _dedup(docs, "windows", Units(True, width, min(5, width), **limits), compare_words, keep_first, with_text, carry)
