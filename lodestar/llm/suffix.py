"""Longest-previous-factor arrays in numpy: suffixes in order, their common prefixes, and the smaller positions around them.

``Suffixes`` orders the suffixes of a set of strings by prefix doubling and keeps the ranks of every level, which give the
length that two suffixes share. In suffix order, the previous and the next entry with a smaller position are the only
candidates for the longest earlier match of a suffix (Crochemore and Ilie), and what it shares with either is the least
common prefix on the way there. The larger of the two is the longest previous factor; with larger positions instead, the
same gives the longest match that starts later.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the first level: as many digits of base 257 (0 for the end of a string) as a 64-bit number holds.
FIRST = 7


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the different keys."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    step = np.empty(len(keys), np.int32)
    step[:1] = 0
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=step[1:], casting="unsafe")
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    return out


class Suffixes:
    """The suffixes of strings in order, by their first ``depth`` bytes at least; a string that ends comes before longer ones.

    room: how many bytes each position has up to the end of its string; nothing is compared across that end.
    """

    def __init__(self, data: np.ndarray, room: np.ndarray, depth: int) -> None:
        n = len(data)
        self.room = room
        value = np.zeros(n + FIRST, np.int64)
        value[:n] = data
        value[:n] += 1
        keys = np.zeros(n, np.int64)
        for k in range(FIRST):
            keys *= 257
            keys += np.where(room > k, value[k : n + k], 0)
        self.levels = [(FIRST, _dense(keys))]
        head = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
        for k in (1, 2, 4):
            head[:-k] = head[:-k] << np.uint64(8 * k) | head[k:]
        self.head = head  # the eight bytes from each position on
        longest = int(room.max(initial=0))
        while self.levels[-1][0] < min(depth, longest):
            width, rank = self.levels[-1]
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:]
            after += 1
            after[room <= width] = 0
            self.levels.append((2 * width, _dense(rank.astype(np.int64) << 32 | after)))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, up to the depth."""
        length = np.zeros(len(a), np.int64)
        room = np.minimum(self.room[a], self.room[b])
        for k, (width, rank) in enumerate(reversed(self.levels)):
            # the widest level may hold twice, as it is the last; a narrower one can't
            for _ in range(2 if k == 0 else 1):
                open_ = length < room
                x, y = np.where(open_, a + length, 0), np.where(open_, b + length, 0)
                length += width * (open_ & (rank[x] == rank[y]))
        # what is left is shorter than the first level
        left = np.flatnonzero(length < room)
        differ = self.head[a[left] + length[left]] ^ self.head[b[left] + length[left]]
        for k in range(1, FIRST):
            length[left] += differ < np.uint64(1 << (64 - 8 * k))
        return np.minimum(length, room)


def smaller_before(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the last entry before it with a smaller value, or -1; and the least of shared on the way there.

    shared: what each entry has in common with the one before it. Pointer jumping, all entries at once: between an entry
    and the one it points to, no value is smaller than its own.
    """
    n = len(values)
    to, least = np.arange(-1, n - 1), shared.copy()
    open_ = np.flatnonzero(to >= 0)
    while len(open_):
        open_ = open_[values[to[open_]] >= values[open_]]
        over = to[open_]
        least[open_] = np.minimum(least[open_], least[over])
        to[open_] = to[over]
        open_ = open_[to[open_] >= 0]
    least[to < 0] = 0
    return to, least


def longest_factors(suffixes: Suffixes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of at (ascending): the longest match with one of them that is earlier, and that is later.

    Matches may overlap; lengths are exact up to the depth of the suffixes.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(suffixes.levels[-1][1][at], kind="stable")
    place = at[order]
    shared = np.zeros(n, np.int64)
    shared[1:] = suffixes.shared(place[1:], place[:-1])
    after = np.append(shared[1:], 0)[::-1]  # with the next entry, from the end
    found = []
    for values in (place, -place):
        _, before = smaller_before(values, shared)
        _, behind = smaller_before(values[::-1], after)
        length = np.empty(n, np.int64)
        length[order] = np.maximum(before, behind[::-1])
        found.append(length)
    return found[0], found[1]


def longest_previous_factor(data: bytes) -> np.ndarray:
    """For each position, the length of the longest match that starts earlier (and may overlap)."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    return longest_factors(Suffixes(text, n - np.arange(n), n), np.arange(n))[0]
