"""Media columns: baseline JPEG images kept as a binary column, and what is read back from them.

A payload of 64-byte blocks becomes a grey baseline JPEG in which each 8 x 8 block has 64 quantised coefficients, one for
each byte: 0 for a zero byte, and small ones for the bytes that prose is made of (``VALUE``). Nothing is lost. Differences
of DC coefficients and runs of AC coefficients are entropy-coded with tables of codes of 2 to 16 bits that stand in the
file; every ``RESTART`` blocks a restart marker ends an interval, so intervals can be decoded side by side.

The decoder is one for all baseline files (any tables, 1 to 4 components, subsampling, restart intervals): it parses the
markers, makes a table of all 16-bit windows from each Huffman table, and reads symbol by symbol, in time proportional to
the scan. Scans with many restart intervals are read in numpy, one symbol of every interval at a time; others by a loop
over the same tables. The thumbnail takes the DC coefficients of the first component alone, one sample a block.

Rows: null media or bytes that are not a baseline JPEG give null dimensions and features (``error`` says why); a null
or empty text is stored as one block of zeros. Repeated rows are stored and read each on its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import byte_groups, clean_docs, stored, text_column

BLOCK = 64
#: Blocks in a row of the image, as far as there are so many.
ROW_BLOCKS = 64
MOST_BLOCKS = 8191  # of 8 samples each, in 16 bits
#: Blocks between restart markers.
RESTART = 4
#: Payload bytes that are coded at a time, and intervals that are decoded side by side.
SECTION = 1 << 20
LANES = 8192
#: Scans with fewer intervals are read by the loop.
FEW_LANES = 16
COMMENT = b"payload-bytes:"

#: Bytes from frequent to rare; those left follow in their own order. The k-th has coefficient 1, -1, 2, -2, ...
FREQUENT = b" etaoinsrhldcu\xc3mfpgwybvk.,\xa9\n0123456789-'\"TASICEMPRDBNLHOFGWUKVYJQXZjxqz:;()/\xa8\xa0"


def _values() -> np.ndarray:
    order = list(dict.fromkeys([*FREQUENT, *range(1, 256)]))
    out = np.zeros(256, np.int16)
    out[order] = [(k // 2 + 1) * (1 if k % 2 == 0 else -1) for k in range(255)]
    return out


VALUE = _values()
#: The byte of each coefficient from -128 to 128 (at coefficient + 128).
BYTE = np.zeros(257, np.uint8)
BYTE[VALUE + 128] = np.arange(256)

#: Code lengths of the writer's tables: of the sizes of DC differences, and of AC symbols (run << 4 | size). Codes of symbols
#: with zeros before them are longer than the others, so images that have none carry only the front part of the table.
DC_LENGTHS = {5: 2, 4: 2, 6: 3, 3: 3, 7: 4, 2: 4, 8: 5, 1: 6, 0: 7, 9: 9, 10: 10, 11: 11}
AC_LENGTHS = {0x01: 2, 0x02: 2, 0x03: 2, 0x04: 4, 0x06: 4, 0x05: 5, 0x07: 6, 0x00: 7, 0x08: 8, 0xF0: 10, 0x11: 11, 0x12: 11, 0x13: 11, 0x14: 11, 0x17: 12, 0x18: 12}
AC_LENGTHS |= {run << 4 | size: 16 for run in range(16) for size in range(1, 11) if run << 4 | size not in AC_LENGTHS}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """Counts of codes by length, and the symbols in the order of their codes."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == k for v in lengths.values()) for k in range(1, 17)), bytes(symbols)


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol."""
    code, k, found = 0, 0, {}
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            if k >= len(symbols) or code >> length:
                raise NotBaseline("a damaged Huffman table")
            found[symbols[k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return found


class NotBaseline(ValueError):
    """The bytes are not a baseline JPEG that this module reads."""


_DC, _AC = _canonical(DC_LENGTHS), _canonical(AC_LENGTHS)
_FRONT = _canonical({s: n for s, n in AC_LENGTHS.items() if s < 9})
_TABLES = [_segment(0xC4, b"\x00" + b"".join(_DC) + b"\x10" + b"".join(ac)) for ac in (_FRONT, _AC)]


# ---------------------------------------------------------------- writing


def _amplitude(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << size) - 1), size


def _bit_tables() -> tuple[np.ndarray, ...]:
    """Bits and their number for each DC difference (-256 to 256), and for each run of zeros and AC coefficient after it."""
    dc, ac = _codes(*_DC), _codes(*_AC)
    dc_bits, dc_size = np.zeros(513, np.uint64), np.zeros(513, np.int64)
    for d in range(-256, 257):
        bits, size = _amplitude(d)
        code, length = dc[size]
        dc_bits[d + 256], dc_size[d + 256] = code << size | bits, length + size
    ac_bits, ac_size = np.zeros((64, 257), np.uint64), np.zeros((64, 257), np.int64)
    skip, skip_length = ac[0xF0]
    for run in range(63):
        for v in range(-128, 129):
            if v:
                bits, size = _amplitude(v)
                code, length = ac[run % 16 << 4 | size]
                lead = 0
                for _ in range(run // 16):
                    lead = lead << skip_length | skip
                ac_bits[run, v + 128] = lead << (length + size) | code << size | bits
                ac_size[run, v + 128] = run // 16 * skip_length + length + size
    return dc_bits, dc_size, ac_bits.ravel(), ac_size.ravel()


_DC_BITS, _DC_SIZE, _AC_BITS, _AC_SIZE = _bit_tables()
_EOB, _EOB_LENGTH = _codes(*_AC)[0]


def _coded(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entropy-coded bytes of blocks, how many each interval has, and the blocks with zeros before a coefficient.

    first: the blocks that begin an interval.
    """
    coefs = VALUE[values]
    dc = coefs[:, 0].copy()
    step = np.diff(dc, prepend=np.int16(0))
    step[first] = dc[first]
    there = coefs != 0
    there[:, 0] = True
    at = np.flatnonzero(there.ravel())
    run = np.diff(at, prepend=0) - 1
    key = run * 257 + coefs.ravel()[at] + 128
    is_dc = at % BLOCK == 0
    key[is_dc] = 0
    bits, size = _AC_BITS[key], _AC_SIZE[key]
    bits[is_dc], size[is_dc] = _DC_BITS[step + 256], _DC_SIZE[step + 256]
    heads = np.flatnonzero(is_dc)
    tails = np.append(heads[1:], len(at)) - 1
    short = tails[at[tails] % BLOCK != BLOCK - 1]
    bits[short] = bits[short] << np.uint64(_EOB_LENGTH) | np.uint64(_EOB)
    size[short] += _EOB_LENGTH
    # an interval ends on a whole byte, filled up with ones
    begin = heads[first]
    ends = np.append(begin[1:], len(at)) - 1
    total = np.add.reduceat(size, begin)
    fill = -total % 8
    bits[ends] = bits[ends] << fill.astype(np.uint64) | ((1 << fill) - 1).astype(np.uint64)
    size[ends] += fill
    stop = np.cumsum(size)
    start = stop - size
    words = np.zeros((int(stop[-1]) >> 6) + 2, np.uint64)
    word, offset = start >> 6, start & 63
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.bitwise_or.reduceat(bits << (64 - size).astype(np.uint64) >> offset.astype(np.uint64), heads)
    over = np.flatnonzero(offset + size > 64)
    words[word[over] + 1] |= bits[over] << (128 - offset[over] - size[over]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: int(stop[-1]) >> 3], (total + fill) >> 3, np.unique(at[(run > 0) & ~is_dc] // BLOCK)


def _framed(data: np.ndarray, lengths: np.ndarray, marker: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Intervals with zeros after bytes of 255 and a marker after each; and where each ends."""
    full = data == 0xFF
    before = np.cumsum(full) - full
    number = np.repeat(np.arange(len(lengths)), lengths)
    stops = np.cumsum(lengths + 2 + np.add.reduceat(full, np.cumsum(lengths) - lengths, dtype=np.int64))
    out = np.zeros(int(stops[-1]), np.uint8)
    out[np.arange(len(data)) + before + 2 * number] = data
    out[stops - 2], out[stops - 1] = 0xFF, marker
    return out.tobytes(), stops


def pad(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of the block."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def _shape(n: int) -> tuple[int, int]:
    """Blocks across and down of an image with n blocks."""
    across = min(n, max(ROW_BLOCKS, -(-n // MOST_BLOCKS)))
    if across > MOST_BLOCKS:
        raise ValueError("the payload is too long for one image")
    return across, -(-n // across)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, whose coefficients in zigzag order stand for the payload's bytes."""
    shapes, blocks = [], []
    for payload in payloads:
        if not payload or len(payload) % BLOCK:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        across, down = _shape(len(payload) // BLOCK)
        shapes.append((across, down))
        blocks.append(payload + bytes(across * down * BLOCK - len(payload)))
    counts = np.array([a * d for a, d in shapes])
    values = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK)
    ends = np.cumsum(counts)
    # intervals begin anew with each image
    inside = np.arange(len(values)) - np.repeat(ends - counts, counts)
    first = np.flatnonzero(inside % RESTART == 0)
    marker = (0xD0 + inside[first] // RESTART % 8).astype(np.uint8)
    last = np.searchsorted(first, ends) - 1
    marker[last] = 0xD9
    scans, stops, done, gappy = [], [], 0, set()
    step = SECTION // BLOCK // RESTART
    for k in range(0, len(first), step):
        some = first[k : k + step]
        upto = first[k + step] if k + step < len(first) else len(values)
        data, lengths, gaps = _coded(values[some[0] : upto], some - some[0])
        body, stop = _framed(data, lengths, marker[k : k + step])
        gappy.update(np.searchsorted(ends, gaps + some[0], "right").tolist())
        scans.append(body)
        stops.append(stop + done)
        done += len(body)
    scan, stop = b"".join(scans), np.concatenate(stops)[last].tolist()
    out = []
    for k, (payload, (across, down), a, b) in enumerate(zip(payloads, shapes, [0, *stop], stop)):
        head = (
            b"\xff\xd8",
            _segment(0xFE, COMMENT + str(len(payload)).encode()),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\x01\x11\x00"),
            _TABLES[k in gappy],
            _segment(0xDD, struct.pack(">H", RESTART)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
        out.append(b"".join((*head, scan[a:b])))
    return out


def encode_jpeg(payload: bytes) -> bytes:
    return encode_batch([payload])[0]


# ---------------------------------------------------------------- reading


def parse_markers(media: bytes) -> dict:
    """Frame, tables, comment and scan data (with its last marker) of a baseline JPEG."""
    if media[:2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    out: dict = {"quant": {}, "huffman": {}, "restart": 0, "comment": b""}
    at = 2
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise NotBaseline("no marker where one should be")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                size = 128 if wide else 64
                out["quant"][name] = np.frombuffer(body[k + 1 : k + 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
                k += 1 + size
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                symbols = body[k + 17 : k + 17 + sum(counts)]
                out["huffman"][body[k]] = (counts, symbols)
                k += 17 + len(symbols)
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            out["frame"] = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)])
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise NotBaseline("not a baseline frame")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            if "frame" not in out:
                raise NotBaseline("a scan before its frame")
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = media.rfind(b"\xff\xd9")
            out["data"] = media[at:end] if end >= at else media[at:]
            return out
    raise NotBaseline("no scan")


_WINDOWS: dict[tuple[bytes, bytes, bool], np.ndarray] = {}


def windows(counts: bytes, symbols: bytes, ac: bool) -> np.ndarray:
    """What each 16-bit window begins with: value << 16 | zeros before it << 8 | bits taken.

    Windows that the amplitude goes beyond have 0x80 among the bits, and the size for a value; wrong codes are 0. The end
    of a block counts as 64 zeros.
    """
    key = (counts, symbols, ac)
    if key not in _WINDOWS:
        if len(_WINDOWS) >= 64:
            _WINDOWS.clear()
        out = np.zeros(1 << 16, np.int32)
        for symbol, (code, length) in _codes(counts, symbols).items():
            run, size = (symbol >> 4, symbol & 15) if ac else (0, symbol)
            if ac and not size and run != 15:
                run = 64
            low, room = code << (16 - length), 16 - length
            if size <= room:
                every = np.arange(1 << size)
                value = np.where(every >> max(size - 1, 0) == 1, every, every - (1 << size) + 1) if size else every
                out[low : low + (1 << room)] = np.repeat(value << 16 | run << 8 | length + size, 1 << (room - size))
            else:
                out[low : low + (1 << room)] = size << 16 | run << 8 | 0x80 | length
        _WINDOWS[key] = out
    return _WINDOWS[key]


@dataclass
class Layout:
    """How the scan of an image runs: units across and down, and the blocks of a unit: whose, and with which tables."""

    units_x: int
    units_y: int
    own_h: int
    own_v: int
    pattern: tuple[tuple[int, tuple, tuple], ...]  # component, DC table, AC table

    @classmethod
    def of(cls, head: dict) -> Layout:
        width, height, parts = head["frame"]
        if not (width and height and parts and head["scan"]):
            raise NotBaseline("an empty frame")
        most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
        in_scan = {s[0]: s for s in head["scan"]}
        name, h, v, _ = parts[0]
        if name not in in_scan:
            raise NotBaseline("the first scan lacks the first component")
        alone = len(in_scan) == 1
        if alone:
            x, y = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
        else:
            x, y = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        pattern = []
        for k, part in enumerate(parts):
            if part[0] in in_scan:
                _, dc, ac = in_scan[part[0]]
                pattern += [(k, head["huffman"][dc], head["huffman"][0x10 | ac])] * (1 if alone else part[1] * part[2])
        return cls(x, y, *((1, 1) if alone else (h, v)), tuple(pattern))

    def arranged(self, blocks: np.ndarray) -> np.ndarray:
        """Blocks of the first component, unit by unit, as (down, across, 64)."""
        grid = blocks.reshape(self.units_y, self.units_x, self.own_v, self.own_h, 64)
        return grid.transpose(0, 2, 1, 3, 4).reshape(self.units_y * self.own_v, self.units_x * self.own_h, 64)


def _lanes(data: np.ndarray, at: np.ndarray, units: np.ndarray, pattern: tuple, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First-component blocks of each interval (interval, block, 64), and the bit after it, -1 where it is damaged.

    at: the first bit of each interval; units: how many units it has, descending; data ends with 16 spare bytes.
    """
    bytes8 = np.ndarray((len(data) - 8,), ">u8", buffer=data, strides=(1,))
    own = sum(k == pattern[0][0] for k, _, _ in pattern)
    out = np.zeros((len(at), most * own, 64), np.int16)
    parts = max(k for k, _, _ in pattern) + 1
    at, good = at.copy(), np.ones(len(at), bool)
    spare = 8 * (len(data) - 9)

    def read(table: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = at[who]
        word = bytes8[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        taken, value = found & 0xFF, found >> 16
        odd = np.flatnonzero((taken >= 0x80) | (taken == 0))
        if len(odd):
            length, size = taken[odd] & 0x7F, value[odd]
            good[who[odd[taken[odd] == 0]]] = False
            amplitude = (word[odd] << length.astype(np.uint64) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int32)
            value[odd] = np.where(amplitude >> np.maximum(size - 1, 0) == 1, amplitude, amplitude - (1 << size) + 1) * (size > 0)
            taken[odd] = length + size
        at[who] = np.minimum(p + taken, spare)
        return value, found >> 8 & 0xFF

    for unit in range(int(units.max(initial=0))):
        running = np.arange(int(np.searchsorted(-units, -unit, "left")))
        if unit == 0:
            last = np.zeros((len(at), parts), np.int32)
        block = unit * own
        for k, dc, ac in pattern:
            value, _ = read(windows(*dc, False), running)
            last[running, k] += value
            if mine := k == pattern[0][0]:
                out[running, block, 0] = last[running, k]
            table, who, place = windows(*ac, True), running, np.ones(len(running), np.int64)
            while len(who):
                value, zeros = read(table, who)
                place += zeros
                if place.max(initial=0) >= 64:
                    good[who[(place >= 64) & (zeros < 64)]] = False
                    go = place < 64
                    who, place, value = who[go], place[go], value[go]
                if mine:
                    out[who, block, place] = value
                place += 1
                if place.max(initial=0) >= 64:
                    go = place < 64
                    who, place = who[go], place[go]
            block += mine
    return out, np.where(good, at, -1)


def _loop(data: bytes, at: int, units: int, tables: list) -> tuple[np.ndarray, int]:
    """The same for one interval, symbol by symbol."""
    first = tables[0][0]
    out = np.zeros((units * sum(k == first for k, _, _ in tables), 64), np.int16)
    flat = memoryview(out.reshape(-1))
    last = dict.fromkeys((k for k, _, _ in tables), 0)
    spare, block = 8 * (len(data) - 9), 0
    word, base = 0, -64  # 64 bits from bit base on
    for _ in range(units):
        for k, dc, ac in tables:
            mine = k == first
            place, table = 0, dc
            while place < 64:
                shift = at - base
                if shift > 32:
                    if at > spare:
                        return out, -1
                    base = at & ~7
                    word, shift = int.from_bytes(data[base >> 3 : (base >> 3) + 8]), at - base
                found = table[word >> 48 - shift & 0xFFFF]
                taken, value = found & 0xFF, found >> 16
                if taken >= 0x80 or not taken:
                    if not taken:
                        return out, -1
                    taken &= 0x7F
                    size = value
                    value = int.from_bytes(data[at >> 3 : (at >> 3) + 8]) >> 64 - (at & 7) - taken - size & (1 << size) - 1
                    if not value >> size - 1:
                        value -= (1 << size) - 1
                    taken += size
                at += taken
                zeros = found >> 8 & 0xFF
                if not place:
                    last[k] += value
                    if mine:
                        flat[block * 64] = last[k]
                    place, table = 1, ac
                    continue
                place += zeros
                if place >= 64:
                    if zeros < 64:
                        return out, -1
                    break
                if mine and value:
                    flat[block * 64 + place] = value
                place += 1
            block += mine
    return out, at


def decode_scans(heads: list[dict]) -> list[np.ndarray | NotBaseline]:
    """Zigzag coefficients of the first component of each image as (down, across, 64), or what is wrong with it."""
    out: list = [None] * len(heads)
    alike: dict[tuple, list[tuple[int, Layout]]] = {}
    for i, head in enumerate(heads):
        try:
            layout = Layout.of(head)
            for _, dc, ac in layout.pattern:
                windows(*dc, False), windows(*ac, True)
            alike.setdefault(layout.pattern, []).append((i, layout))
        except (NotBaseline, KeyError) as e:
            out[i] = NotBaseline(str(e))
    for pattern, images in alike.items():
        own = images[0][1].own_h * images[0][1].own_v
        raw = np.frombuffer(b"".join([heads[i]["data"] + b"\xff\xd9" for i, _ in images]) + bytes(16), np.uint8)
        full = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[full + 1]
        marks = full[(after >= 0xD0) & (after <= 0xD7) | (after == 0xD9)]
        stay = np.ones(len(raw), bool)
        stay[full[after == 0] + 1] = False
        stay[marks] = stay[marks + 1] = False
        data = raw[stay]
        gone = np.flatnonzero(~stay)
        ends = marks - np.searchsorted(gone, marks)  # of the intervals, among the bytes that stay
        starts = np.concatenate([[0], ends[:-1]])
        images_end = np.cumsum([len(heads[i]["data"]) + 2 for i, _ in images])
        upto = np.searchsorted(marks, images_end)  # intervals up to each image's last
        units, every = np.zeros(len(marks), np.int64), np.zeros(len(images), np.int64)
        for n, ((i, layout), a, b) in enumerate(zip(images, [0, *upto.tolist()], upto.tolist())):
            total = layout.units_x * layout.units_y
            every[n] = heads[i]["restart"] or total
            units[a:b] = np.clip(total - np.arange(b - a) * every[n], 0, every[n])
        blocks: list = [None] * len(marks)
        stop = np.full(len(marks), -1)
        if len(marks) < FEW_LANES:
            whole = data.tobytes()
            tables = [(k, windows(*dc, False).tolist(), windows(*ac, True).tolist()) for k, dc, ac in pattern]
            for k in range(len(marks)):
                blocks[k], stop[k] = _loop(whole, 8 * int(starts[k]), int(units[k]), tables)
        else:
            order = np.argsort(-units, kind="stable")
            for k in range(0, len(order), LANES):
                some = order[k : k + LANES]
                found, at = _lanes(data, 8 * starts[some], units[some], pattern, int(units[some[0]]))
                stop[some] = at
                for j, (lane, n) in enumerate(zip(some.tolist(), units[some].tolist())):
                    blocks[lane] = found[j, : n * own]
        fine = (stop >= 0) & (stop <= 8 * ends)
        for (i, layout), a, b in zip(images, [0, *upto.tolist()], upto.tolist()):
            if not fine[a:b].all():
                out[i] = NotBaseline("the scan is damaged")
            elif int(units[a:b].sum()) != layout.units_x * layout.units_y:
                out[i] = NotBaseline("the scan ends early")
            else:
                out[i] = layout.arranged(np.concatenate([x.reshape(-1, 64) for x in blocks[a:b]]))
    return out


def decode_batch(media: list[bytes]) -> list[dict | Exception]:
    """For each: width, height, thumbnail (grey, one sample a block of the first component), and the payload where there
    is one; or what is wrong with it."""
    heads: list = []
    for body in media:
        try:
            head = parse_markers(body)
            if head["frame"][2][0][3] not in head["quant"]:
                raise NotBaseline("no quantisation table")
            heads.append(head)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            heads.append(e)
    right = [h for h in heads if isinstance(h, dict)]
    found = iter(decode_scans(right))
    out: list = []
    for head in heads:
        blocks = next(found) if isinstance(head, dict) else head
        if isinstance(blocks, Exception):
            out.append(blocks)
            continue
        width, height, parts = head["frame"]
        dc, payload = blocks[:, :, 0].astype(np.int64), None
        if head["comment"].startswith(COMMENT):
            if int(np.abs(blocks).max(initial=0)) > 128:
                out.append(NotBaseline("coefficients that stand for no byte"))
                continue
            payload = BYTE[blocks.reshape(-1) + 128].tobytes()[: int(head["comment"][len(COMMENT) :])]
        thumbnail = np.clip((dc * int(head["quant"][parts[0][3]][0]) + 1028) // 8, 0, 255).astype(np.uint8)  # dc / 8 + 128, to the nearest
        out.append({"width": width, "height": height, "thumbnail": thumbnail, "payload": payload})
    return out


def decode_jpeg(media: bytes) -> dict:
    found = decode_batch([media])[0]
    if isinstance(found, Exception):
        raise found
    return found


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """16 hex digits: whether each cell of an 8 x 8 grid of means is over the overall mean; then 16 of the SHA-256."""
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumbnail
    sums = sums.cumsum(axis=0).cumsum(axis=1)
    ys, xs = (np.arange(9) * n // 8 for n in thumbnail.shape)
    ys, xs, to_y, to_x = ys[:8], xs[:8], np.maximum(ys[:8] + 1, ys[1:]), np.maximum(xs[:8] + 1, xs[1:])
    cells = sums[np.ix_(to_y, to_x)] - sums[np.ix_(ys, to_x)] - sums[np.ix_(to_y, xs)] + sums[np.ix_(ys, xs)]
    over = cells * thumbnail.size > int(sums[-1, -1]) * np.outer(to_y - ys, to_x - xs)
    return np.packbits(over.ravel()).tobytes().hex() + hashlib.sha256(repr(thumbnail.shape).encode() + thumbnail.tobytes()).hexdigest()[:16]


# ---------------------------------------------------------------- columns

STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])
READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())]
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_column(batch)
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for i, j in byte_groups(offsets, SECTION):
            raws = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
            media = encode_batch([pad(raw) for raw in raws])
            columns = [ids.slice(i, j - i), pa.array([len(raw) for raw in raws], pa.int64()), pa.array(media, pa.large_binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=STORED)


def _features(media: bytes | None, found: dict | Exception | None) -> tuple:
    if media is None:
        return (*[None] * 8, "no media")
    sha = hashlib.sha256(media).hexdigest()
    if isinstance(found, Exception):
        return (None, None, None, len(media), sha, None, None, None, str(found) or type(found).__name__)
    payload = found["payload"]
    own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
    feature = f"{found['width']}x{found['height']}:{thumbnail_hash(found['thumbnail'])}"
    return (*own, len(media), sha, feature, found["width"], found["height"], None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_column(batch, "media")
        null = batch.column(2).is_null().to_pylist()
        for i, j in byte_groups(offsets, SECTION):
            media = [None if null[k] else data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
            found = iter(decode_batch([m for m in media if m is not None]))
            rows = [_features(m, None if m is None else next(found)) for m in media]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), READ.types[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *columns], schema=READ)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a baseline JPEG in a binary column, in a table of shared storage."""
    return stored(clean_docs(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def read_media(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and payload digests, decoded from the media column (doc_id, n_bytes, media)."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, error string"
    return media.select("doc_id", F.col("n_bytes").cast("long"), F.col("media").cast("binary")).mapInArrow(_read, names)
