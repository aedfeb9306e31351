"""Baseline JPEG in numpy: a decoder for one interleaved scan of gray, YCbCr, RGB or CMYK samples, and an encoder with Huffman
tables made for the picture. Where a codec library is installed, pixels.py prefers it; progressive files need it."""

from __future__ import annotations

import heapq
import struct

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))

# The quantization tables that the standard recommends at quality 50, by rows.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32,
]

_k = np.arange(8)
_basis = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:, None] / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None]


class Unsupported(ValueError):
    """A JPEG of another kind than baseline."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# Decoding


class _Bits:
    """Bits of a piece of the scan, looked at 16 at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.held = (self.held << 48) | int.from_bytes(part + b"\xff" * (6 - len(part)), "big")
        self.at += 6
        self.n += 48

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self.fill()
        length, symbol = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not length:
            raise ValueError("no such code in the scan")
        self.n -= length
        self.held &= (1 << self.n) - 1
        return symbol

    def number(self, size: int) -> int:
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1

    @property
    def overrun(self) -> bool:
        return 8 * self.at - self.n > 8 * len(self.data) + 7


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Length and symbol of the code that each 16 bits begin with."""
    table: list[tuple[int, int]] = []
    i = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table += [(length, symbols[i])] * (1 << (16 - length))
            i += 1
    if len(table) > 1 << 16:
        raise ValueError("too many codes")
    return table + [(0, 0)] * ((1 << 16) - len(table))


def decode(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes. Raises Unsupported for other kinds, ValueError for damage."""
    at, quant, tables, parts, restart, transform = 2, {}, {}, [], 0, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3, 4):
                raise Unsupported(f"{depth} bits, {n} components")
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unsupported("not a baseline JPEG")
        elif marker == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif marker == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif marker == 0xDA:
            if body[0] != len(parts):
                raise Unsupported("several scans")
            for i, p in enumerate(parts):
                p += [body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15]
            break
    if not parts or not width or not height:
        raise ValueError("no size")
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = 1
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    blocks = [np.zeros((high * p[2], wide * p[1], 64), np.int16) for p in parts]
    mcu = 0
    for piece in _pieces(data[at:]):
        bits, last = _Bits(piece), [0] * len(parts)
        for _ in range(min(restart or wide * high, wide * high - mcu)):
            y, x = divmod(mcu, wide)
            for c, (_, h, v, _, dc, ac) in enumerate(parts):
                for b in range(h * v):
                    block = blocks[c][y * v + b // h, x * h + b % h]
                    last[c] += bits.number(bits.symbol(tables[dc]))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(tables[ac])
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        if k > 63:
                            raise ValueError("too many coefficients")
                        block[k] = bits.number(s & 15)
                        k += 1
            if bits.overrun:
                raise ValueError("the scan is truncated")
            mcu += 1
    if mcu < wide * high:
        raise ValueError("the scan is truncated")
    planes = []
    for (_, h, v, q, *_), found in zip(parts, blocks):
        plain = np.zeros((*found.shape[:2], 64))
        plain[..., ZIGZAG] = found * quant[q]
        square = _basis.T @ plain.reshape(*found.shape[:2], 8, 8) @ _basis + 128
        plane = square.transpose(0, 2, 1, 3).reshape(found.shape[0] * 8, -1)
        planes.append(plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)[:height, :width])
    return _to_rgb(planes, transform)


def _pieces(scan: bytes) -> list[bytes]:
    """Parts between restart markers, without stuffing."""
    d = np.frombuffer(scan, np.uint8)
    full = np.flatnonzero(d[:-1] == 0xFF)
    code = d[full + 1]
    stop = full[(code != 0) & ((code < 0xD0) | (code > 0xD7))]
    end = int(stop[0]) if len(stop) else len(scan)
    cuts = [0, *(i for m in full[(code >= 0xD0) & (code <= 0xD7) & (full < end)].tolist() for i in (m, m + 2)), end]
    return [scan[a:b].replace(b"\xff\0", b"\xff") for a, b in zip(cuts[::2], cuts[1::2])]


def _to_rgb(planes: list[np.ndarray], transform: int | None) -> np.ndarray:
    if len(planes) == 1:
        x = np.repeat(planes[0][..., None], 3, axis=2)
    else:
        x = np.stack(planes[:3], axis=2)
        if transform != 0 and not (len(planes) == 4 and transform is None):
            y, cb, cr = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
            x = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        if len(planes) == 4:  # stored inverted, so the samples are what is left of white
            x = x * planes[3][..., None] / 255
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


# Encoding


def scaled(table: list[int], quality: int) -> np.ndarray:
    factor = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((np.array(table) * factor + 50) / 100), 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths up to 16 of the symbols that occur; no code is all ones."""
    heap = [(int(n), -1 - s, [s]) for s, n in enumerate(counts) if n]
    heap.append((0, 0, [-1]))  # takes the code of all ones
    heapq.heapify(heap)
    length = {s: 0 for _, _, group in heap for s in group}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    order = sorted(length, key=lambda s: (length[s], s == -1, -counts[s] if s >= 0 else 0))
    sizes = _limited(sorted(length.values()))
    order.remove(-1)
    return dict(zip(order, sizes))


def _limited(sizes: list[int], most: int = 16) -> list[int]:
    """Code lengths in ascending order with none above most: too long ones are cut, and codes are lengthened from the
    longest allowed on down until the sum of 2**-length is 1 or less again."""
    out = [min(n, most) for n in sizes]
    room = (1 << most) - sum(1 << (most - n) for n in out)
    while room < 0:
        i = max(k for k, n in enumerate(out) if n < most)
        room += 1 << (most - out[i] - 1)
        out[i] += 1
    return sorted(out)


def encode(image: np.ndarray, quality: int = 95) -> bytes:
    """RGB pixels as a JPEG without subsampling."""
    h, w = image.shape[:2]
    x = np.pad(image.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])
    rows, cols = planes.shape[1] // 8, planes.shape[2] // 8
    square = _basis @ planes.reshape(3, rows, 8, cols, 8).transpose(0, 1, 3, 2, 4) @ _basis.T
    quant = [scaled(t, quality) for t in (LUMINANCE, CHROMINANCE, CHROMINANCE)]
    found = np.rint(square.reshape(3, rows * cols, 64) / np.array(quant)[:, None, :])[..., ZIGZAG].astype(np.int64).transpose(1, 0, 2)
    found[..., 1:] = np.clip(found[..., 1:], -1023, 1023)
    block, part, place, sub, kind, symbol, value = _events(found)
    size = symbol & 15
    code, length, head = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    for table in range(4):  # DC and AC of luminance, then of chrominance
        mine = (kind == table % 2) & ((part > 0) == (table > 1))
        lengths = code_lengths(np.bincount(symbol[mine], minlength=256))
        ordered = sorted(lengths, key=lambda s: (lengths[s], s))
        c, last, codes = 0, 0, {}
        for s in ordered:
            c <<= lengths[s] - last
            last = lengths[s]
            codes[s] = c
            c += 1
        counts = [sum(1 for n in lengths.values() if n == k) for k in range(1, 17)]
        head += _segment(0xC4, bytes([(table % 2) << 4 | table // 2, *counts, *ordered]))
        of_symbol, of_length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s in ordered:
            of_symbol[s], of_length[s] = codes[s], lengths[s]
        code[mine], length[mine] = of_symbol[symbol[mine]], of_length[symbol[mine]]
    whole = code << size | np.where(value < 0, value + (1 << size) - 1, value)
    bits = length + size
    out = []
    for a in range(0, len(whole), 1 << 18):
        n = bits[a : a + (1 << 18)]
        shift = np.repeat(n, n) - 1 - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        out.append((np.repeat(whole[a : a + (1 << 18)], n) >> shift & 1).astype(np.uint8))
    stream = np.concatenate(out)
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])
    body = np.packbits(stream).tobytes().replace(b"\xff", b"\xff\0")
    start = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    start += b"".join(_segment(0xDB, bytes([i, *quant[i][ZIGZAG].astype(int)])) for i in (0, 1))
    start += _segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    return start + head + _segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"


def _events(found: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of blocks x parts x 64 coefficients in the order of the scan: block, part, place, sub-order, kind (0 DC, 1 AC),
    symbol, and the number that follows it."""
    n, parts, _ = found.shape
    diff = np.diff(found[..., 0], axis=0, prepend=0)
    every = np.indices((n, parts)).reshape(2, -1)
    bits = lambda v: np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    zero = lambda x: np.zeros(len(x), np.int64)
    dc = (*every, zero(every[0]), zero(every[0]), zero(every[0]), bits(diff.ravel()), diff.ravel())
    block, part, place = np.nonzero(found[..., 1:])
    place = place + 1
    value = found[block, part, place]
    before = np.concatenate([[0], place[:-1]])
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (part[1:] != part[:-1])
    run = place - np.where(new, 0, before) - 1
    ac = (block, part, place, np.full(len(block), 9), np.ones(len(block), np.int64), (run % 16) << 4 | bits(value), value)
    long_ = np.repeat(np.arange(len(run)), run // 16)
    skips = (block[long_], part[long_], place[long_], zero(long_), np.ones(len(long_), np.int64), np.full(len(long_), 0xF0), zero(long_))
    ends = np.flatnonzero((found[..., 63] == 0).ravel())
    last = (every[0][ends], every[1][ends], np.full(len(ends), 64), zero(ends), np.ones(len(ends), np.int64), zero(ends), zero(ends))
    joined = [np.concatenate(c) for c in zip(dc, ac, skips, last)]
    order = np.lexsort((joined[3], joined[2], joined[1], joined[0]))
    return tuple(c[order] for c in joined)
