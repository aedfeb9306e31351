"""Media columns: baseline JPEG written and read with numpy.

Reading parses the markers, Huffman-decodes the scan and rebuilds the luminance thumbnail from the DC coefficients alone,
one pixel per 8x8 block. A general decoder walks any baseline scan (restart intervals, several components, subsampling)
symbol by symbol. Where every code of a one-component scan has the same length and every block its own restart interval,
all coefficients lie at fixed distances and the whole scan is decoded at once.

Writing stores bytes without loss: the unit is the quantized coefficient. Coefficients of size category 8 are
-255..-128 and 128..255, whose eight magnitude bits take each byte value once, so a byte b is the coefficient b - 255
(b < 128) or b, 64 of them to a block in zigzag order. A comment segment holds the number of blocks with payload; the
rest of the last row of blocks is filling.

Defined cases: null or empty bytes make one block of zeros; bytes that are no baseline JPEG have null dimensions, hash
and payload; a JPEG without the comment has dimensions and a hash but no payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import raw_strings, tune

UNIT = 64
MARK = b"payload-blocks="
#: Blocks that are packed at once.
SLICE = 1 << 14


def pad(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, whose code is the bit 0."""
    return _segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def encode(payload: bytes) -> bytes:
    """A baseline JPEG of one component whose coefficients hold the payload, a positive multiple of 64 bytes."""
    n = len(payload) // UNIT
    wide = max(1, int(np.ceil(np.sqrt(n))))
    high = -(-n // wide)
    if high * 8 > 65535:
        raise ValueError("a JPEG has 65535 rows at most")
    units = np.zeros((wide * high, UNIT), np.uint8)
    units[:n] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    head = b"\xff\xd8" + _segment(0xFE, MARK + b"%d" % n) + _segment(0xDB, bytes([0, *[1] * 64]))
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)) + _one_code(0, 0x08) + _one_code(1, 0x08)
    head += _segment(0xDD, b"\0\1") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    body = [_entropy(units[a : a + SLICE], a) for a in range(0, len(units), SLICE)]
    body[-1][-1] = 0xD9  # instead of the last restart marker
    return head + b"".join(x.tobytes() for x in body)


def _entropy(units: np.ndarray, first: int) -> np.ndarray:
    """Each byte as the bit 0 and its 8 bits, each unit stuffed and followed by a restart marker."""
    eight = units.reshape(-1, 8).astype(np.uint16)
    nine = np.zeros((len(eight), 9), np.uint16)
    nine[:, :8] = eight >> np.arange(1, 9, dtype=np.uint16)
    nine[:, 1:] |= (eight << np.arange(7, -1, -1, dtype=np.uint16)) & 0xFF
    coded = nine.astype(np.uint8).reshape(len(units), 72)
    full = coded == 0xFF
    stuffed = np.cumsum(full, axis=1)
    size = 74 + stuffed[:, -1]
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]), np.uint8)
    out[(end - size)[:, None] + np.arange(72) + stuffed - full] = coded
    out[end - 2] = 0xFF
    out[end - 1] = 0xD0 + (first + np.arange(len(units))) % 8
    return out


class Picture:
    """What the markers of a baseline JPEG say, and its scan."""

    def __init__(self, data: bytes) -> None:
        self.quant, self.huff, self.parts, self.restart, self.comments = {}, {}, [], 0, []
        self.width = self.height = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at = 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._tables(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.width or not self.height:
                    raise ValueError("not 8 bits a sample, or no size")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack_from(">H", body)
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        if [s[0] for s in self.scan] != [p[0] for p in self.parts]:
            raise ValueError("not one scan of all components")
        self.coded = np.frombuffer(data, np.uint8)[at:]

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            if body[at] >> 4:
                raise ValueError("16-bit quantization")
            self.quant[body[at] & 15] = np.frombuffer(body, np.uint8, 64, at + 1).astype(np.int64)
            at += 65

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, counts = body[at], body[at + 1 : at + 17]
            at += 17
            code, table = 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[length, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.huff[kind >> 4, kind & 15] = table

    @property
    def grid(self) -> tuple[int, int]:
        """Blocks of the first component: rows, columns."""
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        _, h, v, _ = self.parts[0]
        if len(self.parts) == 1:
            return -(-self.height // 8), -(-self.width // 8)
        return -(-self.height // (8 * most_v)) * v, -(-self.width // (8 * most_h)) * h

    def _intervals(self) -> list[np.ndarray]:
        """The scan's bytes between restart markers, without stuffing."""
        d = self.coded
        full = np.flatnonzero(d[:-1] == 0xFF)
        code = d[full + 1]
        stops = full[(code != 0) & ((code < 0xD0) | (code > 0xD7))]
        end = int(stops[0]) if len(stops) else len(d)
        full, code = full[full < end], code[full < end]
        keep = np.ones(end, bool)
        keep[full[code == 0] + 1] = False
        marks = full[code != 0]
        cuts = [0, *(x for m in marks.tolist() for x in (m, m + 2)), end]
        return [d[a:b][keep[a:b]] for a, b in zip(cuts[::2], cuts[1::2])]

    def coefficients(self) -> np.ndarray:
        """Quantized coefficients of the first component, a row of 64 in zigzag order for each block, rows of blocks
        from the top."""
        fast = self._at_once()
        return self._one_by_one() if fast is None else fast

    def _at_once(self) -> np.ndarray | None:
        if len(self.parts) != 1 or self.restart != 1 or [self.huff.get((k, self.scan[0][1 + k])) for k in (0, 1)] != [{(1, 0): 8}] * 2:
            return None
        rows, cols = self.grid
        d = self.coded
        full = np.flatnonzero(d[:-1] == 0xFF)
        code = d[full + 1]
        keep = np.ones(len(d), bool)
        keep[full + 1] = False
        keep[full[code != 0]] = False
        data = d[keep]
        if len(data) != 72 * rows * cols or int((code != 0).sum()) != rows * cols or code[-1] != 0xD9:
            return None
        nine = data.reshape(-1, 9).astype(np.uint16)
        byte = ((nine[:, :8] << np.arange(1, 9, dtype=np.uint16)) & 0xFF) | (nine[:, 1:] >> np.arange(7, -1, -1, dtype=np.uint16))
        return np.where(byte < 128, byte.astype(np.int16) - 255, byte.astype(np.int16)).reshape(-1, 64)

    def _one_by_one(self) -> np.ndarray:
        rows, cols = self.grid
        out = np.zeros((rows * cols, 64), np.int16)
        single = len(self.parts) == 1
        per_row = cols // (1 if single else self.parts[0][1])
        total = per_row * (rows // (1 if single else self.parts[0][2]))
        mcu = 0
        for data in self._intervals():
            bits, at = int.from_bytes(data.tobytes(), "big"), 0
            size = 8 * len(data)

            def take(n: int) -> int:
                nonlocal at
                at += n
                if at > size:
                    raise ValueError("the scan is cut")
                return (bits >> (size - at)) & ((1 << n) - 1)

            def symbol(table: dict) -> int:
                code = 0
                for length in range(1, 17):
                    code = code << 1 | take(1)
                    if (length, code) in table:
                        return table[length, code]
                raise ValueError("no such code")

            def number(n: int) -> int:
                v = take(n) if n else 0
                return v if not n or v >> (n - 1) else v - (1 << n) + 1

            last = [0] * len(self.parts)
            for _ in range(min(self.restart or total, total - mcu)):
                for c, (_, h, v, _) in enumerate(self.parts):
                    dc, ac = self.huff[0, self.scan[c][1]], self.huff[1, self.scan[c][2]]
                    for b in range(1 if single else h * v):
                        block = np.zeros(64, np.int16)
                        last[c] += number(symbol(dc))
                        block[0] = last[c]
                        k = 1
                        while k < 64:
                            s = symbol(ac)
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                if k > 63:
                                    raise ValueError("too many coefficients")
                                block[k] = number(s & 15)
                            k += 1
                        if c == 0:
                            y, x = divmod(mcu, per_row)
                            y, x = (y, x) if single else (y * v + b // h, x * h + b % h)
                            out[y * cols + x] = block
                mcu += 1
        if mcu != total:
            raise ValueError("the scan is cut")
        return out

    def thumbnail(self, coefficients: np.ndarray) -> np.ndarray:
        """Luminance of each block's mean, from its DC coefficient."""
        dc = coefficients[:, 0].astype(np.float64) * self.quant[self.parts[0][3]][0]
        return np.clip(np.rint(dc / 8 + 128), 0, 255).astype(np.uint8).reshape(self.grid)

    def payload(self, coefficients: np.ndarray) -> bytes | None:
        for c in self.comments:
            if c.startswith(MARK):
                x = coefficients[: int(c[len(MARK) :])]
                return np.where(x < 0, x + 255, x).astype(np.uint8).tobytes()
        return None


def thumbnail_hash(pixels: np.ndarray) -> str:
    """Differences of neighbours on an 8 x 9 grid of the thumbnail, and the checksum of all its pixels."""
    h, w = pixels.shape
    grid = pixels[(np.arange(8) * h // 8)[:, None], np.arange(9) * w // 9]
    return f"{np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()}-{zlib.crc32(pixels.tobytes()):08x}"


def _added(df: DataFrame, source: str, fields: list[T.StructField], make) -> DataFrame:
    tune(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    kept = df.select(*[c for c in df.columns if c.lower() not in taken])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 128):
                part = rows.slice(at, 128)
                data, off = raw_strings(part.column(source))
                off = off.tolist()
                found = [make(data[a:b].tobytes()) for a, b in zip(off, off[1:])]
                new = [pa.array([x[i] for x in found], _arrow[type(f.dataType)]) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f.name for f in fields)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


_arrow = {T.BinaryType: pa.binary(), T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}


def store(df: DataFrame, source: str = "text", media: str = "media") -> DataFrame:
    """df with a column of JPEGs that hold the source column (string as UTF-8, or binary), padded to blocks."""
    fields = [T.StructField("source_bytes", T.LongType(), False), T.StructField(media, T.BinaryType(), False)]
    return _added(df, source, fields, lambda x: (len(x), encode(pad(x))))


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what its column of JPEGs holds: width, height, thumb_hash, and of a stored payload payload_bytes,
    payload_sha256 and tail_crc32 (of its last 64 bytes); nulls where the bytes can't be read."""

    def make(data: bytes) -> tuple:
        try:
            p = Picture(data)
            x = p.coefficients()
        except (ValueError, IndexError, KeyError, struct.error):
            return (None,) * 6
        got = p.payload(x)
        rest = (None,) * 3 if got is None else (len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]))
        return p.width, p.height, thumbnail_hash(p.thumbnail(x)), *rest

    names = {"width": T.IntegerType(), "height": T.IntegerType(), "thumb_hash": T.StringType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType()}
    return _added(df, media, [T.StructField(n, t) for n, t in names.items()], make)
