"""Image bytes: format, size, pixels, perceptual hash, colours. Everything is numpy; a codec library is used for other
formats than PNG, BMP, GIF, PNM and baseline JPEG where one is installed, and for JPEG before our own decoder, as it is faster;
without it only the sizes of other formats are read.

The hash is a DCT of a 64 x 64 luminance thumbnail, low 16 x 16 coefficients against their median: 256 bits, equal for equal
pictures, near for near ones. Other libraries filter thumbnails differently, so their hashes are not these."""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import jpeg

try:
    from PIL import Image as _codec
except ImportError:
    _codec = None


class Unreadable(ValueError):
    """Bytes that are no image (kind invalid_format) or a damaged one (kind truncated)."""

    def __init__(self, message: str, kind: str = "truncated") -> None:
        super().__init__(message)
        self.kind = kind


@dataclass
class Header:
    format: str
    width: int | None = None
    height: int | None = None
    mode: str | None = None


def sniff(data: bytes) -> str | None:
    """Format by the first bytes."""
    # The formats' signatures.
    for format_, start in (("JPEG", b"\xff\xd8\xff"), ("PNG", b"\x89PNG\r\n\x1a\n"), ("GIF", b"GIF87a"), ("GIF", b"GIF89a"), ("BMP", b"BM"), ("TIFF", b"II*\0"), ("TIFF", b"MM\0*"), ("ICO", b"\0\0\1\0"), ("PSD", b"8BPS")):
        if data.startswith(start):
            return format_
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    if data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"mif1", b"msf1", b"hevc"):
        return "HEIF"
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456" and data[2:3].isspace():
        return "PPM"
    return None


def header(data: bytes) -> Header:
    """Format, and size and mode as far as the header tells. Raises Unreadable."""
    kind = sniff(data)
    if kind is None:
        raise Unreadable("cannot identify image file", "invalid_format")
    try:
        return _headers.get(kind, lambda _: Header(kind))(data)
    except (struct.error, IndexError) as e:
        raise Unreadable(f"image header is truncated: {e}") from e


def _png_header(data: bytes) -> Header:
    w, h, depth, color = struct.unpack_from(">IIBB", data, 16)
    mode = "1" if depth == 1 and color == 0 else "I;16" if depth == 16 and color == 0 else {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color)
    return Header("PNG", w, h, mode)


def _gif_header(data: bytes) -> Header:
    return Header("GIF", *struct.unpack_from("<HH", data, 6), "P")


def _bmp_header(data: bytes) -> Header:
    w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
    return Header("BMP", w, abs(h), {1: "1", 4: "P", 8: "P"}.get(bits, "RGB"))


def _jpeg_header(data: bytes) -> Header:
    at = 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack_from(">HHB", data, at + 5)
            return Header("JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(n))
        (size,) = struct.unpack_from(">H", data, at + 2)
        at += 2 + size


def _webp_header(data: bytes) -> Header:
    chunk = data[12:16]
    if chunk == b"VP8X":
        return Header("WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "RGBA" if data[20] & 16 else "RGB")
    if chunk == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return Header("WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB")
    w, h = struct.unpack_from("<HH", data, 26)
    return Header("WEBP", w & 0x3FFF, h & 0x3FFF, "RGB")


def _pnm_fields(data: bytes) -> tuple[list[int], int]:
    """Numbers of a PNM header and where the pixels begin."""
    need = 2 if data[1:2] in b"14" else 3
    found, at = [], 2
    while len(found) < need:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise Unreadable("image header is truncated")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _pnm_header(data: bytes) -> Header:
    (w, h, *_), _ = _pnm_fields(data)
    return Header("PPM", w, h, {b"1": "1", b"4": "1", b"2": "L", b"5": "L"}.get(data[1:2], "RGB"))


def _tiff_header(data: bytes) -> Header:
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        tags[tag] = (struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0], count)
    samples = tags.get(277, (1, 1))[0]
    return Header("TIFF", tags.get(256, (None, 1))[0], tags.get(257, (None, 1))[0], {1: "L", 3: "RGB", 4: "RGBA"}.get(samples))


_headers = {"PNG": _png_header, "GIF": _gif_header, "BMP": _bmp_header, "JPEG": _jpeg_header, "WEBP": _webp_header, "PPM": _pnm_header, "TIFF": _tiff_header}


def pixels(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes; transparent parts over white, CMYK inverted. Raises Unreadable."""
    head = header(data)
    try:
        if head.format in _decoders and not (head.format == "JPEG" and _codec is not None):
            return _decoders[head.format](data, head)
        if _codec is not None:
            with _codec.open(io.BytesIO(data)) as image:
                if image.mode == "CMYK":
                    return np.asarray(_codec.fromarray(255 - np.asarray(image), "CMYK").convert("RGB"))
                return np.asarray(image.convert("RGB"))
    except Unreadable:
        raise
    except jpeg.Unsupported as e:
        raise Unreadable(f"no decoder: {e}", "no_decoder") from e
    except (KeyError, ValueError, IndexError, OSError, struct.error, zlib.error) as e:
        raise Unreadable(f"image file is truncated: {e}") from e
    raise Unreadable(f"no decoder for {head.format}", "no_decoder")


def _over_white(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha[..., None].astype(np.float64) / 255
    return np.rint(rgb * a + 255 * (1 - a)).astype(np.uint8)


def _png(data: bytes, head: Header) -> np.ndarray:
    at, packed, palette, clear = 8, [], None, None
    depth, color, _, _, interlaced = struct.unpack_from(">BBBBB", data, 24)
    ended = False
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise Unreadable("image file is truncated")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise Unreadable("broken PNG chunk checksum")
        at += 12 + size
        if kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IEND":
            ended = True
            break
    if not ended:
        raise Unreadable("image file is truncated, no end chunk")
    if interlaced:
        raise Unreadable("no decoder for interlaced PNG", "no_decoder")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    row = -(-head.width * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) < (row + 1) * head.height:
        raise Unreadable("image file is truncated")
    lines = _unfiltered(raw[: (row + 1) * head.height].reshape(head.height, row + 1), max(1, channels * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        lines = np.unpackbits(lines, axis=1).reshape(head.height, -1, depth)
        lines = (lines * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        if color == 0:
            lines = lines * (255 // ((1 << depth) - 1))
    x = lines[:, : head.width * channels].reshape(head.height, head.width, channels)
    if color == 3:
        rgb = palette[x[..., 0]]
        if clear is None:
            return rgb
        full = np.full(256, 255, np.uint8)
        full[: len(clear)] = clear
        return _over_white(rgb, full[x[..., 0]])
    rgb = np.repeat(x[..., :1], 3, axis=2) if channels < 3 else x[..., :3]
    return _over_white(rgb, x[..., -1]) if channels in (2, 4) else rgb


#: Share of its rows that a salvaged picture has at least.
LEAST_LEFT = 0.5


def salvaged(data: bytes) -> bytes:
    """A cut or damaged PNG made whole: what can be unpacked of its rows, and the others empty. Raises Unreadable where less
    than LEAST_LEFT of them are left; others than PNG come back as they are."""
    if sniff(data) != "PNG":
        return data
    head = header(data)
    depth, color, _, _, interlaced = struct.unpack_from(">BBBBB", data, 24)
    if interlaced or color not in (0, 2, 3, 4, 6):
        return data
    at, packed, others = 33, [], []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            packed.append(body)
        elif kind in (b"PLTE", b"tRNS"):
            others.append((kind, body))
        elif kind == b"IEND":
            break
        at += 12 + size
    row = 1 + -(-head.width * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color] * depth // 8)
    unpack, raw = zlib.decompressobj(), b""
    try:
        for i in range(0, len(whole := b"".join(packed)), 1024):
            raw += unpack.decompress(whole[i : i + 1024])
    except zlib.error:
        pass  # what came before the damage is there
    rows = min(len(raw) // row, head.height)
    if rows < LEAST_LEFT * head.height:
        raise Unreadable(f"{rows} of {head.height} rows are left")
    raw = raw[: rows * row] + bytes((head.height - rows) * row)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return data[:8] + chunk(b"IHDR", data[16:29]) + b"".join(chunk(k, b) for k, b in others) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG with their filters undone."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(lines):
        kind, row = line[0], line[1:]
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = row + above
        elif kind == 1:
            width = -(-len(row) // step) * step
            padded = np.zeros(width, np.uint8)
            padded[: len(row)] = row
            out[y] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
        else:
            got, up = bytearray(row.tobytes()), above.tobytes()
            for i in range(len(got)):
                left = got[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + up[i]) >> 1
                elif kind == 4:
                    corner = up[i - step] if i >= step else 0
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                else:
                    raise Unreadable("unknown PNG filter")
                got[i] = (got[i] + guess) & 0xFF
            out[y] = np.frombuffer(bytes(got), np.uint8)
        above = out[y]
    return out


def _bmp(data: bytes, head: Header) -> np.ndarray:
    start, size, _, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise Unreadable("no decoder for this BMP", "no_decoder")
    row = -(-head.width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, offset=start)
    if len(raw) < row * head.height:
        raise Unreadable("image file is truncated")
    lines = raw[: row * head.height].reshape(head.height, row)[:: -1 if h > 0 else 1]
    if bits == 8:
        table = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        return table[lines[:, : head.width]]
    return np.ascontiguousarray(lines[:, : head.width * bits // 8].reshape(head.height, head.width, bits // 8)[..., 2::-1])


def _pnm(data: bytes, head: Header) -> np.ndarray:
    (w, h, *most), at = _pnm_fields(data)
    kind = data[1:2]
    if kind in b"123":
        numbers = np.array(b"".join(x.split(b"#")[0] + b"\n" for x in data[at - 1 :].split(b"\n")).split(), np.int64)
    elif kind == b"4":
        row = -(-w // 8)
        if len(data) - at < row * h:
            raise Unreadable("image file is truncated")
        numbers = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        numbers = np.frombuffer(data, np.uint8 if most[0] < 256 else ">u2", offset=at)
    channels = 3 if kind in b"36" else 1
    if len(numbers) < w * h * channels:
        raise Unreadable("image file is truncated")
    x = numbers[: w * h * channels].reshape(h, w, channels).astype(np.int64)
    x = (1 - x) * 255 if kind in b"14" else x * 255 // most[0]
    return np.repeat(x, 3 // channels, axis=2).astype(np.uint8)


def _gif(data: bytes, head: Header) -> np.ndarray:
    """The first frame over white."""
    flags = data[10]
    at = 13
    shared = None
    if flags & 128:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    clear = None
    while data[at] != 0x2C:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        else:
            raise Unreadable("image file is truncated")
    x, y, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
    at += 10
    table = shared
    if local & 128:
        n = 3 << ((local & 7) + 1)
        table, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    least, at, packed = data[at], at + 1, []
    while data[at]:
        packed.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    found = np.frombuffer(_lzw(b"".join(packed), least, w * h), np.uint8).reshape(h, w)
    if local & 64:
        rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
        plain = np.zeros_like(found)
        plain[rows] = found
        found = plain
    out = np.full((head.height, head.width, 3), 255, np.uint8)
    frame = table[np.minimum(found, len(table) - 1)].copy()
    if clear is not None:
        frame[found == clear] = 255
    part = out[y : y + h, x : x + w]
    part[:] = frame[: part.shape[0], : part.shape[1]]
    return out


def _lzw(data: bytes, least: int, size: int) -> bytes:
    """GIF's variable-length codes undone."""
    clear, bits, held, n, out = 1 << least, least + 1, 0, 0, bytearray()
    table: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    last = b""
    for byte in data:
        held |= byte << n
        n += 8
        while n >= bits:
            code = held & ((1 << bits) - 1)
            held >>= bits
            n -= bits
            if code == clear:
                table, bits, last = table[: clear + 2], least + 1, b""
                continue
            if code == clear + 1 or len(out) >= size:
                break
            if code > len(table) or not last and code >= len(table):
                raise Unreadable("broken image data")
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << bits and bits < 12:
                    bits += 1
            last = entry
    if len(out) < size:
        raise Unreadable("image file is truncated")
    return bytes(out[:size])


_decoders = {"PNG": _png, "BMP": _bmp, "PPM": _pnm, "GIF": _gif, "JPEG": lambda data, _: jpeg.decode(data)}


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each target pixel."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        size = x.shape[0]
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
        edge = np.linspace(0, size, n + 1)
        low = np.minimum(np.floor(edge).astype(int), size - 1)
        part = (edge - low).reshape(-1, *[1] * (x.ndim - 1))
        at = total[low] + part * x[low]
        return np.diff(at, axis=0) / (size / n)

    return np.moveaxis(along(np.moveaxis(along(image.astype(np.float64), height), 1, 0), width), 0, 1)


def thumbnail(image: np.ndarray, most: int) -> np.ndarray:
    """Not larger than most in each direction, the ratio kept."""
    h, w = image.shape[:2]
    scale = min(1.0, most / max(h, w))
    return image if scale == 1 else resized(image, max(1, round(h * scale)), max(1, round(w * scale)))


def perceptual_hash(image: np.ndarray, size: int = 16) -> str:
    """size * size bits in hexadecimal, rows first."""
    n = 4 * size
    luminance = thumbnail(image, 256) @ np.array([0.299, 0.587, 0.114])
    small = resized(luminance, n, n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = np.round((basis @ small @ basis.T)[:size, :size], 6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def mean_color(image: np.ndarray) -> tuple[int, int, int]:
    """The dominant colour of one cluster: the mean of a 32 x 32 thumbnail, truncated."""
    r, g, b = thumbnail(image, 32).reshape(-1, 3).mean(axis=0)
    return int(r), int(g), int(b)


def dominant_colors(image: np.ndarray, n: int = 1, seed: int = 42, starts: int = 3, rounds: int = 50) -> list[tuple[int, int, int]]:
    """Centres of n clusters of a 32 x 32 thumbnail's pixels, truncated, the largest cluster first."""
    if n <= 1:
        return [mean_color(image)]
    points = thumbnail(image, 32).reshape(-1, 3).astype(np.float64)
    n = min(n, len(np.unique(points, axis=0)))
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        centres = points[rng.integers(len(points))][None]
        while len(centres) < n:
            d = ((points[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum())]])
        for _ in range(rounds):
            label = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([points[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(n)])
            if np.allclose(new, centres):
                break
            centres = new
        d = ((points[:, None] - centres) ** 2).sum(axis=2)
        label, cost = d.argmin(axis=1), d.min(axis=1).sum()
        if best is None or cost < best[0]:
            best = (cost, centres, np.bincount(label, minlength=n))
    return [tuple(int(v) for v in best[1][i]) for i in np.argsort(-best[2], kind="stable")]


def is_grayscale(image: np.ndarray, threshold: float = 10, wrap: bool = False) -> bool:
    """Whether the channels' differences hardly vary over a 32 x 32 thumbnail. wrap: differences modulo 256, as unsigned bytes
    have them. A single colour counts as gray."""
    small = np.rint(thumbnail(image, 32)).astype(np.uint8 if wrap else np.int64)
    r, g, b = small[..., 0], small[..., 1], small[..., 2]
    return float(np.mean([np.std(r - g), np.std(g - b), np.std(r - b)])) < threshold


def encode_png(image: np.ndarray) -> bytes:
    """RGB pixels as a PNG."""
    h, w = image.shape[:2]
    lines = np.hstack([np.zeros((h, 1), np.uint8), np.asarray(image, np.uint8).reshape(h, w * 3)])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encode_jpeg(image: np.ndarray, quality: int = 95) -> bytes:
    """RGB pixels as a JPEG."""
    return jpeg.encode(np.asarray(image, np.uint8), quality)
