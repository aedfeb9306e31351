import struct
import zlib

import numpy as np
import pytest

from lookalike.functions import pixels as P
from lookalike.functions.signatures import simhash_of
from lookalike.plans import execute
from lookalike.plans.execute import dated_tiff, exif_dates, with_exif_dates, without_exif
from lookalike.sources.analyze import look


def bmp(image):
    h, w = image.shape[:2]
    row = -(-w * 3 // 4) * 4
    lines = np.zeros((h, row), np.uint8)
    lines[:, : w * 3] = image[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + row * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row * h, 0, 0, 0, 0) + lines.tobytes()


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_png_bmp_and_pnm_hold_the_same_pixels(pictures):
    image = pictures(1, 37)
    ppm = b"P6\n# a comment\n37 37\n255\n" + image.tobytes()
    for data, name in ((P.encode_png(image), "PNG"), (bmp(image), "BMP"), (ppm, "PPM")):
        head = P.header(data)
        assert (head.format, head.width, head.height) == (name, 37, 37)
        assert (P.pixels(data) == image).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (9, 11, 3), np.uint8)
    raw, rows = image.reshape(9, 33).astype(int), []
    for y in range(9):
        line = []
        for x in range(33):
            left = raw[y, x - 3] if x >= 3 else 0
            up = raw[y - 1, x] if y else 0
            corner = raw[y - 1, x - 3] if y and x >= 3 else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((raw[y, x] - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        rows.append(bytes([kind, *line]))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 11, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (P.pixels(data) == image).all()


@pytest.mark.parametrize("size", [(64, 64), (37, 50), (8, 8), (1, 1)])
def test_jpeg_there_and_back(pictures, size):
    image = pictures(6, 64)[: size[0], : size[1]]
    data = P.encode_jpeg(image, 95)
    head = P.header(data)
    assert (head.format, head.height, head.width) == ("JPEG", *size)
    back = P.pixels(data)
    assert back.shape == image.shape and np.abs(back.astype(int) - image).mean() < 3
    assert len(P.encode_jpeg(image, 20)) <= len(data)
    noise = np.random.default_rng(1).integers(0, 256, (40, 40, 3), np.uint8)
    assert np.abs(P.pixels(P.encode_jpeg(noise, 100)).astype(int) - noise).mean() < 2
    if size == (64, 64):
        with pytest.raises(P.Unreadable):
            P.pixels(data[: len(data) // 2])


def test_code_lengths_are_limited():
    from lookalike.functions.jpeg import _limited, code_lengths

    counts = np.zeros(256, np.int64)
    counts[:40] = [int(1.7**k) + 1 for k in range(40)]
    lengths = code_lengths(counts)
    assert len(lengths) == 40 and max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    assert code_lengths(np.eye(256, dtype=np.int64)[5]) == {5: 1} and _limited([1, 2, 20, 20]) == [1, 2, 16, 16]


def test_gif_codes_undone(pictures):
    rng = np.random.default_rng(3)
    found = rng.integers(0, 4, (9, 13), np.uint8)
    bits = "".join(f"{c:03b}"[::-1] for i, v in enumerate(found.ravel().tolist()) for c in ([4, v] if i % 2 == 0 else [v])) + f"{5:03b}"[::-1]
    packed = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 9, 9, 9])
    chunks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
    data = b"GIF89a" + struct.pack("<HHBBB", 13, 9, 0x81, 0, 0) + table + b"\x2c" + struct.pack("<HHHHB", 0, 0, 13, 9, 0) + b"\2" + chunks + b"\0;"
    assert (P.pixels(data) == np.frombuffer(table, np.uint8).reshape(4, 3)[found]).all()


def test_damage_is_told_apart(pictures):
    data = P.encode_png(pictures(2))
    with pytest.raises(P.Unreadable, match="truncated"):
        P.pixels(data[:-30])
    with pytest.raises(P.Unreadable) as e:
        P.pixels(b"not an image")
    assert e.value.kind == "invalid_format"
    broken = bytearray(data)
    broken[60] ^= 255
    with pytest.raises(P.Unreadable):
        P.pixels(bytes(broken))


def test_hash_is_near_for_near_pictures(pictures):
    a = pictures(3, 200)
    same = P.perceptual_hash(a)
    assert len(same) == 64 and distance(same, P.perceptual_hash(P.resized(a, 100, 100).astype(np.uint8))) <= 10
    assert distance(same, P.perceptual_hash(np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8))) <= 10
    assert distance(same, P.perceptual_hash(pictures(4, 200))) > 40


def test_colors():
    half = np.zeros((40, 40, 3), np.uint8)
    half[:20, :, 0], half[20:, :, 2] = 255, 255
    assert P.mean_color(half) == (127, 0, 127)
    assert set(P.dominant_colors(half, 2)) == {(255, 0, 0), (0, 0, 255)}
    assert not P.is_grayscale(half) and P.is_grayscale(np.full((50, 50, 3), 128, np.uint8))
    assert P.dominant_colors(np.full((5, 5, 3), 9, np.uint8), 4) == [(9, 9, 9)]


def test_headers_without_pixels():
    gif = b"GIF89a" + struct.pack("<HH", 7, 5) + bytes(3)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 30, 40, 3) + bytes(9)
    assert (P.header(gif).width, P.header(jpeg).height, P.header(jpeg).mode) == (7, 30, "RGB")
    assert P.sniff(b"RIFF\0\0\0\0WEBPVP8 ") == "WEBP" and P.sniff(b"") is None


def test_look(pictures):
    good = P.encode_png(pictures(5))
    assert look(good)[:4] == ("PNG", 64, 64, "RGB") and look(good)[5:] == (None, "none") and len(look(good)[4]) == 64
    assert look(good, perceptual=False)[4] is None
    assert look(good[:-20])[1:3] == (64, 64) and look(good[:-20])[5].startswith("Corrupt")
    assert look(b"text")[5] == "Not a valid image file" and look(None)[5] == "File not found" and look(good, "/a.heic")[5]


@pytest.mark.parametrize("order, magic", [("little", b"II*\0"), ("big", b"MM\0*")])
def test_exif_dates_keep_other_data(order, magic, pictures):
    """Of a TIFF, and of a JPEG whose EXIF data is that TIFF."""
    n = lambda x, k: x.to_bytes(k, order)
    entries = [(0x10E, 2, 6, 50), (0x8769, 4, 1, 60)]
    tiff = magic + n(8, 4) + n(len(entries), 2) + b"".join(n(t, 2) + n(k, 2) + n(c, 4) + n(v, 4) for t, k, c, v in entries) + n(0, 4)
    tiff += bytes(50 - len(tiff)) + b"about\0" + bytes(4) + n(1, 2) + n(0x9286, 2) + n(2, 2) + n(4, 4) + b"abc\0" + n(0, 4)
    dated = dated_tiff(tiff, "2020:01:02 03:04:05")
    assert exif_dates(dated) == dict.fromkeys((0x132, 0x9003, 0x9004), "2020:01:02 03:04:05")
    tags = lambda e: [int.from_bytes(x[:2], order) for x in e]
    first = execute._entries(dated, int.from_bytes(dated[4:8], order))[0]
    assert tags(first) == [0x10E, 0x132, 0x8769] and dated[50:56] == b"about\0"
    inner = execute._entries(dated, int.from_bytes(first[2][8:12], order))[0]
    assert tags(inner) == [0x9003, 0x9004, 0x9286] and inner[2][8:] == b"abc\0"
    again = dated_tiff(dated, "2021:01:02 03:04:05")
    assert len(again) == len(dated) and set(exif_dates(again).values()) == {"2021:01:02 03:04:05"}
    body = b"Exif\0\0" + tiff
    plain = P.encode_jpeg(pictures(1, 32))
    photo = plain[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + plain[2:]
    changed = with_exif_dates(photo, "2020:01:02 03:04:05")
    assert len(exif_dates(changed)) == 3 and b"about\0" in changed and without_exif(changed) == plain
    broken = plain[:2] + b"\xff\xe1" + (16).to_bytes(2, "big") + b"Exif\0\0" + tiff[:8] + plain[2:]
    assert len(exif_dates(with_exif_dates(broken, "2020:01:02 03:04:05"))) == 3
    with pytest.raises(P.Unreadable):
        with_exif_dates(b"GIF89a", "2020:01:02 03:04:05")


def test_what_is_left_of_a_png(pictures):
    whole = pictures(3, 64)
    data = P.encode_png(whole)
    cut = data[: int(len(data) * 0.8)]
    with pytest.raises(P.Unreadable):
        P.pixels(cut)
    got = P.pixels(P.salvaged(cut))
    rows = int((got == whole).all(axis=(1, 2)).sum())
    assert got.shape == whole.shape and 32 <= rows < 64 and (got[:rows] == whole[:rows]).all() and not got[rows + 1 :].any()
    with pytest.raises(P.Unreadable):
        P.salvaged(data[: len(data) // 4])
    assert (P.pixels(P.salvaged(data)) == whole).all() and P.salvaged(b"BMx") == b"BMx"


def test_exif_dates_replace_each_other():
    plain = b"\xff\xd8\xff\xdb\x00\x04ab\xff\xda\x00\x02rest"
    once = with_exif_dates(plain, "2020:01:02 03:04:05")
    twice = with_exif_dates(once, "2021:01:02 03:04:05")
    assert set(exif_dates(twice).values()) == {"2021:01:02 03:04:05"} and len(exif_dates(twice)) == 3
    assert without_exif(twice) == plain and exif_dates(plain) == {} and len(once) == len(twice)


def test_simhash():
    assert simhash_of(None) is None and len(simhash_of("")) == 64
    assert simhash_of("a b c a") == simhash_of("C B a")
    words = [f"w{i}" for i in range(200)]
    assert distance(simhash_of(" ".join(words)), simhash_of(" ".join(words[:-2]))) < 30 < distance(simhash_of(" ".join(words)), simhash_of("x y z"))
