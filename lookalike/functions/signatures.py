"""Fixed-width similarity signatures as hexadecimal text, their distance, and two sources besides images: SimHash of a
text's tokens and the signs of a vector. All that works on signatures takes any of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def valid_hash(signature: Column | str, bits: int = 256) -> Column:
    """The signature, or null if it is not that many bits in lower-case hexadecimal."""
    return F.when(col(signature).rlike(f"^[0-9a-f]{{{bits // 4}}}$"), col(signature))


def words(signature: Column | str, bits: int = 256) -> list[Column]:
    """The signature as 64-bit integers, the first bits first."""
    return [F.conv(F.substring(col(signature), 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(bits // 64)]


def packed(signature: Column | str, bits: int = 256) -> Column:
    """The words as an array, so that they are parsed once per row and not once per pair."""
    return F.array(*words(signature, bits))


def distance(a: Column, b: Column, bits: int = 256) -> Column:
    """Bits in which two packed signatures differ."""
    parts = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("int")


def bit_range(signature: Column, first: int, bits: int) -> Column:
    """That many bits (63 at most) of a packed signature from a place on, as an integer."""
    if not bits:
        return F.lit(0).cast("bigint")
    word, left = signature[first // 64], 64 - first % 64
    if bits <= left:
        out = F.shiftrightunsigned(word, left - bits)
    else:
        out = F.shiftleft(word, bits - left).bitwiseOR(F.shiftrightunsigned(signature[first // 64 + 1], 64 - bits + left))
    return out.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def bucket_key(signature: Column, positions: list[int]) -> Column:
    """The bits of a packed signature at the positions, the first as the highest bit of an integer."""
    out = None
    for k, p in enumerate(positions):
        bit = F.shiftrightunsigned(signature[p // 64], 63 - p % 64).bitwiseAND(F.lit(1).cast("bigint"))
        part = F.shiftleft(bit, len(positions) - 1 - k)
        out = part if out is None else out.bitwiseOR(part)
    return out


#: Characters of texts whose tokens are held at once, about.
_HELD = 1 << 23


def simhash_of(text: str | None) -> str | None:
    """Bit p is set if more distinct tokens (lower-cased, cut at blanks) have it in their SHA-256 than not."""
    return simhashes([text])[0]


def simhashes(texts: Iterable[str | None]) -> list[str | None]:
    """The same for many texts: a token is hashed once for all that are held at once."""
    out: list[str | None] = []
    held: list[str] = []
    size = 0
    for text in texts:
        out.append(None if text is None else "")
        if text is not None:
            held.append(text.lower())
            size += len(text)
        if size >= _HELD:
            _fill(out, held)
            held, size = [], 0
    _fill(out, held)
    return out


def _fill(out: list[str | None], lowered: list[str]) -> None:
    """Puts the signatures of texts in the places that are empty yet, which are the last ones. Bits are laid out a byte each,
    and added eight at a time."""
    if not lowered:
        return
    cut = pc.split_pattern(pa.array(lowered, pa.large_string()), " ")
    tokens = cut.flatten().dictionary_encode()
    words = tokens.dictionary
    ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    digests = np.frombuffer(b"".join([hashlib.sha256(data[a:b]).digest() for a, b in zip(ends, ends[1:])]), np.uint64).reshape(-1, 4)
    text = np.repeat(np.arange(len(lowered)), np.diff(cut.offsets.to_numpy()))
    pairs = np.sort(text * len(words) + tokens.indices.to_numpy())
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]  # a token once for each text
    text, token = np.divmod(pairs, len(words))
    starts = np.searchsorted(text, np.arange(len(lowered) + 1)).tolist()
    found = []
    for first, end in zip(starts, starts[1:]):
        total = np.zeros(256, np.int64)
        for at in range(first, end, 255):  # a byte counts up to 255
            bits = np.unpackbits(np.take(digests, token[at : min(at + 255, end)], axis=0).view(np.uint8).reshape(-1))
            total += np.add.reduce(bits.view(np.uint64).reshape(-1, 32), axis=0).view(np.uint8)
        found.append(np.packbits(2 * total > end - first).tobytes().hex())
    empty = [i for i, x in enumerate(out) if x == ""]
    for i, x in zip(empty, found):
        out[i] = x


def _simhashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(simhashes(None if pd.isna(t) else t for t in batch), index=batch.index, dtype=object)


def simhash(text: Column | str) -> Column:
    """SimHash-256 of a text in hexadecimal."""
    return F.pandas_udf(_simhashes, "string")(col(text))


def sign_bits(vector: Column | str, size: int = 64) -> Column:
    """A bit per component of a vector, set if it is above 0; 16 hexadecimal digits for 64."""
    v = col(vector)
    digits = [F.hex(sum((F.when(v[i + j] > 0, 8 >> j).otherwise(0) for j in range(4)), F.lit(0)).cast("bigint")) for i in range(0, size, 4)]
    return F.lower(F.concat(*digits))
