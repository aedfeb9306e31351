"""Byte-level BPE encoding and decoding with a rank queue.

All pre-tokens of a batch that are not tokens themselves lie in one linked list of byte positions, cut at pre-token ends.
A queue has one bucket per merge rank, which holds the positions whose pair has that rank, and a bitmap of three levels
over the buckets that are not empty. Find-first-set gives the lowest rank; the whole bucket is merged at once with numpy,
its stale entries (positions merged away, or whose pair has changed since) are skipped, and the pairs that arise go to
their buckets. One pre-token of a million characters and a million short ones cost the same per byte.

Equal pre-tokens of a batch are encoded once. Results are those of the tiktoken library's encode_ordinary for the same
ranks and pattern: a pre-token that is a token is that token; else the lowest rank first, the leftmost of equals first.

Defined cases: null text is as an empty one, which has no ids; there is no bound on a text's or pre-token's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_long, gathered, tune

#: Text bytes that are pre-tokenised together. More find more equal pre-tokens and fuller buckets, and take more memory.
BATCH_BYTES = 8 << 20


class Bitmap:
    """Set of integers below 64**3 as three levels of 64-bit words."""

    def __init__(self) -> None:
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0

    def add(self, x: int) -> None:
        self.low[x >> 6] |= 1 << (x & 63)
        self.mid[x >> 12] |= 1 << ((x >> 6) & 63)
        self.top |= 1 << (x >> 12)

    def remove(self, x: int) -> None:
        self.low[x >> 6] &= ~(1 << (x & 63))
        if not self.low[x >> 6]:
            self.mid[x >> 12] &= ~(1 << ((x >> 6) & 63))
            if not self.mid[x >> 12]:
                self.top &= ~(1 << (x >> 12))

    def first(self) -> int:
        """The least member, -1 of an empty set."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) | ((self.mid[a] & -self.mid[a]).bit_length() - 1)
        return (b << 6) | ((self.low[b] & -self.low[b]).bit_length() - 1)


class RankQueue:
    """Buckets of positions by rank."""

    def __init__(self, ranks: np.ndarray) -> None:
        """ranks: of each position, -1 without a bucket."""
        self.map, self.buckets = Bitmap(), {}
        self.push(np.flatnonzero(ranks >= 0), ranks[ranks >= 0])

    def push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            if r in self.buckets:
                self.buckets[r].append(positions[a:b])
            else:
                self.buckets[r] = [positions[a:b]]
                self.map.add(r)

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its positions in ascending order, once each; -1 at the end."""
        r = self.map.first()
        if r < 0:
            return r, np.zeros(0, np.int64)
        self.map.remove(r)
        held = self.buckets.pop(r)
        return r, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class Tokenizer:
    """ranks: token bytes in the order of their ids, which are the merge ranks; below 64**3 of them, the 256 bytes among them."""

    def __init__(self, tokens: Sequence[bytes], pattern: str) -> None:
        import regex

        if len(tokens) >= 64**3:
            raise ValueError("the bitmap has 64**3 ranks")
        self.tokens, self.pattern = list(tokens), regex.compile(pattern)
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((self.ids[t[:k]] << 32 | self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids)
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([i for _, i in pairs] + [-1], np.int64)
        #: Tokens of which a longer one with a lower rank has been made: the longer one has to go first then.
        self.hasty = np.zeros(len(self.tokens), bool)
        for k, i in pairs:
            for part in (k >> 32, k & 0xFFFFFFFF):
                if len(self.tokens[part]) > 1 and i < part:
                    self.hasty[part] = True
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._byte_pairs = np.full(256 * 256, -1, np.int64)
        for a in range(256):
            self._byte_pairs[a * 256 : a * 256 + 256] = self._search(np.full(256, self.byte_ids[a]), self.byte_ids)


    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        """Lines of a base64 token and its rank."""
        with open(path, "rb") as f:
            ranks = {int(n): base64.b64decode(t) for t, n in (line.split() for line in f if line.strip())}
        return cls([ranks.get(i, b"") for i in range(max(ranks) + 1)], pattern)

    def _search(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where the two make no token."""
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _pairs(self, token: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each position."""
        nxt = after[at]
        out = np.full(len(at), -1, np.int64)
        has = nxt >= 0
        out[has] = self._search(token[at[has]], token[nxt[has]])
        return out

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that lie one after the other in data and end before ends; and how many ids lie before each end."""
        n = len(data)
        token = self.byte_ids[data]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        rank = np.full(n, -1, np.int64)
        if n > 1:
            rank[:-1] = self._byte_pairs[data[:-1].astype(np.int64) * 256 + data[1:]]
            rank[ends - 1] = -1
        alive = np.ones(n, bool)
        queue = RankQueue(rank)
        while True:
            r, at = queue.pop()
            if r < 0:
                break
            at = at[rank[at] == r]  # skips stale entries
            if not len(at):
                continue
            if len(at) > 1:
                if self.hasty[r]:
                    piece = np.searchsorted(ends, at, "right")
                    keep = np.ones(len(at), bool)
                    keep[1:] = piece[1:] != piece[:-1]
                    queue.push(at[~keep], np.full(int((~keep).sum()), r))
                    at = at[keep]
                else:
                    chained = np.zeros(len(at), bool)
                    chained[1:] = after[at[:-1]] == at[1:]
                    if chained.any():  # of overlapping pairs the leftmost, the third, and so on
                        index = np.arange(len(at))
                        begin = np.maximum.accumulate(np.where(chained, 0, index))
                        at = at[(index - begin) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            token[at] = r
            after[at] = follow
            alive[gone] = False
            rank[gone] = -1
            before[follow[follow >= 0]] = at[follow >= 0]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            rank[touched] = found = self._pairs(token, after, touched)
            queue.push(touched[found >= 0], found[found >= 0])
        return token[alive], np.concatenate([[0], np.cumsum(alive)])[ends]

    def encode_batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets of the texts among them."""
        seen: dict[str, int] = {}
        index: list[int] = []
        tops = [0]
        find, place = self.pattern.findall, seen.setdefault
        for text in texts:
            index += [place(t, len(seen)) for t in find(text)]
            tops.append(len(index))
        if not index:
            return np.zeros(0, np.int64), np.array(tops, np.int64)
        pieces = [t.encode("utf-8") for t in seen]
        del seen
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(pieces), np.int64)
        flat = whole
        if len(rest):
            parts = [pieces[i] for i in rest.tolist()]
            ids, upto = self.merge(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]))
            counts[rest] = np.diff(upto, prepend=0)
            flat = np.empty(int(counts.sum()), np.int64)
            at = np.cumsum(counts) - counts
            flat[at[whole >= 0]] = whole[whole >= 0]
            flat[np.repeat(at[rest] - (upto - counts[rest]), counts[rest]) + np.arange(len(ids))] = ids
        starts = np.cumsum(counts) - counts
        use = np.array(index, np.int64)
        del index
        n = counts[use]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[use] - (ends - n), n) + np.arange(int(ends[-1]))]
        return out, np.concatenate([[0], ends])[np.array(tops)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids one after the other."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        n = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]))].tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per Python worker. The file has to be where the executors see it, like the library that reads it."""
    return Tokenizer.from_file(path, pattern)


def _texts(column: pa.ChunkedArray) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _without(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decodes: str | None = None) -> DataFrame:
    """df with a column ids (array<int>) instead of a column of that name. decodes: name of a column that says whether the
    ids, decoded in the same pass, give the text's bytes."""
    tune(df.sparkSession)
    kept = df.select(*_without(df, ids.lower(), (decodes or ids).lower()))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decodes:
        fields.append(T.StructField(decodes, T.BooleanType(), False))
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for rows in gathered(batches, text, BATCH_BYTES):
            texts = _texts(rows.column(text))
            got, off = tok.encode_batch(texts)
            rows = rows.append_column(ids, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(got, pa.int32())))
            if decodes:
                tops = off.tolist()
                rows = rows.append_column(decodes, pa.array([tok.decode(got[a:b]) == t.encode() for a, b, t in zip(tops, tops[1:], texts)]))
            yield from rows.combine_chunks().to_batches(max_chunksize=1024)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df with the bytes (binary) of its column ids; a null has none."""
    tune(df.sparkSession)
    kept = df.select(*_without(df, data.lower()))
    schema = T.StructType([*kept.schema.fields, T.StructField(data, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for rows in batches:
            column = rows.column(ids)
            got = [tok.decode(np.asarray(x.values)) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.binary())], [*rows.schema.names, data])

    return kept.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes
    that the ids decode to) of each text, in one pass that keeps no ids."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for rows in gathered(batches, text, BATCH_BYTES):
            got, off = tok.encode_batch(_texts(rows.column(text)))
            packed, tops = got.astype("<u4"), off.tolist()
            yield from pa.table(
                {
                    key: rows.column(key),
                    "n_tokens": pa.array(np.diff(off), pa.int64()),
                    "ids_sha256": [hashlib.sha256(packed[a:b].tobytes()).hexdigest() for a, b in zip(tops, tops[1:])],
                    "decoded_sha256": [hashlib.sha256(tok.decode(got[a:b])).hexdigest() for a, b in zip(tops, tops[1:])],
                }
            ).to_batches()

    return df.select(as_long(key), text).mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
