"""URL filters over a sorted digest array.

The rules lie in one file: their xxhash64 keys in ascending order, the strings in the same order, and their verdicts.
Every Python worker maps the file into memory, so the workers of a machine share its pages. A batch of URLs is probed with
one vectorised binary search over all keys that could fit: the host's suffixes and the path's prefixes whose lengths some
rule has. A hit counts once its stored string is equal, so that colliding digests do no harm.

A rule is host and path in one string ("example.net/en/"). It fits its host and all subdomains, if the URL's path starts
with the rule's; the longest string wins, of equally long ones that with the longer host. Where none fits, the verdict is
the list's default.

Defined cases: a null URL or one without "://" has an empty host and path; an empty host fits no rule; A-Z in hosts are
lower-cased and nothing else is. The file is published by the driver, so a list is as large as fits its memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import publish, tune

VERDICTS = ("block", "allow")
_MAGIC = b"digests1"
_ascii_lower = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    stop = end if slash < 0 else slash
    return rest[:stop].translate(_ascii_lower), rest[stop:end]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_ascii_lower), slash + path


def digest_file(rules: Iterable[tuple[str, str]]) -> bytes:
    """(verdict, rule) pairs as the file's bytes. Of equal rules the last counts."""
    by_rule: dict[bytes, int] = {}
    for verdict, rule in rules:
        host, path = split_rule(rule)
        if not host:
            raise ValueError(f"no host in the rule {rule!r}")
        by_rule[(host + path).encode()] = VERDICTS.index(verdict)
    entries = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in by_rule.items())
    keys = np.array([k for k, _, _ in entries], "<u8")
    ends = np.cumsum([len(r) for _, r, _ in entries], dtype="<u8") if entries else np.zeros(0, "<u8")
    kinds = np.array([v for _, _, v in entries], np.uint8)
    hosts = sorted({len(r.split(b"/")[0].decode()) for _, r, _ in entries})
    paths = sorted({len(split_rule(r.decode())[1]) for _, r, _ in entries})
    sizes = np.array([*hosts, *paths], "<u4")
    head = _MAGIC + struct.pack("<QII", len(entries), len(hosts), len(paths))
    return head + keys.tobytes() + ends.tobytes() + sizes.tobytes() + kinds.tobytes() + b"".join(r for _, r, _ in entries)


class DigestArray:
    """The mapped file."""

    def __init__(self, path: str) -> None:
        whole = np.memmap(path, np.uint8, "r")
        if whole[:8].tobytes() != _MAGIC:
            raise ValueError("no digest array")
        n, hosts, paths = struct.unpack("<QII", whole[8:24].tobytes())
        at = 24
        self.keys, at = whole[at : at + 8 * n].view("<u8"), at + 8 * n
        self.ends, at = whole[at : at + 8 * n].view("<u8"), at + 8 * n
        sizes, at = whole[at : at + 4 * (hosts + paths)].view("<u4").tolist(), at + 4 * (hosts + paths)
        self.host_sizes, self.path_sizes = sizes[:hosts], sizes[hosts:]
        self.kinds, self.strings = whole[at : at + n], whole[at + n :]

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key among the rules, -1 where it is none."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.keys):
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in hits.tolist():
            p = int(at[i])
            while p < len(self.keys) and self.keys[p] == digests[i]:  # equal digests lie side by side
                if self.strings[int(self.ends[p - 1]) if p else 0 : int(self.ends[p])].tobytes() == keys[i]:
                    out[i] = p
                    break
                p += 1
        return out

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """Rules that would fit, the longest first; of equally long ones that with the longer host."""
        tails = [host[len(host) - n :] for n in self.host_sizes if n == len(host) or n < len(host) and host[len(host) - n - 1] == "."]
        heads = [path[:n] for n in self.path_sizes if n <= len(path)]
        for _, _, rule in sorted(((-len(t) - len(h), -len(t), t + h) for t in tails for h in heads if t)):
            yield rule


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def judge(df: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (the one that decides, else null) and verdict (block or allow) of its URLs."""
    spark = df.sparkSession
    tune(spark)
    name = publish(spark, "url-rules", digest_file(rules))
    added = ["host", "path", "rule", "verdict"]
    kept = df.select(*[c for c in df.columns if c.lower() not in added])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.StringType(), c == "rule") for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _mapped(name)
        for rows in batches:
            parts = [host_and_path(u) for u in rows.column(url).to_pylist()]
            keys, owner = [], []
            for i, (host, path) in enumerate(parts):
                for rule in rules.candidates(host, path):
                    keys.append(rule.encode())
                    owner.append(i)
            place = rules.probe(keys)
            best: dict[int, int] = {}
            for k in np.flatnonzero(place >= 0).tolist():
                best.setdefault(owner[k], k)
            rule = [keys[best[i]].decode() if i in best else None for i in range(len(parts))]
            verdict = [VERDICTS[rules.kinds[place[best[i]]]] if i in best else default for i in range(len(parts))]
            new = [pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, *added])

    return kept.mapInArrow(run, schema)
