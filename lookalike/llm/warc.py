"""WARC archives with a two-level capture index.

Archives are gzip members, one per record, in the shared folder. The index holds a line per capture, sorted by the
reversed-host URL key (SURT) and the id. Range partitions of it become index files: compressed blocks of sorted lines, and
at the file's end a sparse directory of the blocks' first keys. A lookup finds the file among the files' first keys (one
per partition, the only thing the driver holds), binary-searches the directory, reads the one block, binary-searches its
lines, and reads the record's range from the archive.

Equal payloads of at least `least` bytes are stored once, as the response with the largest id; the others are revisit
records that refer to it.

Files are named by attempt and become known by the rows that the attempt returns, so a lost executor's tasks run again
without harm. The shared folder may be any that pyarrow.fs can open.

Defined cases: a null payload is an empty one; a null or odd URL has a key of what there is, control characters and spaces
in it are percent-encoded; rows of one URL and id are captures of their own; null ids are kept and are the least.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stash, tune

LEAST_BYTES = 1000
BLOCK_LINES = 256
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"


def _quote(text: str) -> str:
    return urllib.parse.quote(text, safe="".join(map(chr, range(33, 127))))


def surt(url: str | None) -> str:
    """Key in the order of hosts from the top domain down: https://www.example.org/a -> org,example,www)/a."""
    _, found, rest = (url or "").partition("://")
    rest = rest if found else url or ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end].lower(), rest[end:]
    return _quote(",".join(reversed(host.split("."))) + ")" + path)


def index_key(url: str | None, page: int | None) -> str:
    """Sorts by SURT, then by id; nulls first."""
    return f"{surt(url)} {'' if page is None else format(page + (1 << 63), '020d')}"


@lru_cache(maxsize=64)
def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(url: str | None, page: int | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Target-URI", _quote(url or "")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record, of its HTTP head, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def duplicates(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """pages with _revisit and _refers_to: for equal payloads of at least `least` bytes the largest key is the response."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.sha1(data).alias("_digest"), F.length(data).alias("_size")).filter(F.col("_size") >= least)
    rows = stash(rows, "warc-digests")
    first = stash(rows.groupBy("_digest", "_size").agg(F.max("_key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "warc-firsts", few=True)
    revisits = rows.join(first, ["_digest", "_size"]).filter(F.coalesce(F.col("_key"), F.lit(-(1 << 63))) < F.col("_first")).select("_key", "_digest", "_first").distinct()
    revisits = revisits.withColumnRenamed("_digest", "_same")
    joined = pages.withColumn("_key", F.col(key).cast("long")).alias("p").join(revisits.alias("r"), F.col("p._key").eqNullSafe(F.col("r._key")) & (F.sha1(F.coalesce(F.col(f"p.{payload}").cast("binary"), F.lit(b""))) == F.col("r._same")), "left")
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in pages.columns], F.col("r._first").isNotNull().alias("_revisit"), F.col("r._first").alias("_refers_to"))


def write(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Archives below root. Returns a row per capture: key, archive, at, size."""
    tune(pages.sparkSession)
    rows = duplicates(pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload")), "page", "payload", least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        fs.create_dir(f"{base}/archive")
        out, name, at = None, "", 0
        try:
            for batch in batches:
                known: list[tuple] = []
                for page, link, data, revisit, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "_revisit", "_refers_to"))):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"archive/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 18)
                    member = _gzip(record(link, page, data or b"", first, revisit))
                    out.write(member)
                    known.append((index_key(link, page), name, at, len(member)))
                    at += len(member)
                if known:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*known)], ["key", "archive", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return stash(rows.mapInArrow(run, "key string, archive string, at long, size long"), "warc-captures")


def write_index(captures: DataFrame, root: str) -> list[tuple[str, str]]:
    """Index files below root; the first key and the name of each, in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        fs.create_dir(f"{base}/index")
        name, out, at, first = f"index/{uuid.uuid4().hex}.cdxz", None, 0, ""
        directory: list[tuple[str, int, int]] = []
        lines: list[str] = []

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append((lines[0].split("\t")[0], at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 18), row[0]
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], ["first", "name"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = captures.select("key", "archive", "at", "size").repartitionByRange(parts, "key").sortWithinPartitions("key")
    files = stash(sorted_rows.mapInArrow(run, "first string, name string"), "warc-index")
    return sorted((r[0], r[1]) for r in files.collect())


class Index:
    """Lookups in the index files and range reads of records."""

    def __init__(self, root: str, files: list[tuple[str, str]]) -> None:
        self.fs, self.base = _filesystem(root)
        self.firsts, self.names = [f for f, _ in files], [n for _, n in files]
        self._directories: OrderedDict[int, list] = OrderedDict()
        self._open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self._block: tuple[tuple[int, int], list[str], list[str]] = ((-1, -1), [], [])

    def _file(self, name: str) -> pa.NativeFile:
        if name not in self._open:
            if len(self._open) >= 32:
                self._open.popitem(last=False)[1].close()
            self._open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        self._open.move_to_end(name)
        return self._open[name]

    def _directory(self, i: int) -> list:
        if i not in self._directories:
            if len(self._directories) >= 4:
                self._directories.popitem(last=False)
            f = self._file(self.names[i])
            end = f.size()
            (size,) = struct.unpack("<Q", f.read_at(8, end - 8))
            self._directories[i] = json.loads(zlib.decompress(f.read_at(size, end - 8 - size)))
        return self._directories[i]

    def _lines(self, i: int, k: int) -> tuple[list[str], list[str]]:
        if self._block[0] != (i, k):
            _, at, size = self._directory(i)[k]
            lines = zlib.decompress(self._file(self.names[i]).read_at(size, at)).decode().split("\n")
            self._block = ((i, k), [x.split("\t", 1)[0] for x in lines], lines)
        return self._block[1:]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Archive, place and size of each capture with the key."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)  # the key's first lines may end the file before
        while i < len(self.firsts) and self.firsts[i] <= key:
            starts = [d[0] for d in self._directory(i)]
            k = max(0, bisect.bisect_left(starts, key) - 1)
            while k < len(starts) and starts[k] <= key:
                keys, lines = self._lines(i, k)
                for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                    _, archive, at, size = line.split("\t")
                    yield archive, int(at), int(size)
                k += 1
            i += 1

    def read(self, archive: str, at: int, size: int) -> bytes:
        return zlib.decompress(self._file(archive).read_at(size, at), 31)

    def close(self) -> None:
        for f in self._open.values():
            f.close()


def read_back(pages: DataFrame, root: str, files: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Every capture of the pages' URLs and ids by way of the index: key, payload_bytes, payload_digest (SHA-1 in
    hexadecimal), record_type and refers_to. A response is checked against its digest."""
    tune(pages.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([index_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(root, files)
        try:
            for batch in batches:
                rows = []
                for wanted in batch.column("key").to_pylist():
                    for place in index.find(wanted):
                        fields, http, payload = parse(index.read(*place))
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was stored")
                        size = int(http["Content-Length"]) if revisit else len(payload)
                        rows.append((_page(fields["WARC-Record-ID"]), size, digest.hex(), fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
                if rows:
                    c = list(zip(*rows))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], [key, "payload_bytes", "payload_digest", "record_type", "refers_to"])
        finally:
            index.close()

    keys = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url")).mapInArrow(keyed, "key string").distinct()
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and their index into the shared folder and reads every capture back."""
    root = fresh_path(pages.sparkSession, "warc")
    files = write_index(write(pages, root), root)
    return read_back(pages, root, files)
