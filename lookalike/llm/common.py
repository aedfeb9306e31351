"""What the operators share: tables in the shared folder, Arrow helpers and streamed groups."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, shared_folder
from ..storage import written as stash

__all__ = ["as_long", "by_key", "chunks", "fresh_path", "gathered", "publish", "raw_strings", "release", "runs", "stash", "table", "tune"]

#: Rows of one Arrow batch between the JVM and a Python worker: texts are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1024
#: Text bytes after which a worker gives freed memory back.
RELEASE_BYTES = 16 << 20

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Put a file of bounded size into the shared folder and have every executor, also one that comes later, fetch it.
    Returns the name for SparkFiles.get(), which holds a digest, so that equal files are fetched once."""
    name = f"{name}-{hashlib.sha256(data).hexdigest()[:32]}"
    uri = f"{shared_folder(spark)}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    if not any(str(x).endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(uri)
    return name


def tune(spark: SparkSession) -> None:
    """Arrow batches of bounded size; a session setting, as Spark has no per-plan one."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def by_key(df: DataFrame) -> DataFrame:
    """The smaller side of a join of texts or of what is as large: it is shuffled at any size. Where one size broadcasts it and
    another does not, the larger one moves a multiple, and figures of the smaller say nothing of it."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_long(name: str):
    return F.col(name).cast("long").alias(name)


def raw_strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column without copying the text; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def release() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it needs and no more."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take most_bytes together at most, or one text."""
    seen = 0
    for batch in batches:
        _, off = raw_strings(batch.column(column))
        at = 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        seen += int(off[-1])
        if seen > RELEASE_BYTES:
            release()
            seen = 0
    release()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Successive batches put together up to most_bytes of text, and larger ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chunks(batches, column, most_bytes):
        _, off = raw_strings(batch.column(column))
        if held and size + off[-1] > most_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += int(off[-1])
    if held:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a stream that is sorted by keys, one at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)
