"""File trees as DataFrames by Spark's binaryFile source. Without its content column nothing but the listing is read."""

from __future__ import annotations

import os
import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import directory, extension, filename, under
from ..operators.numbering import numbered
from ..schema import DISCOVERY_CHUNK, IMAGE_EXTENSIONS


def name_pattern(extensions: list[str]) -> str:
    """A glob for file names in any case, which the listing applies before it opens anything."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(either(e) for e in extensions) + "}"


def _plain(df: DataFrame) -> DataFrame:
    """path without its scheme, mtime in seconds, file_size."""
    path = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    return df.withColumns({"path": path, "mtime": F.col("modificationTime").cast("double"), "file_size": F.col("length")}).drop("modificationTime", "length")


def files(spark: SparkSession, root: str, extensions: list[str] | None = None, recursive: bool = True, content: bool = False, hidden: bool = True) -> DataFrame:
    """path, mtime, file_size and, if asked for, content, of the files below root, each path once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions is not None:
        reader = reader.option("pathGlobFilter", name_pattern(extensions))
    rows = _plain(reader.load(root)).select("path", "mtime", "file_size", *(["content"] if content else []))
    if not recursive:
        rows = rows.filter(directory("path") == (root.rstrip("/") or "/"))
    return rows if hidden else rows.filter(~filename("path").startswith("."))


def images(spark: SparkSession, root: str, recursive: bool = True, content: bool = False, heif: bool = False) -> DataFrame:
    """Files with an image extension; HEIC and HEIF only where a decoder for them is said to be there."""
    wanted = [e for e in IMAGE_EXTENSIONS if heif or e not in (".heic", ".heif")]
    return files(spark, root, wanted, recursive, content)


#: Files that are opened by name at once.
MOST_NAMED = 100_000


def contents_of(spark: SparkSession, root: str, paths: DataFrame, of: int, recursive: bool = True) -> DataFrame:
    """Files with content of the paths (path, each once), which are some of `of` images below root. Content is read before Spark
    could filter by path, and a join would shuffle it, so the files are given to the source by name unless they are all."""
    n = paths.count()
    if n >= of:
        return images(spark, root, recursive, content=True)
    scheme = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?", root)[0]
    out = None
    rows = paths.toLocalIterator()
    while names := [scheme + re.sub(r"([\\*?{}\[\]])", r"\\\1", r["path"]) for r in islice(rows, MOST_NAMED)]:  # no name is a pattern
        part = _plain(spark.read.format("binaryFile").load(names)).select("path", "mtime", "file_size", "content")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "path string, mtime double, file_size long, content binary") if out is None else out


def resolved(listing: DataFrame) -> DataFrame:
    """listing with each file once: of paths that symbolic links lead to one file, the file's own, or the least of them if it is
    not listed. For folders that the executors have mounted."""

    @F.pandas_udf("string")
    def real(path: pd.Series) -> pd.Series:
        return path.map(os.path.realpath)

    rows = listing.withColumn("_real", real("path"))
    best = F.min(F.struct((F.col("path") != F.col("_real")).alias("linked"), "path"))["path"]
    return rows.drop("_real").join(rows.groupBy("_real").agg(best.alias("path")).select("path"), "path", "left_semi")


def find_files(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """Paths in order, without files whose name begins with a dot."""
    return files(spark, root, extensions, recursive, hidden=False).select("path").orderBy("path")


def chunks(listing: DataFrame, size: int = DISCOVERY_CHUNK) -> DataFrame:
    """listing with chunk: numbers of successive groups of that many paths."""
    return numbered(listing, "path", start=0, out="_n").withColumn("chunk", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def stream(spark: SparkSession, root: str, extensions: list[str] | None = None, per_batch: int = DISCOVERY_CHUNK, content: bool = False) -> DataFrame:
    """The same as a stream that takes per_batch files at a time, also ones that come later."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    if extensions is not None:
        reader = reader.option("pathGlobFilter", name_pattern(extensions))
    return _plain(reader.load(root)).select("path", "mtime", "file_size", *(["content"] if content else []))


def folders(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all folders below root; the driver walks them, as they hold no data."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    found, left = [], [path]
    while left:
        for s in fs.listStatus(left.pop()):
            if s.isDirectory():
                left.append(s.getPath())
                found.append((s.getPath().toUri().getPath(),))
    return spark.createDataFrame(found, "path string")


def inside(rows: DataFrame, root: str) -> DataFrame:
    return rows.filter(under("path", root))


def by_extension(rows: DataFrame, extensions: list[str]) -> DataFrame:
    return rows.filter(extension("path").isin(extensions))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


