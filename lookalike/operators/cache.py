"""The analysis cache: results by path, modification time and size, as a table in versions.

A version is a list of folders of Parquet files: a base, and what has been put or touched since, of which the last row of
a path counts. A write adds one folder; after MOST_DELTAS of them, or where rows go, the whole is written anew. Each version
is a small file with a number in its name, put there whole by a rename, and the highest number is the current one, so that
readers see the version before or the one after and never half a write. Folders that the last KEPT versions don't name are
removed, so a reader may finish on the version that it began with. A writer that finds its number taken, by another one,
begins again on what that has written."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cache_key, hit_rate, under
from ..schema import CACHE, CACHE_DAYS
from ..storage import written

SCHEMA_VERSION = 1
#: Folders beside the base before they are written into one, and versions whose folders stay.
MOST_DELTAS, KEPT = 8, 3
_POINTER = "VERSION-"
DAY = 86400.0
_SCANS = "directory string, file_count long, scan_time double, created_at double"


def keyed(files: DataFrame) -> DataFrame:
    """files: path, mtime, file_size. Adds cache_key."""
    return files.withColumn("cache_key", cache_key("path", "mtime", "file_size"))


def lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with hit (boolean) and what the cache knows of them."""
    known = cache.drop("path", "file_size", "mtime").withColumn("hit", F.lit(True))
    return keyed(files).join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed(files).join(cache.select("cache_key"), "cache_key", "left_anti")


def hit_statistics(looked_up: DataFrame) -> DataFrame:
    total, hits = F.count("*"), F.count(F.when(F.col("hit"), 1))
    return looked_up.agg(total.alias("total"), hits.alias("hits"), (total - hits).alias("misses")).withColumn("hit_rate", hit_rate("hits", "total"))


def upserted(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The last row of each path: a changed file has a new key, and its older version goes. Of equal times the rows' one
    stands before the cache's."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy("path").orderBy(F.col("_new").desc(), F.col("created_at").desc_nulls_last(), F.col("mtime").desc_nulls_last(), F.col("cache_key"))
    return both.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_new", "_rn")


def touched(cache: DataFrame, touches: DataFrame) -> DataFrame:
    """touches: cache_key, at. The last access of each row."""
    last = touches.groupBy("cache_key").agg(F.max("at").alias("_at"))
    return cache.join(last, "cache_key", "left").withColumn("last_accessed", F.greatest("last_accessed", "_at")).drop("_at").select(*cache.columns)


def with_colors(cache: DataFrame, colors: DataFrame) -> DataFrame:
    """colors: path, dominant_color."""
    new = colors.groupBy("path").agg(F.max("dominant_color").alias("_color"))
    return cache.join(new, "path", "left").withColumn("dominant_color", F.coalesce("_color", "dominant_color")).select(*cache.columns)


def stale(cache: DataFrame, now: float, days: float = CACHE_DAYS) -> DataFrame:
    return cache.filter(F.col("last_accessed") < now - days * DAY)


def fresh(cache: DataFrame, now: float, days: float = CACHE_DAYS) -> DataFrame:
    return cache.filter(F.coalesce(F.col("last_accessed") >= now - days * DAY, F.lit(True)))


def missing(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is gone."""
    return cache.join(files.select("path").distinct(), "path", "left_anti")


def present(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("path").distinct(), "path", "left_semi")


def without_path(cache: DataFrame, path: str) -> DataFrame:
    return cache.filter(F.col("path") != path)


def without_directory(cache: DataFrame, directory: str) -> DataFrame:
    return cache.filter(~under("path", directory))


def statistics(cache: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint")
    return cache.agg(F.count("*").alias("entries"), size.alias("total_bytes")).withColumn("total_mb", F.round(F.col("total_bytes") / 1048576.0, 2))


class Cache:
    """The table at a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        """Of all versions that are there, ascending."""
        fs, root = self._fs(), self._path("")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.removeprefix(_POINTER)) for n in names if n.startswith(_POINTER))

    def _folders(self, number: int) -> list[str]:
        """Of a version, the base first; none if another schema wrote it."""
        stream = self._fs().open(self._path(f"{_POINTER}{number:012d}"))
        try:
            version, *names = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
        return names if int(version) >= SCHEMA_VERSION else []

    def _current(self) -> tuple[int, list[str]]:
        numbers = self._numbers()
        return (numbers[-1], self._folders(numbers[-1])) if numbers else (0, [])

    def _table(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], CACHE)
        base, *deltas = (self.spark.read.schema(CACHE).parquet(f"{self.root}/{n}") for n in names)
        if not deltas:
            return base
        parts = [d.withColumn("_at", F.lit(k)) for k, d in enumerate(deltas)]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        last = both.groupBy("path").agg(F.max_by(F.struct(*CACHE.fieldNames()), "_at").alias("r")).select("r.*")
        return base.join(last.select("path"), "path", "left_anti").select(*CACHE.fieldNames()).unionByName(last)

    def read(self) -> DataFrame:
        return self._table(self._current()[1])

    def _point(self, number: int, names: list[str]) -> bool:
        """The version of that number is these folders; False if there is one already."""
        fs, draft, final = self._fs(), self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{_POINTER}{number:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(" ".join([str(SCHEMA_VERSION), *names]).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            return False
        return True

    def _remove_old(self) -> None:
        fs, numbers = self._fs(), self._numbers()
        stay = {n for k in numbers[-KEPT:] for n in self._folders(k)}
        for k in numbers[:-KEPT]:
            for n in self._folders(k):
                if n not in stay:
                    fs.delete(self._path(n), True)
            fs.delete(self._path(f"{_POINTER}{k:012d}"), False)

    def _write(self, rows: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in CACHE.fields]).write.parquet(f"{self.root}/{name}")
        return name

    def _change(self, make: Callable[[DataFrame], DataFrame], whole: bool) -> None:
        """make gives the new table (whole), or the rows to add, from the current one."""
        while True:
            number, names = self._current()
            new = self._write(make(self._table(names)))
            if whole or not names:
                done = self._point(number + 1, [new])
            elif len(names) <= MOST_DELTAS:
                done = self._point(number + 1, [*names, new])
            else:
                one = self._write(self._table([*names, new]))
                self._fs().delete(self._path(new), True)
                new, done = one, self._point(number + 1, [one])
            if done:
                self._remove_old()
                return
            self._fs().delete(self._path(new), True)

    def replace(self, rows: DataFrame) -> None:
        """rows become the table."""
        self._change(lambda _: rows, True)

    def put(self, rows: DataFrame, now: float | None = None) -> None:
        now = time.time() if now is None else now
        stamped = keyed(rows).withColumns({"created_at": F.lit(now), "last_accessed": F.lit(now)})
        stamped = written(stamped, "stamped")  # a second try writes the same
        none = self.spark.createDataFrame([], CACHE)
        self._change(lambda _: upserted(none, stamped), False)

    def touch(self, keys: DataFrame, now: float | None = None) -> None:
        at = keys.select("cache_key", F.lit(time.time() if now is None else now).alias("at"))
        self._change(lambda table: touched(table.join(at.select("cache_key").distinct(), "cache_key", "left_semi"), at), False)

    def set_colors(self, colors: DataFrame) -> None:
        self._change(lambda table: with_colors(table.join(colors.select("path").distinct(), "path", "left_semi"), colors), False)

    def invalidate(self, path: str) -> None:
        self._change(lambda table: without_path(table, path), True)

    def invalidate_directory(self, directory: str) -> None:
        self._change(lambda table: without_directory(table, directory), True)

    def cleanup_stale(self, days: float = CACHE_DAYS, now: float | None = None) -> int:
        now = time.time() if now is None else now
        gone = stale(self.read(), now, days).count()
        self._change(lambda table: fresh(table, now, days), True)
        return gone

    def cleanup_missing(self, files: DataFrame) -> int:
        gone = missing(self.read(), files).count()
        self._change(lambda table: present(table, files), True)
        return gone

    def compact(self, files: int = 1) -> None:
        self._change(lambda table: table.coalesce(files), True)

    def clear(self) -> None:
        self._fs().delete(self._path(""), True)

    def statistics(self) -> DataFrame:
        return statistics(self.read())

    def record_scan(self, directory: str, files: int, seconds: float, now: float | None = None) -> None:
        row = [(directory, files, seconds, time.time() if now is None else now)]
        self.spark.createDataFrame(row, _SCANS).coalesce(1).write.mode("append").parquet(f"{self.root}/scan_history")

    def scan_history(self) -> DataFrame:
        if not self._fs().exists(self._path("scan_history")):
            return self.spark.createDataFrame([], _SCANS)
        return self.spark.read.schema(_SCANS).parquet(f"{self.root}/scan_history")
