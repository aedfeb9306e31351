"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode, as in tests, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lookalike-")
            spark.sparkContext.setCheckpointDir(_own[app])
            atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/lookalike-{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False, few: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and gives joins a plain scan on that
    side, so that adaptive execution may split a hot key of the other side. narrow: for counts, links and the like that are
    small next to their input: two files a core at most, not one for each shuffle partition, and what makes them runs in as
    many tasks. few: as many files, by one more exchange of the rows alone, so that a large aggregation or join before it
    keeps its tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    files = 2 * spark.sparkContext.defaultParallelism
    (df.repartition(files) if few else df.coalesce(files) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; no DataFrame that reads it may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
