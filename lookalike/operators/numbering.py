"""Consecutive numbers over a whole DataFrame without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def numbered(df: DataFrame, *order: str, start: int | Column = 1, out: str = "number") -> DataFrame:
    """df with start, start + 1, ... in ascending order of unique columns. Ranges of the order are counted first; the
    number of ranges, not of rows, bounds what is summed up in one place."""
    sorted_ranges = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    placed = written(sorted_ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before")), "offsets")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    base = start if isinstance(start, Column) else F.lit(start)
    return placed.join(offsets, "_part").withColumn(out, (within - 1 + F.col("_before") + base).cast("long")).drop("_part", "_before")
