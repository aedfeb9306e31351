"""What to do with damaged files, as one decision per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import under


def outside_trash(files: DataFrame, trash: str) -> DataFrame:
    return files.filter(~under("path", trash))


def decision(attempt: bool = True, quarantine: bool = True) -> Column:
    """Status from readable, writable, parent_writable, corruption_type (none, truncated, bad_exif, invalid_format,
    unknown) and repaired (what a repair would do). A repair that is tried and fails goes on to quarantine."""
    movable = F.col("writable") & F.col("parent_writable")
    aside = F.when(movable, "quarantined").otherwise("skipped") if quarantine else F.lit("skipped")
    rest = aside
    if attempt:
        rest = F.when(~F.col("writable"), "skipped").when(F.col("repaired"), "repaired").otherwise(aside)
    return (
        F.when(~F.col("readable"), "permission_error")
        .when(F.col("corruption_type") == "none", "clean")
        .when(F.col("corruption_type") == "invalid_format", aside)
        .otherwise(rest)
    )


def decide(files: DataFrame, attempt: bool = True, quarantine: bool = True) -> DataFrame:
    return files.withColumn("status", decision(attempt, quarantine))


def counts(decided: DataFrame) -> DataFrame:
    """One row: checked, and how many files have each status."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return decided.agg(F.count("*").alias("checked"), of("clean").alias("clean"), of("repaired").alias("repaired"), of("quarantined").alias("quarantined"), of("permission_error").alias("permission_errors"), of("skipped").alias("skipped"), of("error").alias("errors"))


def problems(decided: DataFrame) -> DataFrame:
    return decided.filter("status <> 'clean'")
