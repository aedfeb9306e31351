"""Plans that set dates: EXIF tags and file times drawn from a range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exif_time, random_time
from ..schema import EXIF_EXTENSIONS
from .moves import in_extensions


def _checked(start: datetime, end: datetime) -> None:
    if start >= end:
        raise ValueError("start must lie before end")


def randomize_dates(files: DataFrame, start: datetime, end: datetime, seed: int = 0, clamp: bool = False) -> DataFrame:
    """path and new_time. Times may lie less than a day after end unless clamped."""
    _checked(start, end)
    drawn = random_time(F.col("path"), F.lit(start), F.lit(end), seed)
    return files.select("path", (F.least(drawn, F.lit(end)) if clamp else drawn).alias("new_time"))


def randomize_exif_dates(files: DataFrame, start: datetime, end: datetime, seed: int = 0) -> DataFrame:
    """path and exif_time, the text of the three date tags; JPEG and TIFF files only."""
    drawn = randomize_dates(in_extensions(files, EXIF_EXTENSIONS), start, end, seed)
    return drawn.select("path", exif_time("new_time").alias("exif_time"))
