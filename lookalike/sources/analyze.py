"""Analysis of image files: size, mode, hashes, score; what fails becomes an error on the row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.scalars import depth_of_mode, extension, quality_score
from ..schema import ASSET

_LOOK = "format string, width int, height int, mode string, phash string, error string, kind string"


def look(data: bytes | None, path: str = "", perceptual: bool = True, heif: bool = False) -> tuple:
    """Format, size, mode, perceptual hash, error and kind of damage of an image's bytes. Sizes stay where only the pixels
    can't be read; a format that no decoder is there for has no hash, and that is no error."""
    if data is None:
        return None, None, None, None, None, "File not found", "unknown"
    if path.lower().endswith((".heic", ".heif")) and not heif:
        return None, None, None, None, None, "no decoder for HEIF files", "unknown"
    head, hashed = pixels.Header(""), None
    try:
        head = pixels.header(data)
        image = pixels.pixels(data)
        if perceptual:
            hashed = pixels.perceptual_hash(image)
    except pixels.Unreadable as e:
        if e.kind == "invalid_format":
            return None, None, None, None, None, "Not a valid image file", e.kind
        if e.kind != "no_decoder":
            return head.format or None, head.width, head.height, head.mode, None, f"Corrupt or truncated image: {e}", e.kind
    return head.format, head.width, head.height, head.mode, hashed, None, "none"


def analyze(contents: DataFrame, perceptual: bool = True, hashes: bool = True) -> DataFrame:
    """contents: path, mtime, file_size, content. Rows of ASSET, with mtime and corruption_type. The content hash is
    native and is skipped if not asked for; rows with an error have no score."""

    def run(paths: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for path, content in paths:
            yield pd.DataFrame([look(c, p, perceptual) for p, c in zip(path, content)], columns=["format", "width", "height", "mode", "phash", "error", "kind"])

    seen = F.pandas_udf(run, _LOOK)
    rows = contents.withColumn("look", seen("path", "content"))
    rows = rows.select(
        "path",
        "file_size",
        F.col("look.width").alias("width"),
        F.col("look.height").alias("height"),
        (F.col("look.width").cast("long") * F.col("look.height")).alias("pixel_count"),
        F.when(F.col("look.mode").isNotNull(), depth_of_mode("look.mode")).alias("bit_depth"),
        F.col("look.format").alias("format"),
        (F.sha2("content", 256) if hashes else F.lit(None).cast("string")).alias("file_hash"),
        F.col("look.phash").alias("perceptual_hash"),
        F.lit(None).cast("string").alias("dominant_color"),
        F.col("look.error").alias("error"),
        "mtime",
        F.col("look.kind").alias("corruption_type"),
    )
    rows = rows.withColumn("quality_score", F.when(F.col("error").isNull(), quality_score()))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in ASSET.fields], "mtime", "corruption_type")


def colors(contents: DataFrame, n: int = 1) -> DataFrame:
    """path, dominant colours (array of r, g, b; null of unreadable files), the first one's channels, and is_gray."""

    def run(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in content:
            out = []
            for data in batch:
                try:
                    image = pixels.pixels(data)
                    found = pixels.dominant_colors(image, n)
                    out.append(([dict(zip("rgb", c)) for c in found], *found[0], pixels.is_grayscale(image)))
                except pixels.Unreadable:
                    out.append((None, None, None, None, None))
            yield pd.DataFrame(out, columns=["colors", "r", "g", "b", "is_gray"])

    seen = F.pandas_udf(run, "colors array<struct<r:int,g:int,b:int>>, r int, g int, b int, is_gray boolean")
    return contents.withColumn("_c", seen("content")).select("path", "_c.*")


def dominant_text(rows: DataFrame) -> DataFrame:
    """path and "R,G,B" for the cache."""
    return rows.select("path", F.concat_ws(",", *[F.col(c).cast("string") for c in "rgb"]).alias("dominant_color")).filter("dominant_color <> ''")


def true_formats(contents: DataFrame) -> DataFrame:
    """path and format by the bytes, null of others."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pixels.sniff(bytes(c[:64])) if c is not None else None)

    return contents.select("path", run(F.substring("content", 1, 64)).alias("format"))


def heif_supported() -> bool:
    """Whether a decoder for HEIF is installed here."""
    try:
        import pillow_heif  # noqa: F401
    except ImportError:
        return False
    return True


def convertible(rows: DataFrame, extensions: list[str]) -> DataFrame:
    return rows.filter(extension("path").isin(extensions))
