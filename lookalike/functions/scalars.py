"""Scalar functions as column expressions; all of them run in generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALPHABET_FOLDERS, DEFAULT_DEPTH, DEFAULT_RANK, FORMAT_EXTENSIONS, FORMAT_RANK, LONGEST_PATH, MODE_DEPTH, RESERVED_NAMES, RESOLUTION_CLASSES


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(table: dict, key: Column, default) -> Column:
    """A value of a small constant table by key."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(entries[key], F.lit(default))


# Paths


def filename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def directory(path: Column | str) -> Column:
    """What precedes the last slash; "/" for the root's files, "" without a slash."""
    head = F.regexp_extract(col(path), r"(?s)^(.*)/[^/]*$", 1)
    return F.when(col(path).rlike(r"(?s)^/[^/]*$"), F.lit("/")).otherwise(head)


def extension(path: Column | str) -> Column:
    """From the last dot of the name on, lower-cased; leading dots belong to the stem."""
    return F.lower(F.regexp_extract(filename(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def stem(name: Column | str) -> Column:
    """A name without its extension as a path library has it: a dot at the end is no extension."""
    name = col(name)
    return F.when(name.rlike(r"(?s)^\.*[^.].*\.[^.]+$"), F.regexp_extract(name, r"(?s)^(.*)\.[^.]+$", 1)).otherwise(name)


def suffix(name: Column | str) -> Column:
    name = col(name)
    return F.substr(name, F.length(stem(name)) + 1)


def relative_directory(path: Column | str, root: str) -> Column:
    """Directory below root, "" for root itself."""
    return F.regexp_replace(directory(path), "^" + re.escape(root.rstrip("/")) + "/?", "")


def under(path: Column | str, root: Column | str) -> Column:
    """Whether a path is root or lies below it; root "/a" is not above "/ab"."""
    root = F.rtrim(col(root), F.lit("/")) if isinstance(root, Column) else F.lit(root.rstrip("/"))
    return (col(path) == root) | col(path).startswith(F.concat(root, F.lit("/")))


def cache_key(path: Column | str, mtime: Column | str, size: Column | str) -> Column:
    return F.concat_ws(":", col(path), col(mtime).cast("string"), col(size).cast("string"))


# Numbers


def resolution(width: Column | str, height: Column | str) -> Column:
    return F.concat_ws("x", col(width).cast("string"), col(height).cast("string"))


def megapixels(pixels: Column | str) -> Column:
    return F.bround(col(pixels) / 1e6, 2)


def human_size(size: Column | str) -> Column:
    """Bytes as B, KB, MB, GB or TB of 1024 with one decimal."""
    size = col(size).cast("double")
    out = F.format_string("%.1f TB", size / float(1024**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < float(1024 ** (power + 1)), F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return F.when(size.isNotNull(), out)


def with_separators(n: Column | str) -> Column:
    return F.format_number(col(n).cast("long"), 0)


def duration(seconds: Column | str) -> Column:
    """45s, 2m 30s, 1h 1m."""
    s = F.floor(col(seconds)).cast("long")
    minutes, hours = F.expr("0") + F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    text = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.when(s < 60, text(s, "s")).when(s < 3600, F.concat_ws(" ", text(minutes, "m"), text(s % 60, "s"))).otherwise(F.concat_ws(" ", text(hours, "h"), text(F.floor((s % 3600) / 60).cast("long"), "m")))


def hit_rate(hits: Column | str, total: Column | str) -> Column:
    """Percent, 0 where there is nothing."""
    return F.when(col(total) > 0, col(hits) / col(total) * 100.0).otherwise(F.lit(0.0))


def rank_of_format(path: Column | str) -> Column:
    return lookup(FORMAT_RANK, extension(path), DEFAULT_RANK)


def depth_of_mode(mode: Column | str) -> Column:
    return lookup(MODE_DEPTH, col(mode), DEFAULT_DEPTH)


def quality_score(path="path", pixels="pixel_count", size="file_size", depth="bit_depth") -> Column:
    """Up to 50 for pixels, 30 for bytes, 10 for depth and 20 for the format; a part counts if its input is above 0."""
    part = lambda x, value: F.when(col(x) > 0, value).otherwise(F.lit(0.0))
    return (
        part(pixels, F.least(F.lit(50.0), col(pixels) / 1e6 * 2.0))
        + part(size, F.least(F.lit(30.0), col(size) / 1048576.0 * 3.0))
        + part(depth, F.least(F.lit(10.0), col(depth) / 3.2))
        + rank_of_format(path) / 5.0
    )


# Classes


def color_name(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Name of a colour by saturation, brightness and the dominance of one channel."""
    r, g, b = (col(x).cast("double") for x in (r, g, b))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    pale = F.when(most == 0, F.lit(0.0)).otherwise((most - least) / most) < 0.15
    light = (r + g + b) / 3
    reddish = F.when((g > b * 1.5) & (r > g * 1.2), "orange").when(g > b * 1.5, "yellow").when(r > b * 1.5, "red").otherwise("pink")
    greenish = F.when(r > b * 1.5, "yellow").when(b > r * 1.3, "cyan").otherwise("green")
    bluish = F.when(r > g * 1.3, "purple").when(g > r * 1.3, "cyan").otherwise("blue")
    return (
        F.when(pale & (light < 50), "black")
        .when(pale & (light < 128), "gray")
        .when(pale, "white")
        .when((r > g) & (r > b), reddish)
        .when((g > r) & (g > b), greenish)
        .when((b > r) & (b > g), bluish)
        .otherwise("brown")
    )


def resolution_class(width: Column | str, height: Column | str) -> Column:
    longer = F.greatest(col(width), col(height))
    out = F.lit("unknown")
    for name, least in reversed(RESOLUTION_CLASSES):
        out = F.when(longer >= least, name).otherwise(out)
    return out


def orientation(width: Column | str, height: Column | str) -> Column:
    width, height = col(width), col(height)
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    return F.when(height == 0, "landscape").when(ratio.between(0.95, 1.05), "square").when(width > height, "landscape").otherwise("portrait")


def alphabet_folder(name: Column | str) -> Column:
    """Folder by the first character, null for others than letters and digits."""
    first = F.upper(F.substring(col(name), 1, 1))
    out = F.lit(None).cast("string")
    for folder, low, high in ALPHABET_FOLDERS:
        out = F.when(first.between(low, high), folder).otherwise(out)
    return out


def corruption_of(message: Column | str) -> Column:
    """Kind of damage by a decoder's message."""
    low = F.lower(col(message))
    return F.when(low.rlike("truncat|premature|eof|unexpected end"), "truncated").when(low.rlike("exif|ifd|tag|tiff"), "bad_exif").otherwise("unknown")


def extension_fits(format: Column | str, path: Column | str) -> Column:
    """Whether a path's extension is one of the format's; null for other formats."""
    fits = F.create_map(*[x for name, valid in FORMAT_EXTENSIONS.items() for x in (F.lit(name), F.array(*map(F.lit, valid)))])
    return F.array_contains(fits[col(format)], extension(path))


def preferred_extension(format: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for name, valid in FORMAT_EXTENSIONS.items() for x in (name, valid[0])])[col(format)]


# Names


def sanitized(name: Column | str) -> Column:
    """A name that all systems take: no special characters, no reserved stem, no blank or dot at its ends, not empty."""
    clean = F.regexp_replace(col(name), r'[<>:"/\\|?*]', "_")
    safe = F.when(F.upper(stem(clean)).isin(RESERVED_NAMES), F.concat(F.lit("_"), clean)).otherwise(clean)
    short = F.trim(safe, F.lit(" ."))
    return F.when(short == "", "unnamed").otherwise(short)


def shortened(path: Column | str, longest: int = LONGEST_PATH) -> Column:
    """A path cut to a length at its stem; null where the directory and the extension leave no room."""
    path = col(path)
    folder, name = directory(path), filename(path)
    room = F.lit(longest - 1) - F.length(folder) - F.length(suffix(name))
    cut = F.concat(folder, F.lit("/"), F.substr(stem(name), F.lit(1), room), suffix(name))
    return F.when(F.length(path) <= longest, path).when(room >= 1, cut)


def parent_name(grandparent: Column, parent: Column, index: Column, suffix_: Column) -> Column:
    """grandparent_parent_index.ext, or parent_index.ext where the grandparent is empty."""
    head = F.when(grandparent == "", parent).otherwise(F.concat_ws("_", grandparent, parent))
    return F.concat(head, F.lit("_"), index.cast("string"), suffix_)


def numbered(name: Column, n: Column) -> Column:
    """stem_n.ext for n above 0, else the name."""
    return F.when(n > 0, F.concat(stem(name), F.lit("_"), n.cast("string"), suffix(name))).otherwise(name)


def random_name(key: Column, length: int = 12, seed: int = 0) -> Column:
    """Letters and digits drawn from a digest of the key, so that a retried task draws the same."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(62)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), draw), "")


# Dates


def parsed_date(text: Column | str) -> Column:
    """YYYY-MM-DD with or without HH:MM:SS; null otherwise."""
    text = col(text)
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def random_time(key: Column, start: Column, end: Column, seed: int = 0) -> Column:
    """start and a number of whole days up to the days between, and seconds of a day, drawn from a digest of the key. It
    can lie less than a day after end."""
    days = F.pmod(F.xxhash64(key, F.lit(seed)), F.datediff(end, start).cast("long") + 1)
    seconds = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(86400))
    return F.timestamp_seconds(F.unix_timestamp(start) + days * 86400 + seconds)


def exif_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy:MM:dd HH:mm:ss")


def parsed_rgb(text: Column | str) -> Column:
    """ "R,G,B" as a struct of three ints; null if it is none."""
    parts = F.split(col(text), ",")
    channel = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    return F.when(F.size(parts) == 3, F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b")))


def dotted(extensions: list[str] | None) -> list[str] | None:
    """Extensions with their dots, lower-cased."""
    return None if extensions is None else [e.lower() if e.startswith(".") else f".{e.lower()}" for e in (x.strip() for x in extensions) if e]
