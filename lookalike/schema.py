"""Record schemas and the fixed tables that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# File name extensions of images, by kind.
COMMON_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif"]
RAW_EXTENSIONS = [".raw", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".pef", ".srw", ".raf", ".3fr", ".dcr", ".kdc", ".mrw", ".nrw"]
OTHER_EXTENSIONS = [
    ".ico", ".icns", ".psd", ".psb", ".xcf", ".svg", ".eps", ".heic", ".heif", ".avif", ".jxl", ".pbm", ".pgm", ".ppm", ".pnm", ".tga", ".dds", ".exr", ".hdr",
    ".jp2", ".j2k", ".jpf", ".jpx", ".jpm", ".fits", ".fit", ".fts", ".pcx", ".sgi", ".rgb", ".rgba", ".bw",
]
IMAGE_EXTENSIONS = [*COMMON_EXTENSIONS, *RAW_EXTENSIONS, *OTHER_EXTENSIONS]
SORTABLE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"]
EXIF_EXTENSIONS = [".jpg", ".jpeg", ".tiff", ".tif"]
CONVERTIBLE_EXTENSIONS = [".png", ".bmp", ".webp"]

# Rank of a format by extension, 50 for others.
DEFAULT_RANK = 50
FORMAT_RANK = {e: 100 for e in RAW_EXTENSIONS} | {
    ".exr": 95, ".hdr": 95, ".tiff": 90, ".tif": 90, ".png": 85, ".bmp": 80, ".psd": 80, ".psb": 80, ".jxl": 80,
    ".webp": 75, ".avif": 75, ".heic": 75, ".heif": 75, ".jpg": 60, ".jpeg": 60, ".gif": 50, ".ico": 40, ".icns": 40,
}

# Bits of a pixel by mode, 24 for others.
DEFAULT_DEPTH = 24
MODE_DEPTH = {"1": 1, "L": 8, "P": 8, "RGB": 24, "RGBA": 32, "CMYK": 32, "YCbCr": 24, "LAB": 24, "HSV": 24, "I": 32, "F": 32, "I;16": 16, "I;16L": 16, "I;16B": 16, "I;16N": 16}

# Extensions that fit a format, the preferred one first.
FORMAT_EXTENSIONS = {
    "JPEG": [".jpg", ".jpeg"], "PNG": [".png"], "GIF": [".gif"], "BMP": [".bmp"], "TIFF": [".tiff", ".tif"], "WEBP": [".webp"], "ICO": [".ico"], "HEIF": [".heic"],
}

# Folders of the alphabetical sort with their first and last character.
ALPHABET_FOLDERS = [("A-G", "A", "G"), ("H-N", "H", "N"), ("O-T", "O", "T"), ("U-Z", "U", "Z"), ("0-9", "0", "9")]

# Names that one system reserves, and its bound on a path's length.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
LONGEST_PATH = 250

# Resolution classes and the least longer edge of each.
RESOLUTION_CLASSES = [("8k_plus", 7680), ("4k", 3840), ("2k", 2560), ("hd", 1920), ("large", 1280), ("medium", 640), ("small", 300), ("thumbnail", 100), ("tiny", 0)]

# Tables and bits of the bit-sampling index by the number of candidates it is for (exclusive bound).
INDEX_TIERS = [(10_000, 15, 20), (50_000, 18, 18), (200_000, 20, 16), (500_000, 25, 14), (None, 30, 12)]
INDEX_SEED = 42
INDEX_LEAST = 1000
DEFAULT_THRESHOLD = 10
HASH_BITS = 256

# The pipeline's steps and those that need dates.
PIPELINE_STEPS = ["random_rename", "convert_jpg", "randomize_exif", "randomize_dates", "cleanup_empty", "repair_corrupt"]
DATED_STEPS = ["randomize_exif", "randomize_dates"]

# Ages and page sizes.
CACHE_DAYS = 30
SESSION_HOURS = 24
HISTORY_LENGTH = 10
PAGE_GROUPS = 10
DISCOVERY_CHUNK = 1000

ASSET = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("file_size", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("pixel_count", T.LongType()),
        T.StructField("bit_depth", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("perceptual_hash", T.StringType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("dominant_color", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

CACHE = T.StructType([*ASSET.fields, T.StructField("mtime", T.DoubleType()), T.StructField("cache_key", T.StringType()), T.StructField("created_at", T.DoubleType()), T.StructField("last_accessed", T.DoubleType())])

GROUP_MEMBER = T.StructType([T.StructField("group_id", T.LongType()), T.StructField("match_type", T.StringType()), T.StructField("path", T.StringType())])

PLAN = T.StructType([T.StructField("op", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dest", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("status", T.StringType())])
