"""Image headers: format and dimensions from the first bytes, and what they contradict."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import suffix_format, with_suffix

# Limits of an image.
MOST_AXIS, MOST_PIXELS, HEADER_BYTES = 100_000, 1_000_000_000, 1 << 20
# JPEG markers of a frame header, and those without a length.
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = {0x01, *range(0xD0, 0xD9)}
HEADER = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("issue", T.StringType())])


def _jpeg(b: bytes) -> tuple[int, int]:
    at = 2
    while True:
        if b[at] != 0xFF:
            raise ValueError("no marker")
        while b[at] == 0xFF:
            at += 1
        marker = b[at]
        at += 1
        if marker in _BARE:
            continue
        if marker in _FRAMES:
            height, width = struct.unpack_from(">HH", b, at + 3)
            return width, height
        length = struct.unpack_from(">H", b, at)[0]
        if length < 2 or marker in (0xD9, 0xDA):
            raise ValueError("no frame")
        at += length


def _webp(b: bytes) -> tuple[int, int]:
    kind = b[12:16]
    if kind == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L" and b[20] == 0x2F:
        bits = struct.unpack_from("<I", b, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack_from("<HH", b, 26)
        return w & 0x3FFF, h & 0x3FFF
    raise ValueError("no chunk")


def _bmp(b: bytes) -> tuple[int, int]:
    if struct.unpack_from("<I", b, 14)[0] == 12:
        return struct.unpack_from("<HH", b, 18)
    width, height = struct.unpack_from("<ii", b, 18)
    if height == -(2**31):
        raise ValueError("height")
    return width, abs(height)


def _png(b: bytes) -> tuple[int, int]:
    if b[12:16] != b"IHDR":
        raise ValueError("no header chunk")
    return struct.unpack_from(">II", b, 16)


def _gif(b: bytes) -> tuple[int, int]:
    return struct.unpack_from("<HH", b, 6)


#: Format, how its content begins, and who reads its dimensions.
_READERS = [("png", rb"\x89PNG\r\n\x1a\n", _png), ("jpeg", rb"\xff\xd8", _jpeg), ("gif", rb"GIF8[79]a", _gif), ("bmp", rb"BM", _bmp), ("webp", rb"RIFF.{4}WEBP", _webp)]


def probe(content: bytes | None) -> tuple[str, int | None, int | None, str | None]:
    """(format, width, height, issue) of an image's first bytes."""
    if not content:
        return "unknown", None, None, "IMAGE_SOURCE_MISSING"
    b = bytes(content)
    kind, read = next(((k, r) for k, start, r in _READERS if re.match(start, b, re.DOTALL)), ("unknown", None))
    if read is None:
        return kind, None, None, "IMAGE_FORMAT_UNSUPPORTED"
    try:
        width, height = read(b)
    except (struct.error, IndexError, ValueError):
        return kind, None, None, "IMAGE_HEADER_INVALID"
    if width <= 0 or height <= 0:
        return kind, None, None, "IMAGE_DIMENSIONS_INVALID"
    if width > MOST_AXIS or height > MOST_AXIS or width * height > MOST_PIXELS:
        return kind, width, height, "IMAGE_DIMENSIONS_TOO_LARGE"
    return kind, width, height, None


@F.pandas_udf(HEADER)
def _header(contents: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([probe(c) for c in contents], columns=HEADER.names)
    return found.astype({"format": object, "issue": object, "width": "Int64", "height": "Int64"})


def image_header(content: Column) -> Column:
    """Struct (format, width, height, issue); only the first MiB crosses into Python."""
    return _header(F.substring(content, 1, HEADER_BYTES))


def verify_images(images: DataFrame) -> DataFrame:
    """``images`` (path, content, width, height, …) with ``detected`` and ``issues``, missing dimensions filled and a suffix proposed.

    Issues: those of the header, IMAGE_DIMENSIONS_MISMATCH where declared
    dimensions differ, IMAGE_FORMAT_MISMATCH where the suffix names another
    format; ``repaired_path`` then has the suffix of the format found.
    """
    found = images.withColumn("detected", image_header(F.col("content"))).drop("content")
    right = F.col("detected.issue").isNull()
    differs = right & ((F.col("width") != F.col("detected.width")) | (F.col("height") != F.col("detected.height")))
    named = suffix_format(F.col("path"))
    other = right & ~named.eqNullSafe(F.col("detected.format"))
    listed = F.filter(F.array(F.col("detected.issue"), F.when(differs, "IMAGE_DIMENSIONS_MISMATCH"), F.when(other & named.isNotNull(), "IMAGE_FORMAT_MISMATCH")), lambda i: i.isNotNull())
    suffix = F.when(F.col("detected.format") == "jpeg", "jpg").otherwise(F.col("detected.format"))
    return found.withColumns({"issues": listed, "width": F.coalesce("width", "detected.width"), "height": F.coalesce("height", "detected.height"), "repaired_path": F.when(other, with_suffix(F.col("path"), suffix))})
