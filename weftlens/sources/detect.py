"""What a project file is, by its content and never by its suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first four bytes of ZIP archives (with entries, empty, spanned).
ZIP_SIGNATURES = ["504B0304", "504B0506", "504B0708"]
# Most bytes of text of the two generations, and the suffixes that belong to the formats.
TEXT_LIMITS = {"v1-xml": 32 << 20, "v2-json": 16 << 20}
SUFFIXES = {"v1-xml": [".srproj"], "v2-json": [".subvisionproj", ".json"], "zip": [".zip", ".visionproj"]}


def format_of(content: Column) -> Column:
    """``zip``, ``v1-xml``, ``v2-json`` or ``unknown`` from the first bytes; null content stays null."""
    magic = F.hex(F.substring(content, 1, 4))
    head = F.hex(F.substring(content, 1, 256))
    first = F.regexp_extract(head, r"^(?:EFBBBF)?(?:09|0A|0D|20)*([0-9A-F]{2})", 1)
    return F.when(content.isNotNull(), F.when(magic.isin(ZIP_SIGNATURES), "zip").when(first == "3C", "v1-xml").when(first == "7B", "v2-json").otherwise("unknown"))


def read_project_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, text, code) of the files below ``path``: ``code`` says why a text can't be read.

    Codes: INPUT_FORMAT_UNKNOWN, PROJECT_TEXT_TOO_LARGE, PROJECT_TEXT_UTF8_INVALID,
    INPUT_EXTENSION_MISMATCH (a warning: the text is read all the same). Empty
    files have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.withColumn("format", format_of(F.col("content")))
    most = F.element_at(F.create_map(*[F.lit(x) for pair in TEXT_LIMITS.items() for x in pair]), F.col("format"))
    suffix_fits = F.lit(False)
    for name, suffixes in SUFFIXES.items():
        for suffix in suffixes:
            suffix_fits |= (F.col("format") == name) & F.lower("path").endswith(suffix)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    code = (
        F.when(F.col("format") == "unknown", "INPUT_FORMAT_UNKNOWN")
        .when(F.col("length") > most, "PROJECT_TEXT_TOO_LARGE")
        .when(most.isNotNull() & ~valid, "PROJECT_TEXT_UTF8_INVALID")
        .when(~suffix_fits, "INPUT_EXTENSION_MISMATCH")
    )
    readable = most.isNotNull() & (F.col("length") <= most) & valid
    return known.select("path", "length", "format", F.when(readable, F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")).alias("text"), code.alias("code"))
