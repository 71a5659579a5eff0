"""ZIP archives as a Spark data source: entries with their sizes, modes and, if asked, their first bytes."""

from __future__ import annotations

import glob
import io
import os
import re
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import entry_problem, nfkc_lower

# Limits of an archive.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_TOTAL_BYTES, MOST_RATIO, MOST_NAME_BYTES, MOST_NAMES_BYTES = 20_000, 4 << 30, 32 << 30, 200, 4096, 8 << 20
MOST_TEXT_BYTES = 32 << 20
SCHEMA = "archive string, entry_name string, compressed_size bigint, uncompressed_size bigint, is_dir boolean, encrypted boolean, unix_mode int, prefix binary"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.prefix = options["path"], int(options.get("prefixbytes", options.get("prefixBytes", "0")))
        self.whole = options.get("wholepattern", options.get("wholePattern"))

    def partitions(self) -> list[InputPartition]:
        """One task per archive: a central directory is read whole, entries one after the other."""
        below = sorted(p for p in glob.glob(f"{self.path}/**", recursive=True) if os.path.isfile(p)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in below]

    def read(self, partition: _File) -> Iterator[tuple]:
        if zipfile.is_zipfile(partition.path):
            yield from _entries(partition.path, partition.path, self.prefix, self.whole)


def _entries(name: str, source, prefix: int, whole: str | None) -> Iterator[tuple]:
    """Rows of one archive; entries whose name matches ``whole`` are read up to the largest text, others up to ``prefix`` bytes."""
    with zipfile.ZipFile(source) as archive:
        for entry in archive.infolist():
            encrypted = bool(entry.flag_bits & 1)
            most = MOST_TEXT_BYTES if whole and re.search(whole, entry.filename) else prefix
            first = b""
            if most and not entry.is_dir() and not encrypted:
                with archive.open(entry) as stream:
                    first = stream.read(most)
            yield name, entry.filename, entry.compress_size, entry.file_size, entry.is_dir(), encrypted, entry.external_attr >> 16, first


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").option("prefixBytes", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, path: str, prefix_bytes: int = 0, whole: str | None = None) -> DataFrame:
    """Entries of the archives below a folder that all executors have mounted; ``whole`` is a pattern of the names whose content is wanted."""
    spark.dataSource.register(ZipEntries)
    reader = spark.read.format("zip_entries").option("prefixBytes", str(prefix_bytes))
    return (reader.option("wholePattern", whole) if whole else reader).load(path)


def read_stored_archives(spark: SparkSession, path: str, prefix_bytes: int = 0, whole: str | None = None) -> DataFrame:
    """The same of archives on any file system that Spark reads (up to 2 GB each, which is what one value may hold); files that are no archive have no row."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                source = io.BytesIO(content)
                if zipfile.is_zipfile(source):
                    yield pd.DataFrame(list(_entries(name, source, prefix_bytes, whole)), columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(unpack, SCHEMA)


def is_link(mode: Column) -> Column:
    return F.coalesce(mode.bitwiseAND(0xF000) == stat.S_IFLNK, F.lit(False))


def entry_code(df: DataFrame) -> Column:
    """First reason against an entry, null if there is none."""
    unsafe = entry_problem(F.col("entry_name"))
    return (
        F.when(F.octet_length("entry_name") > MOST_NAME_BYTES, "ZIP_ENTRY_NAME_TOO_LONG")
        .when(F.coalesce("encrypted", F.lit(False)) if "encrypted" in df.columns else F.lit(False), "ZIP_ENCRYPTED_ENTRY")
        .when(is_link(F.col("unix_mode")), "ZIP_SYMBOLIC_LINK")
        .when(F.col("is_dir") & (F.col("uncompressed_size") > 0), "ZIP_DIRECTORY_HAS_DATA")
        .when(F.col("uncompressed_size") > MOST_ENTRY_BYTES, "ZIP_ENTRY_TOO_LARGE")
        .when((F.col("uncompressed_size") > 0) & (F.col("uncompressed_size") > F.col("compressed_size") * MOST_RATIO), "ZIP_SUSPICIOUS_RATIO")
        .when(unsafe.isNotNull(), F.concat(F.lit("ZIP_UNSAFE_"), F.upper(F.translate(unsafe, "-", "_"))))
    )


def archive_summary(entries: DataFrame, scope: str = "archive") -> DataFrame:
    """Per archive: entries, bytes, unsafe entries, names that only differ in case or form, and the first limit exceeded."""
    keyed = entries.withColumns({"code": entry_code(entries), "entry_key": nfkc_lower(F.col("entry_name"))})
    names = keyed.groupBy(scope, "entry_key").agg(F.count("*").alias("n"), F.sum("uncompressed_size").alias("bytes"), F.sum(F.octet_length("entry_name")).alias("name_bytes"), F.count("code").alias("bad"))
    sums = names.groupBy(scope).agg(F.sum("n").alias("n_entries"), F.sum("bytes").alias("n_bytes"), F.sum("name_bytes").alias("n_name_bytes"), F.sum("bad").alias("n_unsafe"), F.sum(F.col("n") - 1).alias("n_duplicates"))
    return sums.withColumn("limit_code", F.when(F.col("n_entries") > MOST_ENTRIES, "ZIP_TOO_MANY_ENTRIES").when(F.col("n_name_bytes") > MOST_NAMES_BYTES, "ZIP_TOTAL_NAMES_TOO_LONG").when(F.col("n_bytes") > MOST_TOTAL_BYTES, "ZIP_TOTAL_TOO_LARGE"))
