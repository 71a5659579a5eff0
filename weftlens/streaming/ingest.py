"""Streams of annotation tables: redeliveries dropped, late rows waited for, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """Parquet files that arrive below ``path``, or that one file, as a stream; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    # A pattern of one name: the source takes a file only where it looks for files itself.
    one = f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_at_once)).parquet(one)


def first_arrivals(stream: DataFrame, keys: list[str], arrival: str = "received_at", wait: str = "120 days") -> DataFrame:
    """Each key once; its redeliveries within ``wait`` are dropped, and state older than that is let go."""
    return stream.withWatermark(arrival, wait).dropDuplicatesWithinWatermark(keys)


def arrivals_by_window(stream: DataFrame, scope: str, arrival: str = "received_at", size: str = "30 days", wait: str = "120 days") -> DataFrame:
    """Rows per scope and window of arrival; late rows count as long as the watermark allows."""
    return stream.withWatermark(arrival, wait).groupBy(F.window(arrival, size), scope).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), scope, "n")
