"""Diagnostics: bounded lists, summaries by disposition, usage against limits, loss of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What becomes of the value that a diagnostic is about.
DISPOSITIONS = ["preserve", "rebuild", "degrade", "drop", "block"]


def disposition_summary(diagnostics: DataFrame, scope: str) -> DataFrame:
    """Counts per disposition and the status: blocked, confirmation-required (degrade or drop) or compatible."""
    counts = diagnostics.groupBy(scope).agg(*[F.count_if(F.col("disposition") == d).alias(f"n_{d}") for d in DISPOSITIONS])
    status = F.when(F.col("n_block") > 0, "blocked").when(F.col("n_degrade") + F.col("n_drop") > 0, "confirmation-required").otherwise("compatible")
    return counts.withColumn("status", status)


def bounded(diagnostics: DataFrame, scope: str, order: list[str], most: int = 255, sentinel: str = "PROJECT_DIAGNOSTIC_LIMIT_EXCEEDED") -> DataFrame:
    """The first ``most`` diagnostics of each scope in order, and one blocking sentinel where there were more.

    The limit is the feature. A scope's window keeps a bounded heap of rows
    (row_number under a filter), so a scope with very many costs no sort of all.
    """
    ranked = diagnostics.withColumn("position", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
    kept = ranked.filter(F.col("position") <= most + 1)
    over = F.col("position") == most + 1
    return kept.withColumns({"code": F.when(over, sentinel).otherwise(F.col("code")), "disposition": F.when(over, "block").otherwise(F.col("disposition"))})


def saturating(total: Column, most: int) -> Column:
    """A sum that stops counting one above its limit."""
    return F.least(total, F.lit(most + 1))


def usage(files: DataFrame, scope: str, size: str, most_files: int = 19_996, most_bytes: int = 32 << 30) -> DataFrame:
    """Files and bytes of each scope, and the first limit they exceed: IMAGE_SOURCE_FILE_LIMIT, IMAGE_SOURCE_SIZE_LIMIT or null."""
    sums = files.groupBy(scope).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"))
    return sums.withColumn("limit_code", F.when(F.col("n_files") > most_files, "IMAGE_SOURCE_FILE_LIMIT").when(F.col("n_bytes") > most_bytes, "IMAGE_SOURCE_SIZE_LIMIT"))


def contiguous(rows: DataFrame, scope: str, index: str) -> DataFrame:
    """Whether the indexes of each scope are unique, zero-based and without gaps."""
    sums = rows.groupBy(scope).agg(F.min(index).alias("low"), F.max(index).alias("high"), F.count(index).alias("n"), F.countDistinct(index).alias("n_distinct"))
    return sums.withColumn("is_contiguous", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n") == F.col("n_distinct")))


def group_conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose rows don't all hold the same value: (keys, n_rows, n_values)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def meaningful(value: Column) -> Column:
    """Whether the text of a JSON value says anything: not null, "", [] or {}."""
    return value.isNotNull() & ~F.regexp_replace(value, r"\s", "").isin("", "null", '""', "[]", "{}")


def first_of_each(rows: DataFrame, scope: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each scope in order, with their position: a bounded sample for a report."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(scope).orderBy(*order))).filter(F.col("position") <= most)
