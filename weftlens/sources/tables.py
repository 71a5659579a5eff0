"""Reading the annotation tables and settling redelivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """The parquet table ``name`` below ``base``; only ``columns`` if any are named."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_arrivals(df: DataFrame, *keys: str, arrival: str = "received_at") -> DataFrame:
    """One row for each key: the one that arrived first.

    A keyed aggregate (map-side combine), not a window: a key with very many
    redeliveries is reduced before the shuffle. Rows whose key is null are
    kept apart from each other only by their key columns, as SQL groups do.
    Ties of the arrival are settled by the smallest remaining columns, so the
    result is the same on every run. A null arrival counts as the last.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.coalesce(F.col(arrival), F.lit("9999-12-31").cast("timestamp")).alias("__at")]
    picked = F.min_by(F.struct(*rest), F.struct(*order, *[_orderable(df, c) for c in rest if c != arrival]))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def _orderable(df: DataFrame, column: str):
    """Nested columns are compared by their hash; maps and variants can't be ordered."""
    kind = df.schema[column].dataType.typeName()
    return F.xxhash64(F.to_json(F.struct(column))).alias(f"__o_{column}") if kind in ("map", "variant") else F.col(column).alias(f"__o_{column}")
