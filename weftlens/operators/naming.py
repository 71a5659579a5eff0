"""Deterministic positions and names: re-indexing, running identifiers, unique names with suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def reindex(rows: DataFrame, scope: str, declared: str, order: list[str], out: str = "new_index") -> DataFrame:
    """Declared numbers where a scope's are exactly 0..n-1, else positions in order."""
    whole = Window.partitionBy(scope)
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.col(declared).asc_nulls_last(), *order)) - 1)
    fits = F.min(F.coalesce(F.col("__rank") == F.col(declared), F.lit(False)).cast("int")).over(whole) == 1
    position = F.row_number().over(Window.partitionBy(scope).orderBy(*order)) - 1
    return ranked.withColumn(out, F.when(fits, F.col(declared)).otherwise(position).cast("int")).drop("__rank")


def running_ids(rows: DataFrame, scope: str, order: list[str], base, out: str) -> DataFrame:
    """``base`` plus the position in the scope; ``order`` must settle all ties.

    Rows are range-partitioned by scope and order and numbered part by part, on
    top of the counts of the parts before: a scope that holds a third of all
    rows is many tasks. Null scopes are one scope. The partitioning is written
    once, so a lost task can't draw other bounds.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(rows.repartitionByRange(parts, scope, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col(scope).alias("__scope"), F.col("__part").alias("__at")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__scope").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__scope", "__at", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(scope, "__part").orderBy(*order))
    joined = ranged.withColumn("__row", within).join(before, F.col(scope).eqNullSafe(F.col("__scope")) & (F.col("__part") == F.col("__at")))
    return joined.withColumn(out, base + F.col("__before") + F.col("__row") - 1).select(*rows.columns, out)


def _suffixed(name: str, n: int) -> str:
    stem, dot, end = name.rpartition(".")
    return f"{stem}_{n}.{end}" if dot and stem and "/" not in end else f"{name}_{n}"


def unique_names(rows: DataFrame, scope: str, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """``name`` with ``_2``, ``_3`` … before its suffix where it was taken before, letter case ignored.

    One window settles all scopes in which no made-up name meets another; only
    scopes with such a collision are renamed one row after the other. They are
    streamed in sorted order with a set of the names of one scope.
    """
    key = F.lower(name)
    turn = F.row_number().over(Window.partitionBy(scope, key).orderBy(*order))
    dotted = F.regexp_extract(name, r"^(.+)(\.[^./]*)$", 1)
    made = F.when(F.col("__turn") == 1, F.col(name)).when(dotted != "", F.concat(dotted, F.lit("_"), F.col("__turn").cast("string"), F.regexp_extract(name, r"^(.+)(\.[^./]*)$", 2))).otherwise(F.concat(F.col(name), F.lit("_"), F.col("__turn").cast("string")))
    first = rows.withColumn("__turn", turn).withColumn(out, made)
    clash = first.groupBy(scope, F.lower(out).alias("__k")).count().filter("count > 1").select(scope).distinct()
    calm = first.join(clash, scope, "left_anti").drop("__turn")
    rough = first.join(clash, scope, "left_semi").drop("__turn")
    schema = calm.schema

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, turns = None, set(), {}
        for batch in batches:
            names = []
            for s, wanted in zip(batch[scope], batch[name]):
                if s != at:
                    at, used, turns = s, set(), {}
                if wanted is None:
                    names.append(None)
                    continue
                candidate, base = wanted, wanted.lower()
                n = turns.get(base, 2)
                while candidate.lower() in used:
                    candidate, n = _suffixed(wanted, n), n + 1
                turns[base] = n
                used.add(candidate.lower())
                names.append(candidate)
            yield batch.assign(**{out: pd.Series(names, index=batch.index, dtype=object)})[schema.names]

    ordered = rough.repartition(F.col(scope)).sortWithinPartitions(scope, *order)
    return calm.unionByName(ordered.mapInPandas(rename, schema))
