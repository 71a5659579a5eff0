"""References to records that do not exist (problem 6).

Parent keys are integers. Per scope they are sorted and compressed into runs
of consecutive keys that are alike, live or deleted; distinct referenced keys
are matched as-of to the run that starts at or before them, and keys beyond
its end are missing. A run carries the first and the last arrival of its live
keys: only references between the two have to look their key's arrival up.

Paths become integers by their running number: the last digits of a path are
its key, and the rest of it, with the number of digits, its scope within the
project. Files numbered through are one run.

Keys are cut into blocks of 65,536 values, and runs end at the block's edge:
scope and block together partition the match, so a project that holds a third
of all rows is many tasks. Reference rows never take part in it, only their
distinct keys; rows come back by an equi-join with those keys that have an
orphan at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import set_aside
from ..functions.visual import visual_form


#: Bits of a key within its block.
BLOCK_BITS = 16


def _block(key: Column) -> Column:
    return F.shiftright(key, BLOCK_BITS)


def parent_keys(parents: DataFrame) -> DataFrame:
    """(scope, key, live_at) of parents (scope, key, deleted_at, received_at): ``live_at`` is the first arrival of an undeleted row, null if all are deleted.

    Parents with a null scope or key are no targets.
    """
    live = F.when(F.col("deleted_at").isNull(), F.col("received_at"))
    return parents.filter("scope is not null and key is not null").groupBy("scope", "key").agg(F.min(live).alias("live_at"))


def parent_runs(keys: DataFrame) -> DataFrame:
    """(scope, block, run_start, run_end, deleted, first_live, last_live) of ``parent_keys``: consecutive keys that are all live or all deleted."""
    at = lambda *by: Window.partitionBy("scope", "block", *by).orderBy("key")
    alike = keys.select("scope", _block(F.col("key")).alias("block"), "key", "live_at", F.col("live_at").isNull().alias("deleted"))
    runs = alike.withColumn("run", F.col("key") - F.row_number().over(at("deleted"))).groupBy("scope", "block", "deleted", "run")
    return runs.agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"), F.min("live_at").alias("first_live"), F.max("live_at").alias("last_live")).drop("run")


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (row_id, orphan_kind, period) of references (row_id, scope, key, received_at) without a live target in time.

    ``missing``: no target; ``deleted``: every target is deleted; ``late``:
    the first live target arrived after the reference. ``period`` is the month
    (UTC) of the reference's first arrival; redelivered references count once,
    at their first arrival. A null key is no reference; a null scope has no
    targets, so its keys are missing. Scopes may be structs.
    """
    refs = references.filter("key is not null and row_id is not null")
    wanted = refs.groupBy("scope", "key").agg(F.min("received_at").alias("first_ref"))
    targets = parent_keys(parents)
    run = ["run_end", "deleted", "last_live"]
    runs = parent_runs(targets).select("scope", "block", F.col("run_start").alias("key"), F.lit(0).alias("is_ref"), F.struct(*run).alias("run"), F.lit(None).cast("timestamp").alias("first_ref"))
    nothing = F.lit(None).cast(runs.schema["run"].dataType).alias("run")
    merged = runs.unionByName(wanted.select("scope", _block(F.col("key")).alias("block"), "key", F.lit(1).alias("is_ref"), nothing, "first_ref"))
    preceding = Window.partitionBy("scope", "block").orderBy("key", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = merged.withColumn("run", F.last("run", ignorenulls=True).over(preceding)).filter("is_ref = 1")
    inside = F.coalesce(F.col("key") <= F.col("run.run_end"), F.lit(False))
    known = F.when(~inside, "missing").when(F.col("run.deleted"), "deleted").when(F.col("run.last_live") > F.col("first_ref"), "late")
    suspects = matched.select("scope", "key", known.alias("known")).filter("known is not null")
    # The rows of these keys, a small share: only those that may be late ask for the arrival of their very key.
    hits = refs.alias("r").join(suspects.alias("s"), F.col("r.scope").eqNullSafe(F.col("s.scope")) & (F.col("r.key") == F.col("s.key"))).select("r.row_id", "r.scope", "r.key", "r.received_at", "s.known")
    timed = hits.filter("known = 'late'").join(targets, ["scope", "key"]).select("row_id", "received_at", F.when(F.col("live_at") > F.col("received_at"), "late").alias("orphan_kind"))
    found = hits.filter("known <> 'late'").select("row_id", "received_at", F.col("known").alias("orphan_kind")).unionByName(timed)
    # A redelivered row arrives later: it can lose "late", never gain it, so its first arrival decides and is here if any row is.
    once = found.groupBy("row_id").agg(F.min_by("orphan_kind", "received_at").alias("orphan_kind"), F.min("received_at").alias("received_at"))
    return once.filter("orphan_kind is not null").select("row_id", "orphan_kind", F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("received_at").cast("timestamp_ntz")), "yyyy-MM").alias("period"))


_NUMBER = re.compile(r"[0-9]{1,18}(?=[^0-9]*$)")


def numbered_paths(df: DataFrame, project: str, path: str) -> DataFrame:
    """``df`` without ``path``, and (scope, key) of its consistent form: its last digits, up to 18 of them, are the key; the rest, hashed to 128 bits, and the project are the scope. Null stays null.

    One pass in Arrow batches: as an expression the form would be computed
    again for every use and every filter of it. Columns of ``df`` that clash
    with the new ones get ``_in`` after their name.
    """
    df, name = set_aside(df, ["scope", "key", "__shape"])
    project, path = name(project), name(path)
    keep = [f for f in df.schema.fields if f.name != path]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes, keys = [], []
            for p in batch[path]:
                form = None if p is None else visual_form(p).replace("\\", "/").lower()
                found = form and _NUMBER.search(form)
                shapes.append(f"{form[: found.start()]}\x01{form[found.end() :]}\x01{len(found.group())}" if found else form)
                keys.append(int(found.group()) if found else None if form is None else 0)
            yield batch[[f.name for f in keep]].assign(__shape=pd.Series(shapes, index=batch.index, dtype=object), key=pd.Series(keys, index=batch.index, dtype="Int64"))

    made = df.mapInPandas(split, T.StructType([*keep, T.StructField("__shape", T.StringType()), T.StructField("key", T.LongType())]))
    scope = F.struct(F.col(project).alias("project"), F.xxhash64("__shape").alias("a"), F.xxhash64(F.lit(1), "__shape").alias("b"))
    return made.select(*[f.name for f in keep], F.when(F.col(project).isNotNull() & F.col("__shape").isNotNull(), scope).alias("scope"), "key")


def find_reference_orphans(manifest: DataFrame, files: DataFrame, archive: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """All orphans of the annotation tables: (table_name, row_id, field_name, orphan_kind, period)."""
    as_path = lambda df, path, *columns: numbered_paths(df.select("project_key", path, *columns, "received_at"), "project_key", path)
    as_index = lambda df, *columns: df.select(F.col("project_key").alias("scope"), F.col("class_index").cast("long").alias("key"), *columns, "received_at")
    sets = [
        ("manifest_entries", "original_path", as_path(manifest, "original_path", F.col("entry_id").alias("row_id")), as_path(files, "source_path", "deleted_at")),
        ("manifest_entries", "relative_path", as_path(manifest, "relative_path", F.col("entry_id").alias("row_id")), as_path(archive, "entry_name", "deleted_at")),
        ("project_labels", "class_index", as_index(labels, F.col("label_uid").alias("row_id")), as_index(classes, "deleted_at")),
    ]
    found = [find_orphans(refs, parents).select(F.lit(table).alias("table_name"), "row_id", F.lit(field).alias("field_name"), "orphan_kind", "period") for table, field, refs, parents in sets]
    return found[0].unionByName(found[1]).unionByName(found[2])
