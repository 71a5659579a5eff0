"""Schemas that drift between files (problem 2)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import set_aside
from ..session import cut

_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object", type(None): "null"}


def _canonical(value) -> str | None:
    """Equal JSON values have equal texts: numbers by value, objects by sorted key."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value)) if isinstance(value, int) and abs(value) < 2**53 or isinstance(value, float) else str(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _raw(value) -> str | None:
    """The value as it is written, strings without quotes."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def json_paths(text: str | None, written: Callable = _canonical) -> list[tuple[str, str, str | None]] | None:
    """(path, kind, value) of every field down through objects; null if the text is no JSON object."""
    try:
        top = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out, todo = [], [("", top)]
    while todo:
        prefix, node = todo.pop()
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            kind = _KINDS[type(value)]
            out.append((path, kind, None if kind == "object" else written(value)))
            if kind == "object":
                todo.append((path, value))
    return out


def path_values(df: DataFrame, payload: str) -> DataFrame:
    """``df`` without its payload, and ``path``, ``kind``, ``value`` for each field: rows as path-value maps with raw types.

    Records without valid JSON (null, cut short, not an object) give no rows.
    Records are streamed in Arrow batches; nothing is gathered. Clashing columns
    get ``_in`` after their name.
    """
    df, name = set_aside(df, ["path", "kind", "value"])
    payload = name(payload)
    keep = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*keep, T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    names = [f.name for f in keep]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch[payload].map(json_paths)
            ok = found.notna()
            part = batch.loc[ok, names].assign(__f=found[ok]).explode("__f").dropna(subset="__f")
            if len(part):
                rows = pd.DataFrame(part["__f"].tolist(), columns=["path", "kind", "value"], index=part.index, dtype=object)
                part = part[names].reset_index(drop=True)
                yield pd.concat([part, rows.reset_index(drop=True)], axis=1)

    return df.mapInPandas(read, schema)


def path_statistics(records: DataFrame) -> DataFrame:
    """Path-type statistics of each (feed_id, batch_no): kinds seen, and digests of the values shared with the batch before and after.

    ``records`` has feed_id, batch_no, project_id, payload, received_at.
    Repeated rows of a record within a batch count once. One pass over the
    JSON; whatever the size of a feed, aggregation is partial before the
    shuffle and keyed by path.
    """
    order = F.struct("received_at", "payload")
    once = records.filter("project_id is not null").groupBy("feed_id", "batch_no", "project_id").agg(F.min_by("payload", order).alias("payload"))
    near = Window.partitionBy("feed_id", "project_id").orderBy("batch_no")
    once = once.withColumns({"in_prev": F.coalesce(F.lag("batch_no").over(near) == F.col("batch_no") - 1, F.lit(False)), "in_next": F.coalesce(F.lead("batch_no").over(near) == F.col("batch_no") + 1, F.lit(False))})
    values = path_values(once, "payload").withColumns({"__h1": F.xxhash64(F.lit(1), "project_id", "kind", F.coalesce("value", F.lit("\u0000"))), "__h2": F.xxhash64(F.lit(2), "kind", "project_id", F.coalesce("value", F.lit("\u0000")))})

    def side(flag: str) -> list[Column]:
        c = F.col(flag)
        return [
            F.count(F.when(c, 1)).alias(f"{flag}_n"), F.count(F.when(c & (F.col("kind") != "null"), 1)).alias(f"{flag}_known"),
            F.sum(F.when(c, F.col("__h1")).cast("decimal(20,0)")).alias(f"{flag}_h1"), F.expr(f"bit_xor(case when {flag} then __h2 end)").alias(f"{flag}_h2"),
        ]

    kinds = F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))))
    return values.groupBy("feed_id", "batch_no", "path").agg(kinds.alias("kinds"), F.max(F.col("kind") == "object").alias("is_object"), *side("in_prev"), *side("in_next"))


def schema_changes(records: DataFrame, least_known: int = 3) -> DataFrame:
    """Each change of a batch against the feed's batch before: added, removed, retyped, renamed.

    A path gone and a path new are one renaming where the records of both
    batches carry them with equal kinds and values throughout, at least
    ``least_known`` of them not null. Candidates meet by equality of the
    digests, never as pairs of all gone with all new paths. Batches without a
    batch before, or without a valid record, give no changes.
    """
    # A few rows per batch, used on both sides of the comparison: written once rather than planned and computed each time.
    stats = cut(path_statistics(records))
    key, number = ["feed_id", "batch_no"], stats.schema["batch_no"].dataType
    digest = ("n", "known", "h1", "h2")
    now = stats.select(*key, "path", F.col("kinds").alias("new_kinds"), F.col("is_object").alias("new_object"), *[F.col(f"in_prev_{x}").alias(f"new_{x}") for x in digest])
    before = stats.select("feed_id", (F.col("batch_no") + 1).cast(number).alias("batch_no"), "path", F.col("kinds").alias("old_kinds"), F.col("is_object").alias("old_object"), *[F.col(f"in_next_{x}").alias(f"old_{x}") for x in digest])
    both = now.join(before, [*key, "path"], "full")
    # Batches that have a batch before, or are one, on one side only give no changes.
    compared = both.groupBy(*key).agg(F.bool_or(F.col("new_object").isNotNull()).alias("a"), F.bool_or(F.col("old_object").isNotNull()).alias("b")).filter("a and b").select(*key)
    is_new, is_gone = F.col("old_object").isNull(), F.col("new_object").isNull()
    changed = both.filter(is_new | is_gone | ((F.size("old_kinds") > 0) & (F.size("new_kinds") > 0) & (F.col("old_kinds") != F.col("new_kinds")))).join(compared, key, "left_semi")
    # Paths of a batch with one digest meet: as many as a record has fields, at most. Objects and paths in both batches stay alone.
    alone = (is_new & F.col("new_object")) | (is_gone & F.col("old_object")) | ~(is_new | is_gone)
    shared = [F.coalesce(F.col(f"new_{x}"), F.col(f"old_{x}")).alias(x) for x in digest]
    grouped = changed.groupBy(*key, F.when(alone, F.col("path")).alias("apart"), *shared).agg(F.collect_list(F.when(is_new, F.col("path"))).alias("fresh"), F.collect_list(F.when(is_gone, F.col("path"))).alias("gone"), F.collect_list(F.when(~is_new & ~is_gone, F.col("path"))).alias("kept"))
    change = lambda paths, kind: F.transform(paths, lambda p: F.struct(p.alias("field_path"), F.lit(kind).alias("change_kind"), F.lit("").alias("prior_path")))
    pairs = F.flatten(F.transform("fresh", lambda f: F.transform("gone", lambda g: F.struct(f.alias("field_path"), F.lit("renamed").alias("change_kind"), g.alias("prior_path")))))
    renamed = F.col("apart").isNull() & (F.col("known") >= least_known) & (F.size("fresh") > 0) & (F.size("gone") > 0)
    listed = F.when(renamed, pairs).otherwise(F.concat(change("fresh", "added"), change("gone", "removed"), change("kept", "retyped")))
    return grouped.select(*key, F.explode(listed).alias("c")).select(*key, "c.field_path", "c.change_kind", "c.prior_path")


def value_maps(df: DataFrame, payload: str) -> DataFrame:
    """``df`` without its payload, and ``values``: raw text by path of every field that is no object; null where there is no valid JSON object."""
    df, name = set_aside(df, ["values"])
    payload = name(payload)
    keep = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*keep, T.StructField("values", T.MapType(T.StringType(), T.StringType()))])
    names = [f.name for f in keep]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [json_paths(t, _raw) for t in batch[payload]]
            yield batch[names].assign(values=pd.Series([None if f is None else {p: v for p, k, v in f if k != "object"} for f in found], index=batch.index, dtype=object))

    return df.mapInPandas(read, schema)


def aliases(changes: DataFrame, columns: dict[str, tuple[str, list[str]]]) -> dict[str, tuple[str, list[str]]]:
    """``columns`` (name to type and paths) with all further paths that theirs were renamed to or from, in any number of steps.

    Only the aliases of the wanted columns come to the driver, one step at a
    time. A path that two columns reach stays with the first.
    """
    pairs = cut(changes.filter("change_kind = 'renamed'").select(F.col("prior_path").alias("a"), F.col("field_path").alias("b")).distinct())
    owner = {path: name for name, (_, paths) in columns.items() for path in paths}
    edge = list(owner)
    while edge:
        rows = pairs.filter(F.col("a").isin(edge) | F.col("b").isin(edge)).orderBy("a", "b").collect()
        reached = {}
        for r in rows:
            for x, y in ((r["a"], r["b"]), (r["b"], r["a"])):
                if x in owner and y not in owner:
                    reached.setdefault(y, owner[x])
        owner |= reached
        edge = list(reached)
    return {name: (kind, [*paths, *sorted(p for p, n in owner.items() if n == name and p not in paths)]) for name, (kind, paths) in columns.items()}


def consistent_table(records: DataFrame, columns: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One typed row per record: ``columns`` maps a name to its type and the paths it may stand under, first found first.

    ``failed_casts`` lists the columns whose raw value isn't null but doesn't
    cast; ``unmapped`` holds the remaining paths with their raw texts, and is
    null for records without valid JSON. Records without any of the fields keep
    their row. Repeated rows of a record in a batch count once, at their first
    arrival; rows cut short have no project_id and are no record.
    """
    once = records.filter("project_id is not null").groupBy("feed_id", "batch_no", "project_id").agg(F.min_by("payload", F.struct("received_at", "payload")).alias("payload"))
    wide = value_maps(once, "payload").withColumnRenamed("values", "__m")
    raw = {name: F.coalesce(*[F.try_element_at("__m", F.lit(p)) for p in paths]) for name, (_, paths) in columns.items()}
    typed = {name: raw[name].try_cast(kind) for name, (kind, _) in columns.items()}
    failed = F.filter(F.array(*[F.when(raw[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in columns]), lambda x: x.isNotNull())
    known = [p for _, paths in columns.values() for p in paths]
    return wide.select("feed_id", "batch_no", "project_id", *[typed[n].alias(n) for n in columns], failed.alias("failed_casts"), F.map_filter("__m", lambda k, v: ~k.isin(known)).alias("unmapped"))
