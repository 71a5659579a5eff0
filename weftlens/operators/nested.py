"""Nested records to related flat tables by Dewey labels (problem 4).

A node's label is the path of ordinals from the root (``7.0.3.1``): the label
of its parent is the same text without the last ordinal, so no join is needed
to link child to parent, and nodes with null ids are linked all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dewey_parent(label: Column) -> Column:
    """Label of the parent: the last ordinal cut off; null for a root."""
    return F.when(label.contains("."), F.regexp_replace(label, r"\.[^.]*$", ""))


def _arrays_of_structs(struct: T.StructType) -> list[tuple[str, T.StructType]]:
    return [(f.name, f.dataType.elementType) for f in struct.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]


def flatten_tables(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """One flat table for each schema path of arrays of objects: ``{'': roots, 'a': ..., 'a.b': ...}``.

    Each has ``node`` (Dewey label), ``parent``, ``ordinal`` and the object's
    own fields; arrays of plain values stay as they are. Null and empty arrays
    have no rows. A null element is a node whose fields are null. Fields whose
    names clash with the link columns get a trailing underscore. ``key`` must
    tell roots apart.
    """
    root = df.withColumns({"__node": F.col(key).cast("string"), "__row": F.struct(*[F.col(f"`{c}`") for c in df.columns])})
    tables: dict[str, DataFrame] = {}

    def clean(name: str) -> str:
        return name + "_" if name in ("node", "parent", "ordinal") else name

    def visit(level: DataFrame, path: str, struct: T.StructType) -> None:
        nested = _arrays_of_structs(struct)
        skip = {n for n, _ in nested}
        own = [F.col(f"__row.`{f.name}`").alias(clean(f.name)) for f in struct.fields if f.name not in skip]
        ordinal = F.regexp_extract("__node", r"([0-9]+)$", 1).cast("int") if path else F.lit(None).cast("int")
        tables[path] = level.select(F.col("__node").alias("node"), dewey_parent(F.col("__node")).alias("parent") if path else F.lit(None).cast("string").alias("parent"), ordinal.alias("ordinal"), *own)
        for name, element in nested:
            below = level.select("__node", F.posexplode(F.col(f"__row.`{name}`")).alias("__pos", "__row"))
            visit(below.select(F.concat_ws(".", "__node", F.col("__pos").cast("string")).alias("__node"), "__row"), f"{path}.{name}" if path else name, element)

    visit(root.select("__node", "__row"), "", df.schema)
    return tables


def read_rings(contour: Column) -> Column:
    """Rings of a contour text as array of arrays of points; null where it can't be read.

    Takes a list of rings, one ring alone, or either as JSON text inside a
    JSON string. A text cut short is unreadable as a whole.
    """
    def unwrap(c: Column) -> Column:
        return F.when(F.ltrim(c).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0))).otherwise(c)

    text = F.trim(unwrap(unwrap(contour)))
    text = F.when(text.startswith("[") & text.endswith("]"), text)
    # The third mark decides, wherever it stands: a list of rings begins with a ring's first point, or with an empty ring.
    many = F.when(text.rlike(r"^\[\s*\[\s*[\[\]]"), F.from_json(text, "array<array<array<double>>>"))
    one = F.when(text.rlike(r"^\[\s*\[\s*[^\[\]\s]"), F.from_json(text, "array<array<double>>"))
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def _readable(ring: Column) -> Column:
    return ring.isNotNull() & (F.size(ring) > 0) & ~F.exists(ring, lambda p: p.isNull() | (F.size(p) < 2) | F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull())


def child_label(parent: Column, position: Column) -> Column:
    """Label of the child at a position; the parent's own where there is no child."""
    return F.when(position.isNull(), parent).otherwise(F.concat(parent, F.lit("."), position.cast("string")))


def ordinal_at(label: Column, depth: int) -> Column:
    """Ordinal of a label's ancestor at a depth below the root, -1 where the label ends above it."""
    return F.coalesce(F.get(F.split(label, r"\."), F.lit(depth)).cast("int"), F.lit(-1))


def flatten_inbox(inbox: DataFrame) -> DataFrame:
    """Rows down to the single ring of V2 projects, with Dewey labels, parents and the class link.

    One row per readable ring; a label without one has ``ring_pos`` -1, a file
    without labels ``label_pos`` -1 and so on: a node without children keeps
    its own label, and the positions are the ordinals of the label. ``class_id``
    is that of the project's class that the label names by class_id, else
    class_no, else class_name; -1 if there is none. It is resolved inside the
    project's row, so the classes don't travel to every label. Null projects,
    null arrays, null elements and broken contours give the -1 rows.
    Redelivered projects must have been settled before.
    """
    def first_class(test) -> Column:
        return F.try_element_at(F.filter("class_infos", test), F.lit(1))["class_id"]

    def linked(label: Column) -> Column:
        named = (
            F.when(label["class_id"].isNotNull(), first_class(lambda c: c["class_id"] == label["class_id"]))
            .when(label["class_no"].isNotNull(), first_class(lambda c: c["class_no"] == label["class_no"]))
            .when(label["class_name"].isNotNull(), first_class(lambda c: c["class_name"] == label["class_name"]))
        )
        return F.struct(F.coalesce(named, F.lit(-1)).cast("long").alias("class_id"), label["label_contour"].alias("contour"))

    # The root's label is its key; a minus sign is part of it.
    roots = inbox.select("project_key", F.col("project_key").cast("string").alias("node"), F.transform("project_files", lambda f: F.transform(f["label_data_list"], linked)).alias("files"))
    files = roots.select("project_key", "node", F.posexplode_outer("files").alias("at", "labels")).select("project_key", child_label(F.col("node"), F.col("at")).alias("node"), "labels")
    labels = files.select("project_key", "node", F.posexplode_outer("labels").alias("at", "label")).select("project_key", child_label(F.col("node"), F.col("at")).alias("node"), F.coalesce("label.class_id", F.lit(-1)).cast("long").alias("class_id"), read_rings(F.col("label.contour")).alias("rings"))
    numbered = F.filter(F.transform("rings", lambda r, i: F.struct(i.alias("at"), r.alias("ring"))), lambda x: _readable(x["ring"]))
    rings = labels.select("project_key", "node", "class_id", F.explode_outer(numbered).alias("r")).select("project_key", child_label(F.col("node"), F.col("r.at")).alias("node"), "class_id", F.col("r.ring").alias("points"))
    return rings.select(
        "project_key", ordinal_at(F.col("node"), 1).alias("file_pos"), ordinal_at(F.col("node"), 2).alias("label_pos"), ordinal_at(F.col("node"), 3).alias("ring_pos"),
        F.when(F.col("points").isNotNull(), F.size("points")).otherwise(0).alias("n_points"), "class_id", "node", dewey_parent(F.col("node")).alias("parent"), "points",
    )
