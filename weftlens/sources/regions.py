"""Regions of interest of V2 projects: boundaries, their drawing as JSON text, and whether the two agree.

Boundaries are shares of the image. A drawing is one rectangle in one group on
a layer; what is stored may be its geometry, or its outline as it is rendered,
stroke and shadow included.
"""

from __future__ import annotations

import base64
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How far boundaries and repeated rectangles may differ.
BOUNDARY, SAME = 1e-6, 1e-7
# Transforms of a drawing and the value of each that changes nothing.
IDENTITY = {"scaleX": 1, "scaleY": 1, "rotation": 0, "skewX": 0, "skewY": 0, "offsetX": 0, "offsetY": 0}
FIELDS = ["roi_pos_x", "roi_pos_y", "roi_width", "roi_height", "roi_shape_type", "roi_shape", "roi_bitmap"]
PNG = b"\x89PNG\r\n\x1a\n"


class _Odd(ValueError):
    """A drawing that isn't one plain rectangle."""


def _number(attrs: dict, name: str, default: float | None = None) -> float:
    value = attrs.get(name, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise _Odd(name)
    return float(value)


def _nodes(node: object) -> list[dict]:
    children = node.get("children") if isinstance(node, dict) else None
    if not isinstance(children, list) or not all(isinstance(c, dict) and isinstance(c.get("attrs"), dict) for c in children):
        raise _Odd("children")
    return children


def _outline(attrs: dict, box: list[float]) -> list[float] | None:
    """The box as rendered: half the stroke or the shadow's reach beyond each side, whichever is more; null where neither shows."""
    stroke = _number(attrs, "strokeWidth", 0) / 2 if "stroke" in attrs else 0.0
    blur = _number(attrs, "shadowBlur", 0) if "shadowColor" in attrs else 0.0
    if stroke < 0 or blur < 0:
        return None
    shift = [_number(attrs, f"shadowOffset{axis}", 0) for axis in "XY"]
    reach = [max(stroke, blur + max(sign * shift[i % 2], 0.0)) for i, sign in enumerate((-1, -1, 1, 1))]
    return [edge + (-r if i < 2 else r) for i, (edge, r) in enumerate(zip(box, reach))] if any(reach) else None


def drawn_boundaries(text: str | None) -> list[list[float]] | None:
    """Boundaries (left, top, right, bottom) that a drawing stands for, as geometry and as rendered; null if it isn't one plain rectangle."""
    try:
        layer = json.loads(text.lstrip("﻿"))
        stage = layer["attrs"]["stageSize"]
        size = [_number(stage, "width"), _number(stage, "height")]
        drawn = _nodes(layer)
        areas = [n for n in drawn if n.get("className") == "Group" and n["attrs"].get("name") == "roi-area"]
        if layer.get("className") != "Layer" or min(size) <= 0 or len(areas) != 1 or any(n is not areas[0] and n.get("className") != "Rect" for n in drawn):
            return None
        group = areas[0]["attrs"]
        scale = [_number(group, f"scale{axis}", 1) for axis in "XY"]
        moved = {name: _number(group, name, value) for name, value in IDENTITY.items()}
        if group.get("UIType") != "roi" or min(scale) <= 0 or any(moved[n] for n in ("rotation", "skewX", "skewY", "offsetX", "offsetY")):
            return None
        rectangles = [n["attrs"] for n in _nodes(areas[0]) if n.get("className") == "Rect"]
        if not 1 <= len(rectangles) <= 2 or len(rectangles) != len(areas[0]["children"]) or any(_number(r, n, v) != v for r in rectangles for n, v in IDENTITY.items()):
            return None
        shapes = [[_number(r, n) for n in ("x", "y", "width", "height")] for r in rectangles]
        x, y, w, h = shapes[0]
        if w <= 0 or h <= 0 or any(abs(a - b) > SAME for s in shapes[1:] for a, b in zip(s, shapes[0])):
            return None
        boxes = [[x, y, x + w, y + h]]
        if len(rectangles) == 2 and (rendered := _outline(rectangles[1], boxes[0])):
            boxes.append(rendered)
        origin = [_number(group, "x", 0), _number(group, "y", 0)]
        return [[(origin[i % 2] + edge * scale[i % 2]) / size[i % 2] for i, edge in enumerate(box)] for box in boxes]
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None


def is_png_text(text: str | None) -> bool:
    """Whether a text is a PNG in plain Base64."""
    try:
        return text is not None and base64.b64decode(text, validate=True).startswith(PNG)
    except ValueError:
        return False


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _boundaries(texts: pd.Series) -> pd.Series:
    return texts.astype(object).map(drawn_boundaries, na_action="ignore").astype(object)


@F.pandas_udf(T.BooleanType())
def _is_png(texts: pd.Series) -> pd.Series:
    return texts.astype(object).map(is_png_text, na_action="ignore").astype("boolean")


def v2_regions(rows: DataFrame) -> DataFrame:
    """(project_key, mode, left, top, right, bottom, findings[]) of rows with roi_mode and the columns of ``FIELDS``.

    ``roi_width`` and ``roi_height`` hold the right and the bottom boundary.
    ``findings`` are (code, disposition); a blocked region has no boundaries.
    Null, blank and ``no`` are no region.
    """
    held = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in FIELDS]
    some = held[0]
    for h in held[1:]:
        some = some | h
    mode = F.lower(F.trim("roi_mode"))
    edges = [F.col(c) for c in FIELDS[:4]]
    left, top, right, bottom = edges
    inside = F.coalesce((left >= 0) & (top >= 0) & (right <= 1) & (bottom <= 1) & (right > left) & (bottom > top), F.lit(False))
    # The drawing is read once, by name: as an expression it would be read for each of the rules.
    read = rows.withColumns({"__drawn": _boundaries(F.col("roi_shape")), "__png": _is_png(F.col("roi_bitmap"))})
    agrees = F.exists("__drawn", lambda b: (F.abs(b[0] - left) <= BOUNDARY) & (F.abs(b[1] - top) <= BOUNDARY) & (F.abs(b[2] - right) <= BOUNDARY) & (F.abs(b[3] - bottom) <= BOUNDARY))
    typed, shaped, painted = held[4], held[5], held[6]
    blank, simple = F.coalesce(mode, F.lit("")) == "", mode == "simple"
    usable = simple & inside
    rules: list[tuple[str, Column]] = [
        ("V2_ROI_MODE_MISSING", blank & some), ("V2_ROI_DISABLED_FIELD_CONFLICT", (mode == "no") & some), ("V2_ROI_MODE_UNSUPPORTED", ~blank & ~mode.isin("no", "simple")), ("V2_ROI_BOUNDS_INVALID", simple & ~inside),
        ("V2_ROI_SHAPE_TYPE_UNSUPPORTED", usable & typed & (F.lower(F.trim("roi_shape_type")) != "rectangle")), ("V2_ROI_SHAPE_MISSING", usable & ~typed & ~shaped), ("V2_ROI_SHAPE_INVALID", usable & shaped & F.col("__drawn").isNull()),
        ("V2_ROI_SHAPE_CONFLICT", usable & shaped & ~agrees), ("V2_ROI_BITMAP_INVALID", usable & painted & ~F.coalesce("__png", F.lit(False))),
    ]
    note = lambda code, disposition: F.struct(F.lit(code).alias("code"), F.lit(disposition).alias("disposition"))
    listed = lambda pairs: F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), note(code, kind)) for code, kind, test in pairs]), lambda f: f.isNotNull())
    judged = read.withColumn("__bad", listed([(code, "block", test) for code, test in rules]))
    good = (F.size("__bad") == 0) & simple
    whole = (left == 0) & (top == 0) & (right == 1) & (bottom == 1)
    kept = listed([("V2_DEFAULT_FULL_IMAGE_ROI", "preserve", good & whole), ("V2_SIMPLE_RECTANGLE_ROI", "preserve", good & ~whole), ("V2_ROI_SHAPE_REBUILT", "rebuild", good & shaped), ("V2_ROI_BITMAP_REBUILT", "rebuild", good & painted)])
    named = F.when(good, "simple").when((mode == "no") & (F.size("__bad") == 0), "none")
    return judged.select("project_key", named.alias("mode"), *[F.when(good, e).alias(n) for e, n in zip(edges, ("left", "top", "right", "bottom"))], F.concat("__bad", kept).alias("findings"))
