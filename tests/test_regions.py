"""Regions of V2 projects and their drawings."""

import base64
import json

import pytest

from weftlens.sources.regions import PNG, drawn_boundaries, is_png_text, v2_regions

SCHEMA = "project_key long, roi_mode string, roi_pos_x double, roi_pos_y double, roi_width double, roi_height double, roi_shape_type string, roi_shape string, roi_bitmap string"


def drawing(group=None, first=None, second=None, stage=(200, 100), extra=()):
    box = {"x": 20, "y": 20, "width": 140, "height": 65}
    rectangles = [{"className": "Rect", "attrs": {**box, **(first or {})}}] + ([{"className": "Rect", "attrs": {**box, **second}}] if second is not None else [])
    area = {"className": "Group", "attrs": {"name": "roi-area", "UIType": "roi", **(group or {})}, "children": rectangles}
    return json.dumps({"className": "Layer", "attrs": {"stageSize": {"width": stage[0], "height": stage[1]}}, "children": [{"className": "Rect", "attrs": {}}, area, *extra]})


def test_drawings():
    box = [0.1, 0.2, 0.8, 0.85]
    assert drawn_boundaries(drawing()) == [pytest.approx(box)]
    assert drawn_boundaries(drawing({"x": -20, "y": 0, "scaleX": 2, "scaleY": 1})) == [pytest.approx([0.1, 0.2, 1.5, 0.85])]
    geometry, rendered = drawn_boundaries(drawing(second={"stroke": "white", "strokeWidth": 1, "shadowColor": "black", "shadowBlur": 1, "shadowOffsetX": 0.5, "shadowOffsetY": 0.5}))
    assert geometry == pytest.approx(box) and rendered == pytest.approx([19 / 200, 19 / 100, 161.5 / 200, 86.5 / 100])
    odd = [drawing({"rotation": 5}), drawing({"scaleX": -1}), drawing({"UIType": "x"}), drawing({"x": "1"}), drawing(first={"scaleX": 2}), drawing(first={"width": 0}), drawing(second={"x": 21}), drawing(stage=(0, 5)), drawing(extra=[{"className": "Circle", "attrs": {}}]), drawing(extra=[json.loads(drawing())["children"][1]]), "{", "[]", "5", "null", None, "[" * 100_000]
    assert [drawn_boundaries(d) for d in odd] == [None] * len(odd)
    assert is_png_text(base64.b64encode(PNG + b"x").decode()) and not any(map(is_png_text, ["data:image/png;base64,iVBORw0KGgo=", "iVBO", "", None]))


CASES = [
    (("simple", 0.1, 0.2, 0.8, 0.85, "rectangle", drawing(), None), "simple", "V2_SIMPLE_RECTANGLE_ROI,V2_ROI_SHAPE_REBUILT"), (("simple", 0.0, 0.0, 1.0, 1.0, "Rectangle", None, None), "simple", "V2_DEFAULT_FULL_IMAGE_ROI"),
    (("no", None, None, None, None, None, None, None), "none", ""), ((None, None, None, None, None, "", None, None), None, ""), (("", 0.1, None, None, None, None, None, None), None, "V2_ROI_MODE_MISSING"), (("no", None, None, None, None, "rectangle", None, None), None, "V2_ROI_DISABLED_FIELD_CONFLICT"),
    (("polygon", None, None, None, None, None, None, None), None, "V2_ROI_MODE_UNSUPPORTED"), (("simple", 0.1, 0.2, 0.05, 0.85, "rectangle", None, None), None, "V2_ROI_BOUNDS_INVALID"), (("simple", None, 0.2, 0.5, 0.85, "rectangle", None, None), None, "V2_ROI_BOUNDS_INVALID"),
    (("simple", 0.1, 0.2, 0.8, 0.85, "circle", None, None), None, "V2_ROI_SHAPE_TYPE_UNSUPPORTED"), (("simple", 0.1, 0.2, 0.8, 0.85, None, None, None), None, "V2_ROI_SHAPE_MISSING"), (("simple", 0.1, 0.2, 0.8, 0.85, None, "{", None), None, "V2_ROI_SHAPE_INVALID"),
    (("simple", 0.1, 0.2, 0.8, 0.9, None, drawing(), None), None, "V2_ROI_SHAPE_CONFLICT"), (("simple", 0.1, 0.2, 0.8, 0.85, "rectangle", None, "xyz"), None, "V2_ROI_BITMAP_INVALID"), (("simple", 0.1, 0.2, 0.8, 0.85, "rectangle", None, base64.b64encode(PNG).decode()), "simple", "V2_SIMPLE_RECTANGLE_ROI,V2_ROI_BITMAP_REBUILT"),
]


def test_regions(spark):
    df = spark.createDataFrame([(i, *row) for i, (row, _, _) in enumerate(CASES)], SCHEMA)
    rows = {r["project_key"]: r for r in v2_regions(df).collect()}
    assert {i: (r["mode"], ",".join(f["code"] for f in r["findings"])) for i, r in rows.items()} == {i: (mode, codes) for i, (_, mode, codes) in enumerate(CASES)}
    assert rows[0]["right"] == 0.8 and rows[12]["right"] is None and v2_regions(df.limit(0)).count() == 0
