"""Structure and regions of V1 texts, on small documents."""

import pytest

from weftlens.sources.xml_nodes import region_findings, regions, structure_findings, xml_nodes

DEFAULTS = '<RoiSetting><Intensity Min="0" Max="255"/><Expansion Value="0"/><Inversion Value="False"/><Offset Left="100" Right="100" Top="100" Bottom="100"/></RoiSetting><BlindGroup><NumberOfBlinds>0</NumberOfBlinds></BlindGroup>'
RECTANGLE = '<RoiRectangle X="0.1" Y="0.2" Width="0.7" Height="0.65" Shape="Rectangle"/>'


def mask(kind="Simple", rectangle=RECTANGLE, rest=DEFAULTS):
    return f"<Project><MaskingParameter><Type>{kind}</Type>{rectangle}{rest}</MaskingParameter></Project>"


def nodes(spark, texts):
    return xml_nodes(spark.createDataFrame(list(enumerate(texts)), "project_key long, text string"))


def test_nodes(spark):
    rows = nodes(spark, ['<a x="1">t<b/><b>u<![CDATA[<v>]]></b></a>']).collect()
    assert [(r["place"], r["attributes"], r["text"], r["n_children"]) for r in rows] == [("$.a", {"x": "1"}, "t", 2), ("$.a.b[0]", {}, "", 0), ("$.a.b[1]", {}, "u<v>", 0)]


STRUCTURE = [
    ("<Project><Version>0.9</Version></Project>", set()), ("<Project>", {("V1_INVALID_XML", "$")}), (None, {("V1_INVALID_XML", "$")}), ("<!DOCTYPE a><Project/>", {("V1_XML_DECLARATION_FORBIDDEN", "$")}),
    ("<Project><TrainingParameter><deep/></TrainingParameter><Odd/><Odd/></Project>", {("V1_UNMAPPED_XML_NODE", "$.Project.TrainingParameter[0]"), ("V1_UNKNOWN_XML_NODE", "$.Project.Odd[0]"), ("V1_UNKNOWN_XML_NODE", "$.Project.Odd[1]")}),
    ('<Project><ClassGroup a="1"><Class><Name>x</Name><Odd/></Class></ClassGroup></Project>', {("V1_UNKNOWN_XML_ATTRIBUTE", "$.Project.ClassGroup[0].@a"), ("V1_UNKNOWN_XML_NODE", "$.Project.ClassGroup[0].Class[0].Odd[0]")}),
    ("<Project><Version><b/></Version><Version>1</Version></Project>", {("V1_LEAF_HAS_CHILDREN", "$.Project.Version[0]"), ("V1_UNKNOWN_XML_NODE", "$.Project.Version[0].b[0]"), ("V1_DUPLICATE_ELEMENT", "$.Project.Version[1]")}),
    ('<Project><ImageGroup><Image><LabelGroup><Label><ContourGroup><Contour Type="Outer" z="1"><Point X="1" Y="2" Z="3"/></Contour></ContourGroup></Label></LabelGroup></Image><Image/></ImageGroup></Project>', {("V1_UNKNOWN_XML_ATTRIBUTE", "$.Project.ImageGroup[0].Image[0].LabelGroup[0].Label[0].ContourGroup[0].Contour[0].@z"), ("V1_UNKNOWN_XML_ATTRIBUTE", "$.Project.ImageGroup[0].Image[0].LabelGroup[0].Label[0].ContourGroup[0].Contour[0].Point[0].@Z")}),
    ("<" + "a>" * 1 + "<b>" * 150 + "</b>" * 150 + "</a>", {("V1_XML_DEPTH_LIMIT_EXCEEDED", "$")}),
]


def test_structure(spark):
    found = {}
    for r in structure_findings(nodes(spark, [t for t, _ in STRUCTURE])).collect():
        found.setdefault(r["project_key"], set()).add((r["code"], r["path"]))
    assert {i: found.get(i, set()) for i in range(len(STRUCTURE))} == {i: expected for i, (_, expected) in enumerate(STRUCTURE)}


REGIONS = [
    (mask(), "simple", {"V1_SIMPLE_RECTANGLE_ROI_MAPPED"}), (mask("Not set", "", ""), "none", {"V1_MASKING_NOT_SET"}), (mask("not SET", '<RoiRectangle X="0" Y="0" Width="1" Height="1" Shape="rectangle"/>'), "none", {"V1_MASKING_NOT_SET"}),
    (mask("Not set"), "none", {"V1_ROI_SETTING_UNSUPPORTED"}), (mask("Polygon"), "other", {"V1_ROI_TYPE_UNSUPPORTED"}), (mask(""), None, {"V1_REQUIRED_VALUE_EMPTY"}), ("<Project><MaskingParameter/></Project>", None, {"V1_REQUIRED_ELEMENT_MISSING"}),
    (mask(rectangle=""), "simple", {"V1_REQUIRED_ELEMENT_MISSING"}), (mask(rectangle=RECTANGLE.replace("0.7", "0.95")), "simple", {"V1_ROI_BOUNDS_INVALID"}), (mask(rectangle=RECTANGLE.replace("0.7", "wide")), "simple", {"V1_ROI_NUMBER_INVALID"}),
    (mask(rectangle=RECTANGLE.replace(' X="0.1"', "")), "simple", {"V1_ROI_ATTRIBUTE_MISSING"}), (mask(rectangle=RECTANGLE.replace("Rectangle\"", 'Circle"').replace("<RoiCircle", "<RoiRectangle")), "simple", {"V1_ROI_SHAPE_UNSUPPORTED"}), (mask(rest=DEFAULTS.replace('"255"', '"254"')), "simple", {"V1_ROI_SETTING_UNSUPPORTED"}),
    (mask(rest=DEFAULTS.replace('"False"', '"true"')), "simple", {"V1_ROI_SETTING_UNSUPPORTED"}), (mask(rest=DEFAULTS.replace('"False"', '"maybe"')), "simple", {"V1_ROI_SETTING_INVALID"}), (mask(rest=DEFAULTS.replace(">0<", ">2<")), "simple", {"V1_ROI_BLINDS_UNSUPPORTED"}), (mask(rest=DEFAULTS.replace(">0<", ">x<")), "simple", {"V1_ROI_BLIND_COUNT_INVALID"}),
    (mask(rest=DEFAULTS + "<Odd/>"), "simple", {"V1_ROI_STRUCTURE_UNSUPPORTED"}), (mask(rest=DEFAULTS.replace("<RoiSetting>", '<RoiSetting a="1">')), "simple", {"V1_ROI_STRUCTURE_UNSUPPORTED"}), (mask(rest=DEFAULTS.replace("<RoiSetting>", "<RoiSetting>text")), "simple", {"V1_ROI_ELEMENT_TEXT_INVALID"}),
    ("<Project/>", "no row", set()),
]


def test_regions(spark):
    table = nodes(spark, [t for t, _, _ in REGIONS])
    rows = {r["project_key"]: r for r in regions(table).collect()}
    for i, (text, mode, expected) in enumerate(REGIONS):
        assert (mode == "no row") == (i not in rows), text
        if i in rows:
            assert rows[i]["roi_mode"] == mode and {f["code"] for f in rows[i]["findings"]} == expected, (text, rows[i])
    assert [rows[0][f"roi_{s}"] for s in ("left", "top", "right", "bottom")] == pytest.approx([0.1, 0.2, 0.8, 0.85]) and rows[8]["roi_left"] is None
    assert ("$.Project.MaskingParameter[0].Odd[0]", "block") in {(r["path"], r["disposition"]) for r in region_findings(table).collect()}
    assert structure_findings(table.limit(0)).count() == 0 and regions(table.limit(0)).count() == 0
