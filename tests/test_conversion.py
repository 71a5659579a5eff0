"""V2 projects built from canonical tables: literal values of a small fixture, and findings."""

import json

import pytest

from weftlens.functions.codes import FNV_OFFSET, FNV_PRIME
from weftlens.sinks.projects import write_v1
from weftlens.sinks.v2_build import build_v2, write_findings

PROJECTS = "project_key long, project_name string, project_type string, modified_ms long, roi_mode string, roi_left double, roi_top double, roi_right double, roi_bottom double"
CLASSES = "project_key long, class_index int, class_name string, class_color string, is_ng boolean"
FILES = "project_key long, file_index int, source_path string, file_name string, width long, height long, split string, is_normal boolean, is_labeled boolean, class_index int"
LABELS = "project_key long, file_index int, label_index int, class_index int, rings array<array<array<double>>>, roles array<string>"
SQUARE, HOLE = [[2.0, 2.0], [12.0, 2.0], [12.0, 12.0], [2.0, 12.0]], [[4.0, 4.0], [10.0, 4.0], [10.0, 10.0], [4.0, 10.0]]


def tables(spark, projects, classes, files, labels):
    return [spark.createDataFrame(rows, schema) for rows, schema in ((projects, PROJECTS), (classes, CLASSES), (files, FILES), (labels, LABELS))]


def fnv(text):
    h = FNV_OFFSET
    for ch in text:
        h = ((h ^ ord(ch)) * FNV_PRIME) & 0xFFFFFFFF
    return h


@pytest.fixture(scope="module")
def built(spark):
    rows = tables(
        spark,
        [(1, "seg one", "segmentation", 5000, "simple", 0.1, 0.2, 0.8, 0.85), (2, "", "classification", None, "none", None, None, None, None), (3, "blocked", "segmentation", 0, "none", None, None, None, None)],
        [(1, 1, "Chip", None, None), (1, 0, "Burr", "#102030", None), (2, 0, "A", None, None), (2, 1, 'B "q"', "#80ffffff", True), (3, 0, "ok ", None, None)],
        [(1, 1, "/b/y.png", None, 20, 20, "unassigned", True, None, None), (1, 0, '"C:\\a\\x.png"', None, 20, 20, "training", False, None, None), (2, 0, "//nas/q/z.png", None, 10, 10, "validation", None, None, 1), (3, 0, "C:/a", None, 1, 1, "training", True, None, None)],
        [(1, 0, 0, 1, [SQUARE, HOLE], ["outer", "inner"])],
    )
    return {r["project_key"]: r for r in build_v2(*rows).collect()}


def test_segmentation(built):
    project = json.loads(built[1]["json"])["project"]
    identity = '{"name":"seg one","classes":[[0,"Burr"],[1,"Chip"]],"files":[[0,"C:/a/x.png","x.png"],[1,"/b/y.png","y.png"]]}'
    pid = 100_000 + fnv(identity) % 700_000
    assert project["projectId"] == pid and project["projectType"] == "seg" and project["modifiedDate"] == project["createdDate"] == 5000
    assert [(c["classId"], c["className"], c["classNo"], c["classColor"], c["isNg"]) for c in project["classInfos"]] == [(0, "OK", 0, "#1DDB16", False), (pid + 10, "Burr", 1, "#102030", True), (pid + 11, "Chip", 2, "#2F80ED", True)]
    first, second = project["projectFiles"]
    assert first["filePath"] == "C:\\a\\x.png" and first["fileId"] == pid + 1000 and first["isLabeled"] and first["className"] == "Chip" and first["metadata"] == [{}, {}, {}]
    assert second["isLabeled"] and second["className"] == "OK" and second["labelDataList"] == [] and second["splitSets"] == [{"splitId": pid + 2, "splitName": "srproj", "splitType": "not-split"}]
    (label,) = first["labelDataList"]
    assert (label["labelId"], label["labelPosX"], label["labelPosY"], label["labelWidth"], label["labelHeight"], label["contourSize"]) == (pid + 100_000, 2, 2, 10, 10, 64.0)
    assert json.loads(label["labelContour"]) == [SQUARE, HOLE[::-1]]  # the hole runs the other way
    assert (project["roiPosX"], project["roiPosY"], project["roiWidth"], project["roiHeight"]) == (0.1, 0.2, 0.8, 0.85)
    shape = json.loads(project["roiShape"])
    mask, outline = shape["children"][1]["children"]
    assert shape["attrs"]["stageSize"] == {"width": 20, "height": 20} and shape["children"][1]["attrs"]["name"] == "roi-area" and mask["attrs"]["x"] == 2.0 and outline["attrs"]["height"] == pytest.approx(13.0)


def test_classification(built):
    project = json.loads(built[2]["json"])["project"]
    (file,) = project["projectFiles"]
    assert project["projectType"] == "cls" and project["roiMode"] == "simple" and project["roiWidth"] == 1 and "roiShape" not in project and project["modifiedDate"] == 0
    assert file["className"] == 'B "q"' and len(file["labelDataList"]) == 1 and file["metadata"] == [] and file["datasetName"] == "dataset"
    assert [c["isNg"] for c in project["classInfos"]] == [False, True] and project["classInfos"][1]["classColor"] == "#FFFFFF"


def test_blocked_projects_have_no_text(built):
    assert built[3]["json"] is None and built[3]["n_findings"] == 1


FINDINGS = [
    ("V2_WRITE_SEGMENTATION_RING_ORDER_INVALID", [SQUARE, HOLE], ["inner", "outer"]), ("V2_WRITE_SEGMENTATION_OUTER_RING_REQUIRED", [SQUARE], ["inner"]), ("V2_WRITE_SEGMENTATION_RING_ROLE_REQUIRED", [SQUARE], ["unknown"]), ("V2_WRITE_SEGMENTATION_RING_ROLE_REQUIRED", [SQUARE], None),
    ("V2_WRITE_SEGMENTATION_CONTOUR_REQUIRED", [], []), ("V2_WRITE_SEGMENTATION_CONTOUR_INVALID", [SQUARE[:2]], ["outer"]), ("V2_WRITE_SEGMENTATION_POINT_INVALID", [[[2.0, 2.0], [21.0, 2.0], [5.0, 5.0]]], ["outer"]),
    ("V2_WRITE_SEGMENTATION_CONTOUR_AREA_INVALID", [[[2.0, 2.0], [4.0, 4.0], [6.0, 6.0]]], ["outer"]), ("V2_WRITE_SEGMENTATION_GEOMETRY_INVALID", [[[2.0, 2.0], [2.4, 2.0], [2.4, 9.0]]], ["outer"]), (None, [SQUARE, HOLE], ["outer", "inner"]),
]


def test_findings(spark):
    labels = [(1, 0, i, 0, rings, roles) for i, (_, rings, roles) in enumerate(FINDINGS)] + [(1, 0, 90, 7, [SQUARE], ["outer"]), (1, 1, 0, 0, [SQUARE], ["outer"])]
    files = [(1, 0, "C:/x", None, 20, 20, "training", False, True, None), (1, 1, "rel/x", None, None, 20, "unknown", True, False, None), (1, 2, "C:/../x", None, 5, 5, "training", False, True, None), (1, 5, "C:/a\x07", None, 5, 5, "training", None, None, None)]
    rows = tables(spark, [(1, "p", "segmentation", 0, "simple", 0.5, 0.0, 0.4, 1.0), (2, "p", "detection", 0, "other", None, None, None, None)], [(1, 0, "A", None, None), (1, 0, " a", None, None)], files, labels)
    found = {(r["project_key"], r["code"], r["path"]) for r in write_findings(*rows).collect()}
    expected = {(1, code, f"$.files[0].labels[{i}]") for i, (code, _, _) in enumerate(FINDINGS) if code}
    expected |= {(1, "V2_WRITE_CLASS_REFERENCE_INVALID", "$.files[0].labels[90]"), (1, "V2_WRITE_ROI_BOUNDS_INVALID", "$.project"), (2, "V2_WRITE_PROJECT_TYPE_UNSUPPORTED", "$.project"), (2, "V2_WRITE_ROI_MODE_UNSUPPORTED", "$.project")}
    expected |= {(1, c, "$.classes") for c in ("V2_WRITE_CLASS_INDEX_INVALID", "V2_WRITE_CLASS_NAME_DUPLICATE")} | {(1, "V2_WRITE_FILE_INDEX_INVALID", "$.files")}
    expected |= {(1, f"V2_WRITE_{c}", "$.files[1]") for c in ("IMAGE_DIMENSIONS_REQUIRED", "SPLIT_UNSUPPORTED", "SEGMENTATION_NORMAL_LABEL_CONFLICT", "SEGMENTATION_STATE_CONFLICT", "EXTERNAL_PATH_RELATIVE")}
    expected |= {(1, f"V2_WRITE_{c}", "$.files[2]") for c in ("SEGMENTATION_LABEL_REQUIRED", "EXTERNAL_PATH_TRAVERSAL")} | {(1, "V2_WRITE_EXTERNAL_PATH_CONTROL_CHARACTER", "$.files[5]")}
    assert found == expected


def test_of_nothing(spark):
    rows = tables(spark, [], [], [], [])
    assert write_findings(*rows).count() == 0 and build_v2(*rows).count() == 0


def test_v1_writer_refuses(spark):
    head = lambda k, kind="segmentation", mode="none", box=(None,) * 4: (k, "p", kind, 0, mode, *box)
    projects = [head(1), head(2, "detection"), head(3, mode="other"), head(4, mode="simple", box=(0.5, 0.0, 0.4, 1.0)), head(5), head(6, mode="simple", box=(0.0, 0.0, 0.5, 1.0))]
    files = [(k, 0, "C:/x", None, 20, 20, "training", k == 5, None, None) for k in range(1, 7)]
    rows = {r["project_key"]: r for r in write_v1(*tables(spark, projects, [(k, 0, "A", None, None) for k in range(1, 7)], files, [(k, 0, 0, 0, [SQUARE], ["outer"]) for k in (1, 5)])).collect()}
    assert {k: r["code"] for k, r in rows.items()} == {1: None, 2: "SRPROJ_PROJECT_TYPE_UNSUPPORTED", 3: "SRPROJ_ROI_UNSUPPORTED", 4: "SRPROJ_ROI_BOUNDS_INVALID", 5: "SRPROJ_SEGMENTATION_NORMAL_LABEL_CONFLICT", 6: None}
    assert all((r["xml"] is None) == (r["code"] is not None) for r in rows.values()) and '<Offset Left="100" Right="100" Top="100" Bottom="100" />' in rows[6]["xml"] and "<Type>Not set</Type>" in rows[1]["xml"]
