"""Findings about V2 projects on literal rows."""

import pytest
from pyspark.sql import functions as F

from weftlens.operators.validation import file_findings, file_states, findings, label_findings, project_findings, target_readiness

INBOX = """project_key long, project_name string, project_type string, class_infos array<struct<class_id:long,class_name:string,class_no:long,description:string,class_color:string,is_ng:boolean>>,
 datasets array<struct<dataset_id:long,dataset_name:string,created_date:long,split_sets:array<struct<split_id:long,split_name:string,created_date:long>>>>,
 project_files array<struct<file_id:long,file_name:string,file_path:string,is_labeled:boolean,class_id:long,dataset_id:long,width:long,height:long,
  label_data_list:array<struct<label_id:long,label_type:string,labeled_date:long,class_id:long,class_no:long,class_name:string,label_pos_x:double,label_pos_y:double,label_width:double,label_height:double,label_contour:string,contour_size:double>>,
  metadata:array<string>,registered_date:long,split_sets:array<struct<split_id:long,split_name:string,split_type:string>>>>"""
OK, BURR, CHIP = (20, "OK", 0, None, None, False), (21, "Burr", 1, None, None, True), (22, "Chip", 2, None, None, True)
BORDER, RING = "[[[0,0],[20,0],[20,10],[0,10]]]", "[[2,2],[12,2],[12,9]]"


def label(class_id=None, class_no=None, class_name=None, kind="man", box=(None,) * 4, contour=None, size=None):
    return (None, kind, None, class_id, class_no, class_name, *box, contour, size)


def file(labels, labeled=True, class_id=None, splits=("train",), width=20, height=10):
    return (None, "x", "x", labeled, class_id, None, width, height, labels, None, None, None if splits is None else [(None, None, s) for s in splits])


def inbox(spark, kind, files, classes=(OK, BURR, CHIP), key=1):
    return spark.createDataFrame([(key, "p", kind, list(classes) if classes is not None else None, None, files)], INBOX)


CASES = [
    ("segmentation", label(21, contour=RING), set()),
    ("segmentation", label(99, contour=RING), {"V2_CLASS_ID_REFERENCE_INVALID"}),
    ("segmentation", label(21, 2, contour=RING), {"V2_CLASS_REFERENCE_CONFLICT"}),
    ("segmentation", label(None, 7, " burr ", contour=RING), {"V2_CLASS_NUMBER_REFERENCE_INVALID"}),
    ("segmentation", label(None, None, "nope", contour=RING), {"V2_CLASS_NAME_REFERENCE_INVALID"}),
    ("segmentation", label(contour=RING), {"V2_CLASS_REFERENCE_INVALID"}),
    ("segmentation", label(21, kind="auto", contour=RING), {"V2_LABEL_ORIGIN_NOT_IN_V1"}),
    ("segmentation", label(21, kind=None), {"V2_LABEL_ORIGIN_NOT_IN_V1", "V2_LABEL_GEOMETRY_UNSUPPORTED"}),
    ("segmentation", label(21, contour="[[2,2],[25,2],[12,9]]"), {"V2_CONTOUR_OUT_OF_BOUNDS"}),
    ("classification", label(21), set()),
    ("classification", label(21, box=(0.0, 0.0, 20.0, 10.0)), {"V2_CLASSIFICATION_FULL_IMAGE_GEOMETRY"}),
    ("classification", label(21, box=(0.0, 0.0, 20.0, 9.0)), {"V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1"}),
    ("classification", label(21, box=(1.0, 0.0, 20.0, 10.0)), {"V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1", "V2_LABEL_OUT_OF_BOUNDS"}),
    ("classification", label(21, box=(0.0, None, 20.0, 10.0)), {"V2_CLASSIFICATION_GEOMETRY_INVALID"}),
    ("classification", label(21, contour=BORDER), {"V2_CLASSIFICATION_FULL_IMAGE_GEOMETRY"}),
    ("classification", label(21, contour=RING), {"V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1"}),
    ("classification", label(21, contour=f"[{RING},{RING}]"), {"V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1"}),
]


def test_labels(spark):
    rows = [(i, "p", kind, [OK, BURR, CHIP], None, [file([made])]) for i, (kind, made, _) in enumerate(CASES)]
    found = {}
    for r in label_findings(spark.createDataFrame(rows, INBOX)).collect():
        found.setdefault(r["project_key"], set()).add(r["code"])
        assert r["path"] == "$.project.projectFiles[0].labelDataList[0]"
    assert {i: found.get(i, set()) for i in range(len(CASES))} == {i: codes for i, (_, _, codes) in enumerate(CASES)}


STATES = [
    (file([label(21, contour=RING)]), "defect", set()), (file([label(20)]), "normal", set()), (file([], class_id=20), "normal", set()), (file([], labeled=False), "unlabeled", set()), (file(None, labeled=None), "unknown", {"V2_SEGMENTATION_EMPTY_LABEL_STATE_AMBIGUOUS"}),
    (file([]), "unknown", {"V2_SEGMENTATION_EMPTY_LABEL_STATE_AMBIGUOUS"}), (file([], labeled=False, class_id=21), "unlabeled", {"V2_SEGMENTATION_UNLABELED_CLASS_CONFLICT"}), (file([label(21, contour=RING)], labeled=False), "defect", {"V2_SEGMENTATION_LABEL_STATE_CONFLICT"}),
    (file([label(20, contour=RING)]), "defect", {"V2_SEGMENTATION_NORMAL_CLASS_CONTOUR_CONFLICT"}), (file([label(20)], class_id=21), "defect", {"V2_SEGMENTATION_NORMAL_CLASS_CONTOUR_CONFLICT"}),
    (file([], labeled=False, splits=None), "unlabeled", {"V2_SPLIT_MISSING"}), (file([], labeled=False, splits=("train", "val")), "unlabeled", {"V2_SPLIT_CONFLICT"}), (file([], labeled=False, splits=("train", "Training")), "unlabeled", {"V2_MULTIPLE_SPLIT_MEMBERSHIPS"}),
]
CLASSIFIED = [
    (file([], class_id=21), "classified", set()), (file([]), "unknown", {"V2_CLASSIFICATION_CLASS_MISSING"}), (file([label(21)], class_id=22), "unknown", {"V2_CLASSIFICATION_CLASS_CONFLICT"}), (file([label(21), label(21)]), "classified", {"V2_CLASSIFICATION_MULTIPLE_LABELS"}),
    (file([label(21)], labeled=False), "classified", {"V2_CLASSIFICATION_STATE_CONFLICT"}), (file([], labeled=False, class_id=21), "classified", {"V2_CLASSIFICATION_STATE_CONFLICT"}),
]


@pytest.mark.parametrize("kind,cases", [("seg", STATES), ("cls", CLASSIFIED)])
def test_files(spark, kind, cases):
    df = inbox(spark, kind, [f for f, _, _ in cases] + [None])
    assert {r["file_index"]: r["state"] for r in file_states(df).collect()} == {i: s for i, (_, s, _) in enumerate(cases)}
    found = {}
    for r in file_findings(df).collect():
        found.setdefault(r["path"], set()).add(r["code"])
    assert found == {f"$.project.projectFiles[{i}]": codes for i, (_, _, codes) in enumerate(cases) if codes}


def test_projects(spark):
    codes = lambda df: {r["code"] for r in project_findings(df).collect()}
    assert codes(inbox(spark, "seg", None)) == {"V2_SEGMENTATION_OK_CLASS_RECOGNIZED", "V2_ENTITY_IDS_REBUILT"}
    assert "V2_SEGMENTATION_CLASS_STRUCTURE_INVALID" in codes(inbox(spark, "seg", [], classes=(BURR,))) & codes(inbox(spark, "seg", [], classes=None)) & codes(inbox(spark, "seg", [], classes=(OK, (21, "x", 1, None, None, None))))
    assert codes(inbox(spark, "det", [], classes=None)) == codes(inbox(spark, None, [], classes=None)) == {"V2_PROJECT_TYPE_UNSUPPORTED"}
    empty = inbox(spark, "seg", []).limit(0)
    assert findings(empty).count() == 0 and file_states(empty).count() == 0


def test_targets(spark):
    projects = spark.createDataFrame([(1, "v2-subvisionproj", "segmentation"), (2, "v1-srproj", "classification"), (3, "v1-srproj", "detection"), (4, "other", "segmentation")], "project_key long, source_format string, project_type string")
    found = spark.createDataFrame([(1, "V2_SPLIT_NAME_NOT_IN_V1", "drop"), (1, "V2_EXTERNAL_PATH_RELATIVE", "degrade"), (1, "V2_LABEL_ORIGIN_NOT_IN_V1", "drop"), (2, "X", "block")], "project_key long, code string, disposition string")
    rows = {(r["project_key"], r["target"]): (r["n_block"], r["n_loss"], r["confirmation"]) for r in target_readiness(projects, found).collect()}
    assert rows == {(1, "svpa-zip"): (0, 1, "loss"), (1, "srproj"): (0, 1, "mixed"), (2, "visionproj"): (1, 0, "none"), (2, "subvisionproj"): (1, 0, "none"), (2, "svpa-zip"): (1, 0, "none")}
    assert {r["confirmation"] for r in target_readiness(projects, found.filter(F.col("code") != "V2_LABEL_ORIGIN_NOT_IN_V1")).filter("target = 'srproj'").collect()} == {"relative-path"}
