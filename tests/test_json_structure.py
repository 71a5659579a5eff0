"""Sizes, limits and unknown fields of V2 texts."""

import json

import pytest

from weftlens.sources.json_structure import LIMITS, json_findings, json_usage, unmapped, usage


@pytest.mark.parametrize("text,expected", [
    ("{}", (1, 1, None)), ("5", (1, 0, None)), ('{"a": [1, {"b": null}]}', (5, 3, None)), ("{", (None, None, "V2_INVALID_JSON")), (None, (None, None, "V2_INVALID_JSON")), ("", (None, None, "V2_INVALID_JSON")), ("[" * 200 + "]" * 200, (129, 129, "V2_JSON_DEPTH_LIMIT_EXCEEDED")),
    ("[" * 100_000 + "]" * 100_000, (None, None, "V2_JSON_DEPTH_LIMIT_EXCEEDED")), ('"' + "x" * (16 << 20) + '"', (None, None, "V2_TEXT_LIMIT_EXCEEDED")), ("[" + ",".join("1" * 1_000_001) + "]", (1_000_001, 1, "V2_JSON_VALUE_LIMIT_EXCEEDED")),
])
def test_usage(text, expected):
    assert usage(text) == expected


def test_unmapped_fields():
    project = {"projectId": 1, "odd": 5, "blank": "", "none": None, "empty": [], "classInfos": [{"className": "a", "x": 1}], "datasets": None, "projectFiles": [{"y": {"z": 1}, "labelDataList": [{"labelId": 1, "w": True}], "splitSets": [{"v": 0}]}]}
    assert sorted(p for c, d, p in unmapped(json.dumps({"project": project, "more": 1})) if (c, d) == ("V2_UNMAPPED_FIELD", "drop")) == ["$.more", "$.project.classInfos[0].x", "$.project.odd", "$.project.projectFiles[0].labelDataList[0].w", "$.project.projectFiles[0].splitSets[0].v", "$.project.projectFiles[0].y"]
    assert unmapped("[]") == unmapped('{"project": 5}') == [("V2_PROJECT_MISSING", "block", "$.project")] and unmapped("{") == [("V2_INVALID_JSON", "block", "$")]
    assert unmapped('{"project": {"classInfos": {}, "projectFiles": [1]}}') == [("V2_ARRAY_INVALID", "block", "$.project.classInfos"), ("V2_ARRAY_INVALID", "block", "$.project.projectFiles")]
    many = {"project": {"datasets": [{}] * (LIMITS["project.datasets"][0] + 1)}}
    assert unmapped(json.dumps(many)) == [("V2_DATASET_LIMIT_EXCEEDED", "block", "$.project.datasets")]


def test_over_tables(spark):
    texts = spark.createDataFrame([(1, '{"project": {"odd": 1}}'), (2, None), (3, '{"project": {}}')], "project_key long, text string")
    assert {tuple(r) for r in json_findings(texts).collect()} == {(1, "V2_UNMAPPED_FIELD", "drop", "$.project.odd"), (2, "V2_INVALID_JSON", "block", "$")}
    assert {tuple(r) for r in json_usage(texts).collect()} == {(1, 3, 2, None), (2, None, None, "V2_INVALID_JSON"), (3, 2, 2, None)}
    assert json_findings(texts.limit(0)).count() == 0 and json_usage(texts.limit(0)).count() == 0
