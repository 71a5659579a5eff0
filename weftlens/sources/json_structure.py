"""What the text of a V2 project holds beside what is read from it: size and depth, limits, and fields that nothing is known of."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of each object of a V2 project, by where it stands.
FIELDS = {
    "project": "projectId projectName projectType description roiMode roiPosX roiPosY roiWidth roiHeight roiShapeType roiShape roiBitmap modifiedDate createdDate createdBy metadataList metadataKeys classInfos datasets projectFiles".split(),
    "project.classInfos": "classId className classNo description classColor isNg".split(),
    "project.datasets": "datasetId datasetName description modifiedDate createdDate createdBy projects metadataList splitSets".split(),
    "project.projectFiles": "fileId projectId fileName filePath isLabeled classId classNo className datasetId datasetName width height labelDataList metadata modifiedDate assignedDate registeredDate isGenerated splitSets".split(),
    "project.projectFiles.labelDataList": "labelId labelType labeledDate contourId classId classNo className labelPosX labelPosY labelWidth labelHeight labelBitmap labelPolygon labelContour contourSize".split(),
    "project.projectFiles.splitSets": "splitId splitName splitType".split(),
}
# Limits of a V2 text and of what it lists.
MOST_BYTES, MOST_VALUES, MOST_DEPTH = 16 << 20, 1_000_000, 128
LIMITS = {"project.classInfos": (10_000, "V2_CLASS_LIMIT_EXCEEDED"), "project.datasets": (1_024, "V2_DATASET_LIMIT_EXCEEDED"), "project.projectFiles": (19_996, "V2_FILE_LIMIT_EXCEEDED"), "project.projectFiles.labelDataList": (250_000, "V2_LABEL_LIMIT_EXCEEDED"), "project.projectFiles.splitSets": (250_000, "V2_SPLIT_LIMIT_EXCEEDED")}

USAGE = "project_key long, n_values long, depth int, code string"
FOUND = "project_key long, code string, disposition string, path string"


def _load(text: str | None) -> tuple[object, str | None]:
    if text is None:
        return None, "V2_INVALID_JSON"
    if len(text) > MOST_BYTES or len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        return None, "V2_TEXT_LIMIT_EXCEEDED"
    try:
        return json.loads(text.lstrip("﻿")), None
    except RecursionError:
        return None, "V2_JSON_DEPTH_LIMIT_EXCEEDED"
    except ValueError:
        return None, "V2_INVALID_JSON"


def usage(text: str | None) -> tuple[int | None, int | None, str | None]:
    """(n_values, depth, code) of one JSON text: all values, containers included, and how deep these lie in each other."""
    root, code = _load(text)
    if code:
        return None, None, code
    n, depth, todo = 0, 0, [(root, 1)]
    while todo:
        value, level = todo.pop()
        n += 1
        if isinstance(value, (dict, list)):
            depth = max(depth, level)
            if level > MOST_DEPTH:
                return n, depth, "V2_JSON_DEPTH_LIMIT_EXCEEDED"
            todo += [(v, level + 1) for v in (value.values() if isinstance(value, dict) else value)]
        if n > MOST_VALUES:
            return n, depth, "V2_JSON_VALUE_LIMIT_EXCEEDED"
    return n, depth, None


def _says(value: object) -> bool:
    return value is not None and value != "" and not (isinstance(value, (list, dict)) and not value)


def unmapped(text: str | None) -> list[tuple[str, str, str]]:
    """(code, disposition, path) of one V2 text: what can't be read, lists that are none or too long, and fields without a counterpart."""
    root, code = _load(text)
    if code:
        return [(code, "block", "$")]
    if not isinstance(root, dict) or not isinstance(root.get("project"), dict):
        return [("V2_PROJECT_MISSING", "block", "$.project")]
    out = [("V2_UNMAPPED_FIELD", "drop", f"$.{k}") for k, v in root.items() if k != "project" and _says(v)]
    counts: dict[str, int] = {}
    todo: list[tuple[str, str, dict]] = [("project", "$.project", root["project"])]
    while todo:
        kind, place, value = todo.pop(0)
        out += [("V2_UNMAPPED_FIELD", "drop", f"{place}.{k}") for k, v in value.items() if k not in FIELDS[kind] and _says(v)]
        for field in value:
            below = f"{kind}.{field}"
            if below in FIELDS and value[field] is not None:
                items = value[field]
                if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
                    out.append(("V2_ARRAY_INVALID", "block", f"{place}.{field}"))
                    continue
                counts[below] = counts.get(below, 0) + len(items)
                if below not in LIMITS or counts[below] <= LIMITS[below][0]:
                    todo += [(below, f"{place}.{field}[{i}]", x) for i, x in enumerate(items)]
    return out + [(LIMITS[k][1], "block", "$." + k) for k, n in counts.items() if k in LIMITS and n > LIMITS[k][0]]


def json_usage(texts: DataFrame) -> DataFrame:
    """(project_key, n_values, depth, code) of texts (project_key, text), one row each; ``code`` says why a text is refused."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *usage(t)) for k, t in zip(batch["project_key"], batch["text"])]
            yield pd.DataFrame(rows, columns=["project_key", "n_values", "depth", "code"]).astype({"n_values": "Int64", "depth": "Int32"})

    return texts.select("project_key", "text").mapInPandas(read, USAGE)


def json_findings(texts: DataFrame) -> DataFrame:
    """(project_key, code, disposition, path) of texts (project_key, text): see ``unmapped``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["project_key"], batch["text"]):
                yield pd.DataFrame([(key, *f) for f in unmapped(text)], columns=["project_key", "code", "disposition", "path"])

    return texts.select("project_key", "text").mapInPandas(read, FOUND)
