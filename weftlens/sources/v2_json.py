"""V2 projects (JSON text) to the nested row that the flattening operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The typed view of a project; ids written as text are read as numbers where they are some.
SCHEMA = """project struct<projectId bigint, projectName string, projectType string, description string,
 roiMode string, roiPosX double, roiPosY double, roiWidth double, roiHeight double, roiShapeType string, modifiedDate bigint, createdDate bigint,
 classInfos array<struct<classId bigint, className string, classNo bigint, description string, classColor string, isNg boolean>>,
 datasets array<struct<datasetId bigint, datasetName string, createdDate bigint, splitSets array<struct<splitId bigint, splitName string, createdDate bigint>>>>,
 projectFiles array<struct<fileId bigint, fileName string, filePath string, isLabeled boolean, classId bigint, datasetId bigint, width bigint, height bigint,
   labelDataList array<struct<labelId bigint, labelType string, labeledDate bigint, classId bigint, classNo bigint, className string,
     labelPosX double, labelPosY double, labelWidth double, labelHeight double, labelContour string, contourSize double>>,
   metadata array<string>, registeredDate bigint, splitSets array<struct<splitId bigint, splitName string, splitType string>>>>>"""


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def _snake_type(value: Column, kind) -> Column:
    """The same value with all field names in snake case, by a cast: names of structs follow position."""
    from pyspark.sql import types as T

    def rename(t):
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(snake(f.name), rename(f.dataType), True) for f in t.fields])
        return T.ArrayType(rename(t.elementType), True) if isinstance(t, T.ArrayType) else t

    return value.cast(rename(kind))


def parse_v2(texts: DataFrame) -> DataFrame:
    """``texts`` (project_key, text) with ``code``, and ``project`` in snake case.

    ``code``: V2_INVALID_JSON, V2_PROJECT_MISSING, V2_PROJECT_NAME_INVALID,
    V2_PROJECT_FILES_INVALID or null. Unknown fields are left out; fields of
    another type than declared are null.
    """
    parsed = texts.withColumns({"__v": F.try_parse_json("text"), "__d": F.from_json("text", SCHEMA)})
    project = _snake_type(F.col("__d.project"), parsed.schema["__d"].dataType["project"].dataType)
    code = (
        F.when(F.col("__v").isNull(), "V2_INVALID_JSON")
        .when(F.try_variant_get("__v", "$.project.projectName", "string").isNull() & F.col("__d.project").isNull(), "V2_PROJECT_MISSING")
        .when(F.coalesce(F.trim("__d.project.projectName"), F.lit("")) == "", "V2_PROJECT_NAME_INVALID")
        .when(F.col("__d.project.projectFiles").isNull(), "V2_PROJECT_FILES_INVALID")
    )
    return parsed.select("project_key", code.alias("code"), project.alias("project"))


def inbox_rows(parsed: DataFrame) -> DataFrame:
    """Rows in the shape of ``v2_inbox``, of the projects that could be read."""
    return parsed.filter("code is null").select("project_key", "project.project_name", "project.project_type", "project.class_infos", "project.datasets", "project.project_files")
