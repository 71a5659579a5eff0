"""Projects back to text: V1 XML and V2 JSON, one row per project, and archives of them."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.geometry import normal_ring
from ..functions.paths import entry_problem


# The settings of a region that are written with it, and limits of a V1 text.
REGION_DEFAULTS = """    <RoiSetting>
      <Intensity Min="0" Max="255" />
      <Expansion Value="0" />
      <Inversion Value="False" />
      <Offset Left="100" Right="100" Top="100" Bottom="100" />
    </RoiSetting>
    <BlindGroup>
      <NumberOfBlinds>0</NumberOfBlinds>
    </BlindGroup>
"""
MOST_FILES, MOST_TEXT_BYTES = 19_996, 32 << 20


def _joined(rows: DataFrame, keys: list[str], order: str, fragment: Column, out: str) -> DataFrame:
    """Fragments of each key in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), fragment.alias("f"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["f"]), "").alias(out), F.count("*").cast("string").alias(f"n_{out}"))


def _tag(name: str, value: Column, indent: int) -> Column:
    """One element in one line; '' where the value is null."""
    return F.coalesce(F.concat(F.lit(" " * indent + f"<{name}>"), codes.xml_escape(value.cast("string")), F.lit(f"</{name}>\n")), F.lit(""))


def write_v1(projects: DataFrame, classes: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """(project_key, xml, code): deterministic V1 text, elements in index order, line ends of ``\\n``.

    What can't be written without guessing isn't: ``xml`` is null and ``code``
    says why: the project's type, its number of files, an unknown split, a
    colour that is none, a normal image with labels, a region that is neither
    none nor a rectangle inside the image, or a text above its limit.
    Rings are quantised and turned as V1 has them. Classification files carry
    their class, segmentation files a label group. Everything of one project
    comes together in one row, as its file does.
    """
    class_text = F.concat(F.lit("    <Class>\n"), _tag("Name", F.col("class_name"), 6), _tag("Color", codes.argb_number(F.col("class_color"), F.col("class_index")), 6), F.lit("    </Class>\n"))
    painted = classes.groupBy("project_key").agg(F.bool_or(codes.argb_number(F.col("class_color"), F.col("class_index")).isNull()).alias("unpainted"))
    normal = files.filter("is_normal").select("project_key", "file_index").join(labels.select("project_key", "file_index"), ["project_key", "file_index"], "left_semi").select("project_key").distinct().withColumn("contradicted", F.lit(True))
    assigned = files.groupBy("project_key").agg(F.count("*").alias("__files"), F.bool_or(~F.coalesce(F.col("split").isin(*codes.SPLITS_V1), F.lit(False))).alias("unsplit"))
    class_group = _joined(classes, ["project_key"], "class_index", class_text, "classes")
    point = lambda p: F.concat(F.lit('              <Point X="'), p[0].cast("string"), F.lit('" Y="'), p[1].cast("string"), F.lit('" />\n'))
    def contour(ring: Column, role: Column) -> Column:
        return F.concat(F.lit('            <Contour Type="'), F.initcap(role), F.lit('">\n'), F.array_join(F.transform(normal_ring(ring, role), point), ""), F.lit("            </Contour>\n"))

    label_text = F.concat(
        F.lit("        <Label>\n"), _tag("ClassIndex", F.col("class_index"), 10), _tag("Type", F.lit("Contours"), 10),
        F.lit("          <ContourGroup>\n"), F.array_join(F.zip_with("rings", "roles", contour), ""), F.lit("          </ContourGroup>\n        </Label>\n"),
    )
    label_group = _joined(labels, ["project_key", "file_index"], "label_index", label_text, "labels")
    kinds = projects.select("project_key", "project_type")
    rows = files.drop("n_labels").join(label_group, ["project_key", "file_index"], "left").join(kinds, "project_key")
    group = F.concat(
        F.lit("      <LabelGroup>\n"), _tag("IsNormal", F.initcap(F.coalesce("is_normal", F.lit(False)).cast("string")), 8), _tag("NumberOfLabels", F.coalesce("n_labels", F.lit("0")), 8),
        F.coalesce("labels", F.lit("")), F.lit("      </LabelGroup>\n"),
    )
    split = F.element_at(F.create_map(*[F.lit(x) for pair in codes.SPLITS_V1.items() for x in pair]), F.col("split"))
    image_text = F.concat(
        F.lit("    <Image>\n"), _tag("Path", F.col("source_path"), 6), _tag("Width", F.col("width"), 6), _tag("Height", F.col("height"), 6), _tag("SplitState", split, 6),
        F.when(F.col("project_type") == "segmentation", group).otherwise(_tag("ClassIndexOfLabel", F.col("class_index"), 6)), F.lit("    </Image>\n"),
    )
    image_group = _joined(rows, ["project_key"], "file_index", image_text, "images")
    whole = projects.join(class_group, "project_key", "left").join(image_group, "project_key", "left").join(painted, "project_key", "left").join(assigned, "project_key", "left").join(normal, "project_key", "left")
    number = lambda c: c.cast("decimal(20,6)").cast("double").cast("string")
    roi = F.when(
        F.col("roi_mode") == "simple",
        F.concat(
            F.lit('  <MaskingParameter>\n    <Type>Simple</Type>\n    <RoiRectangle X="'), number(F.col("roi_left")), F.lit('" Y="'), number(F.col("roi_top")), F.lit('" Width="'), number(F.col("roi_right") - F.col("roi_left")),
            F.lit('" Height="'), number(F.col("roi_bottom") - F.col("roi_top")), F.lit('" Shape="Rectangle" />\n' + REGION_DEFAULTS + "  </MaskingParameter>\n"),
        ),
    ).otherwise(F.lit("  <MaskingParameter>\n    <Type>Not set</Type>\n  </MaskingParameter>\n"))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<Project>\n'), _tag("Version", F.lit("0.9"), 2), _tag("Type", F.initcap("project_type"), 2), _tag("ModifiedDate", codes.v1_date_text(F.col("modified_ms")), 2),
        F.lit("  <ClassGroup>\n"), _tag("NumberOfClasses", F.coalesce("n_classes", F.lit("0")), 4), F.coalesce("classes", F.lit("")), F.lit("  </ClassGroup>\n"),
        F.lit("  <ImageGroup>\n"), _tag("NumberOfImages", F.coalesce("n_images", F.lit("0")), 4), F.coalesce("images", F.lit("")), F.lit("  </ImageGroup>\n"), roi, F.lit("</Project>\n"),
    )
    left, top, right, bottom = (F.col(f"roi_{s}") for s in ("left", "top", "right", "bottom"))
    inside = (left >= 0) & (top >= 0) & (right <= 1) & (bottom <= 1) & (right > left) & (bottom > top)
    code = (
        F.when(~F.coalesce(F.col("project_type").isin("classification", "segmentation"), F.lit(False)), "SRPROJ_PROJECT_TYPE_UNSUPPORTED").when(F.col("__files") > MOST_FILES, "SRPROJ_FILE_LIMIT_EXCEEDED")
        .when(F.col("unsplit"), "SRPROJ_SPLIT_UNSUPPORTED").when(F.col("unpainted"), "SRPROJ_CLASS_COLOR_INVALID").when((F.col("project_type") == "segmentation") & F.col("contradicted"), "SRPROJ_SEGMENTATION_NORMAL_LABEL_CONFLICT")
        .when(~F.coalesce("roi_mode", F.lit("none")).isin("none", "simple"), "SRPROJ_ROI_UNSUPPORTED").when((F.col("roi_mode") == "simple") & ~F.coalesce(inside, F.lit(False)), "SRPROJ_ROI_BOUNDS_INVALID")
    )
    judged = whole.select("project_key", F.when(code.isNull(), xml).alias("xml"), code.alias("code"))
    return judged.select("project_key", F.when(F.octet_length("xml") <= MOST_TEXT_BYTES, F.col("xml")).alias("xml"), F.coalesce("code", F.when(F.octet_length("xml") > MOST_TEXT_BYTES, "SRPROJ_XML_TEXT_LIMIT_EXCEEDED")).alias("code"))


def write_v2(inbox: DataFrame) -> DataFrame:
    """(project_key, json): V2 text of rows shaped like ``v2_inbox``, in camel case, null fields left out."""
    from pyspark.sql import types as T

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(r.capitalize() for r in rest)

    def rename(t):
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(camel(f.name), rename(f.dataType), True) for f in t.fields])
        return T.ArrayType(rename(t.elementType), True) if isinstance(t, T.ArrayType) else t

    body = [f for f in inbox.schema.fields if f.name not in ("project_key", "received_at")]
    fields = [F.col(f.name).cast(rename(f.dataType)).alias(camel(f.name)) for f in body]
    return inbox.select("project_key", F.to_json(F.struct(F.struct(F.col("project_key").alias("projectId"), *fields).alias("project"))).alias("json"))


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """Writes one ZIP per ``archive`` of (archive, entry_name, content, ordinal) below ``folder``; gives (archive, path, n_entries, n_bytes).

    Entries are stored uncompressed in order of ``ordinal`` and streamed: no
    archive is gathered in memory. A file is written under a name of its own
    and renamed when whole, so a lost executor or a second attempt leaves none
    half-written. An archive name that isn't safe stops the job: ``../`` never
    leaves the folder, which every executor must have mounted.
    """
    bad = entries.filter(entry_problem(F.col("archive")).isNotNull()).select("archive").first()
    if bad is not None:
        raise ValueError(f"unsafe archive name: {bad['archive']!r}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, at, part, path, sizes, own = [], None, None, None, [0, 0], f".{uuid.uuid4().hex}"

        def close() -> None:
            if part is not None:
                part.close()
                os.replace(path + own, path)
                done.append((at, path, *sizes))

        for batch in batches:
            for name, entry, content in zip(batch["archive"], batch["entry_name"], batch["content"]):
                if name != at:
                    close()
                    at, sizes, path = name, [0, 0], os.path.join(folder, name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    part = zipfile.ZipFile(path + own, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0))
                part.writestr(info, bytes(content or b""))
                sizes[0], sizes[1] = sizes[0] + 1, sizes[1] + len(content or b"")
        close()
        yield pd.DataFrame(done, columns=["archive", "path", "n_entries", "n_bytes"])

    ordered = entries.select("archive", "entry_name", "content", "ordinal").repartition(F.col("archive")).sortWithinPartitions("archive", "ordinal")
    return ordered.mapInPandas(write, "archive string, path string, n_entries long, n_bytes long")
