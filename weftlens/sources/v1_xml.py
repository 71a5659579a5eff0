"""V1 projects (XML text) to related tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

# Every child that may stand only once is an array all the same: a repeated element shows as size 2 instead of vanishing.
SCHEMA = """Version array<string>, Type array<string>, ModifiedDate array<string>,
ClassGroup array<struct<NumberOfClasses array<string>, Class array<struct<Name array<string>, Color array<string>>>>>,
ImageGroup array<struct<NumberOfImages array<string>, Image array<struct<
  Path array<string>, Width array<string>, Height array<string>, SplitState array<string>, ClassIndexOfLabel array<string>,
  LabelGroup array<struct<IsNormal array<string>, NumberOfLabels array<string>, Label array<struct<
    ClassIndex array<string>, Type array<string>,
    ContourGroup array<struct<Contour array<struct<_Type string, Point array<struct<_X string, _Y string>>>>>>>>>>>>>>,
MaskingParameter array<struct<Type array<string>,
  RoiRectangle array<struct<_X string, _Y string, _Width string, _Height string, _Shape string>>>>,
_corrupt_record string"""


# What a V1 text may not hold: declarations other than comments and CDATA.
FORBIDDEN = r"<!(?!--|\[CDATA\[)"


def one(values: Column) -> Column:
    """The first of what should be one element."""
    return F.get(values, F.lit(0))


def parse_v1(texts: DataFrame) -> DataFrame:
    """``texts`` (project_key, text) with ``doc``; null where the text has a DOCTYPE or isn't well-formed."""
    legal = ~F.col("text").rlike(FORBIDDEN)
    return texts.withColumn("doc", F.when(legal, F.from_xml("text", SCHEMA, {"attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "true"})))


def _bad(parsed: DataFrame) -> Column:
    return F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()


def projects(parsed: DataFrame) -> DataFrame:
    """One row per readable project: type, version, modified_ms, ROI as left, top, right, bottom."""
    good = parsed.filter(~_bad(parsed))
    mask = one(F.col("doc.MaskingParameter"))
    roi_type = F.lower(one(mask["Type"]))
    rect = one(mask["RoiRectangle"])
    number = lambda f: codes.strict_number(rect[f])
    simple = roi_type == "simple"
    return good.select(
        "project_key", codes.mapped(one(F.col("doc.Type")), codes.PROJECT_TYPES).alias("project_type"), one(F.col("doc.Version")).alias("format_version"), codes.v1_date_ms(one(F.col("doc.ModifiedDate"))).alias("modified_ms"),
        F.when(roi_type.isNull() | roi_type.isin("no", "none", "not set"), "none").when(simple, "simple").otherwise("other").alias("roi_mode"),
        F.when(simple, number("_X")).alias("roi_left"), F.when(simple, number("_Y")).alias("roi_top"),
        F.when(simple, number("_X") + number("_Width")).alias("roi_right"), F.when(simple, number("_Y") + number("_Height")).alias("roi_bottom"),
    )


def classes(parsed: DataFrame) -> DataFrame:
    """(project_key, class_index, class_name, class_color) in written order."""
    rows = parsed.filter(~_bad(parsed)).select("project_key", F.posexplode(one(F.col("doc.ClassGroup"))["Class"]).alias("class_index", "c"))
    return rows.select("project_key", "class_index", one(F.col("c.Name")).alias("class_name"), codes.argb_text(one(F.col("c.Color")).try_cast("bigint")).alias("class_color"))


def files(parsed: DataFrame) -> DataFrame:
    """(project_key, file_index, source_path, width, height, split, class_index, is_normal, n_labels)."""
    rows = parsed.filter(~_bad(parsed)).select("project_key", F.posexplode(one(F.col("doc.ImageGroup"))["Image"]).alias("file_index", "i"))
    group = one(F.col("i.LabelGroup"))
    return rows.select(
        "project_key", "file_index", one(F.col("i.Path")).alias("source_path"), codes.strict_integer(one(F.col("i.Width"))).alias("width"), codes.strict_integer(one(F.col("i.Height"))).alias("height"),
        codes.split_type(one(F.col("i.SplitState"))).alias("split"), codes.strict_integer(one(F.col("i.ClassIndexOfLabel"))).alias("class_index"),
        codes.strict_boolean(one(group["IsNormal"])).alias("is_normal"), F.coalesce(F.size(group["Label"]), F.lit(0)).alias("n_labels"),
    )


def labels(parsed: DataFrame) -> DataFrame:
    """(project_key, file_index, label_index, class_index, roles, rings) of segmentation labels; coordinates that are no numbers are null."""
    images = parsed.filter(~_bad(parsed)).select("project_key", F.posexplode(one(F.col("doc.ImageGroup"))["Image"]).alias("file_index", "i"))
    rows = images.select("project_key", "file_index", F.posexplode(one(F.col("i.LabelGroup"))["Label"]).alias("label_index", "l"))
    contours = one(F.col("l.ContourGroup"))["Contour"]
    rings = F.transform(contours, lambda c: F.transform(c["Point"], lambda p: F.array(codes.strict_number(p["_X"]), codes.strict_number(p["_Y"]))))
    return rows.select("project_key", "file_index", "label_index", codes.strict_integer(one(F.col("l.ClassIndex"))).alias("class_index"), F.transform(contours, lambda c: F.lower(c["_Type"])).alias("roles"), rings.alias("rings"))


def diagnostics(parsed: DataFrame) -> DataFrame:
    """(project_key, code, disposition, path): what stands against a V1 text, one row per finding."""
    broken = parsed.filter(_bad(parsed)).select("project_key", F.when(F.col("text").rlike(FORBIDDEN), "V1_XML_DECLARATION_FORBIDDEN").otherwise("V1_INVALID_XML").alias("code"), F.lit("$").alias("path"))
    good = parsed.filter(~_bad(parsed))
    class_group, image_group = one(F.col("doc.ClassGroup")), one(F.col("doc.ImageGroup"))
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    names = F.transform(class_group["Class"], lambda c: F.lower(one(c["Name"])))
    rules = [
        ("V1_VERSION_UNVERIFIED", ~one(F.col("doc.Version")).eqNullSafe("0.9"), "$.Version"),
        ("V1_PROJECT_TYPE_UNSUPPORTED", ~codes.mapped(one(F.col("doc.Type")), codes.PROJECT_TYPES).isin("classification", "segmentation"), "$.Type"),
        ("V1_DUPLICATE_ELEMENT", F.greatest(*[n(F.col(f"doc.{c}")) for c in ("Version", "Type", "ModifiedDate", "ClassGroup", "ImageGroup", "MaskingParameter")]) > 1, "$"),
        ("V1_CLASS_COUNT_MISMATCH", codes.strict_integer(one(class_group["NumberOfClasses"])) != n(class_group["Class"]), "$.ClassGroup"),
        ("V1_CLASS_COUNT_INVALID", class_group.isNotNull() & codes.strict_integer(one(class_group["NumberOfClasses"])).isNull(), "$.ClassGroup"),
        ("V1_DUPLICATE_CLASS_NAME", F.size(F.array_distinct(names)) < F.size(names), "$.ClassGroup"),
        ("V1_IMAGE_COUNT_MISMATCH", codes.strict_integer(one(image_group["NumberOfImages"])) != n(image_group["Image"]), "$.ImageGroup"),
        ("V1_IMAGE_COUNT_INVALID", image_group.isNotNull() & codes.strict_integer(one(image_group["NumberOfImages"])).isNull(), "$.ImageGroup"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, test, path in rules]), lambda d: d.isNotNull())
    whole = good.select("project_key", F.explode(found).alias("d")).select("project_key", "d.code", "d.path")
    images = files(parsed).filter("split = 'unknown'").select("project_key", F.lit("V1_SPLIT_UNSUPPORTED").alias("code"), F.format_string("$.ImageGroup.Image[%d].SplitState", "file_index").alias("path"))
    normal = files(parsed).filter("is_normal and n_labels > 0").select("project_key", F.lit("V1_NORMAL_IMAGE_HAS_LABELS").alias("code"), F.format_string("$.ImageGroup.Image[%d].LabelGroup", "file_index").alias("path"))
    rings = labels(parsed)
    at = F.format_string("$.ImageGroup.Image[%d].LabelGroup.Label[%d]", "file_index", "label_index")
    of_rings = [
        ("V1_CONTOUR_REQUIRED", n(F.col("rings")) == 0),
        ("V1_CONTOUR_POINT_COUNT_INVALID", F.exists("rings", lambda r: n(r) < 3)),
        ("V1_POINT_COORDINATE_INVALID", F.exists("rings", lambda r: F.exists(r, lambda p: p[0].isNull() | p[1].isNull()))),
        ("V1_CONTOUR_TYPE_INVALID", F.exists("roles", lambda r: ~F.coalesce(r.isin("outer", "inner"), F.lit(False)))),
        ("V1_INNER_CONTOUR_BEFORE_OUTER", (F.array_position("roles", "inner") > 0) & ((F.array_position("roles", "outer") == 0) | (F.array_position("roles", "inner") < F.array_position("roles", "outer")))),
        ("V1_SEGMENTATION_CLASS_INDEX_INVALID", F.col("class_index").isNull()),
    ]
    listed = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in of_rings]), lambda c: c.isNotNull())
    label_rows = rings.select("project_key", F.explode(listed).alias("code"), at.alias("path"))
    return broken.unionByName(whole).unionByName(images).unionByName(normal).unionByName(label_rows).withColumn("disposition", F.lit("block"))
