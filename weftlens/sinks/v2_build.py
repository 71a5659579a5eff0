"""V2 projects built from the canonical tables of V1 ones: findings that forbid it, and the JSON text.

Tables: projects (project_key, project_name, description, project_type,
modified_ms, roi_mode, roi_left, roi_top, roi_right, roi_bottom), classes
(project_key, class_index, class_name, class_color, is_ng), files (project_key,
file_index, source_path, file_name, width, height, split, is_normal,
is_labeled, class_index) and labels (project_key, file_index, label_index,
class_index, rings, roles). Findings are rows and are computed per row; only
the text of a project comes together in one row, as its file does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import bind
from ..functions.geometry import bounds, inner_before_outer, signed_area2
from ..functions.paths import last_segment, nfkc_lower, normalize_path, strip_quotes
from ..operators.diagnostics import contiguous
from ..operators.naming import running_ids
from ..session import cut

# The class that normal images of a segmentation project have, and its colour.
OK_NAME, OK_COLOR = "OK", "#1DDB16"
# Offsets of the made-up identifiers from the project's.
DATASET_ID, SPLIT_ID, CLASS_IDS, FILE_IDS, LABEL_IDS = 1, 2, 10, 1_000, 100_000
# Most classes of a V2 project, and most bytes of a path.
MOST_CLASSES, MOST_PATH_BYTES = 10_000, 4_096
SPLIT_NAME = "srproj"


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, null if none does."""
    return reduce(lambda e, r: e.when(F.coalesce(r[1], F.lit(False)), r[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0]))


def _every(rules: list[tuple[str, Column]]) -> Column:
    """The codes of all rules that hold."""
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules]), lambda c: c.isNotNull())


def positive(x: Column) -> Column:
    return F.coalesce((x > 0) & (x <= codes.SAFE_INTEGER), F.lit(False))


def contour_problem(rings: Column, roles: Column, width: Column, height: Column) -> Column:
    """First reason why a label's rings can't be written as a V2 contour, null if they can."""
    outside = lambda p: p[0].isNull() | p[1].isNull() | F.isnan(p[0]) | F.isnan(p[1]) | (p[0] < 0) | (p[1] < 0) | F.coalesce(p[0] > width, F.lit(False)) | F.coalesce(p[1] > height, F.lit(False))
    return _first([
        ("V2_WRITE_SEGMENTATION_CONTOUR_REQUIRED", rings.isNull() | (F.size(rings) == 0)),
        ("V2_WRITE_SEGMENTATION_RING_ROLE_REQUIRED", roles.isNull() | (F.size(roles) != F.size(rings)) | ~F.forall(roles, lambda r: F.coalesce(r.isin("outer", "inner"), F.lit(False)))),
        ("V2_WRITE_SEGMENTATION_OUTER_RING_REQUIRED", ~F.array_contains(roles, "outer")),
        ("V2_WRITE_SEGMENTATION_RING_ORDER_INVALID", inner_before_outer(roles)),
        ("V2_WRITE_SEGMENTATION_CONTOUR_INVALID", F.exists(rings, lambda r: r.isNull() | (F.size(r) < 3))),
        ("V2_WRITE_SEGMENTATION_POINT_INVALID", F.exists(rings, lambda r: F.exists(r, outside))),
        ("V2_WRITE_SEGMENTATION_CONTOUR_AREA_INVALID", F.exists(rings, lambda r: signed_area2(r) == 0)),
        ("V2_WRITE_SEGMENTATION_GEOMETRY_INVALID", bind(bounds(rings), lambda b: (b["width"] <= 0) | (b["height"] <= 0)) | (contour_area(rings, roles) <= 0)),
    ])


def oriented(rings: Column, roles: Column) -> Column:
    """Rings with positive area outside and negative inside."""
    return F.zip_with(rings, roles, lambda r, role: F.when((signed_area2(r) > 0) == (role == "outer"), r).otherwise(F.reverse(r)))


def contour_area(rings: Column, roles: Column) -> Column:
    """Area of the outer rings less that of the inner ones, in pixels, exact to half of one."""
    parts = F.zip_with(rings, roles, lambda r, role: F.when(role == "outer", 1.0).otherwise(-1.0) * F.abs(signed_area2(r)) / 2)
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def write_findings(projects: DataFrame, classes: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """(project_key, code, path): what forbids to write a project as V2, one row per finding."""
    kinds = projects.select("project_key", "project_type")
    is_seg = F.col("project_type") == "segmentation"
    path = lambda c, *parts: F.format_string(c, *parts)
    listed = lambda df, rules, at: df.select("project_key", F.explode(_every(rules)).alias("code"), at.alias("path"))
    roi = [F.col(f"roi_{s}") for s in ("left", "top", "right", "bottom")]
    left, top, right, bottom = roi
    simple, mode = F.col("roi_mode") == "simple", F.coalesce("roi_mode", F.lit("none"))
    bounded = (left >= 0) & (top >= 0) & (right <= 1) & (bottom <= 1) & (right > left) & (bottom > top)
    whole = (left == 0) & (top == 0) & (right == 1) & (bottom == 1)
    first = files.filter("file_index = 0").groupBy("project_key").agg(F.bool_or(positive(F.col("width")) & positive(F.col("height"))).alias("staged"))
    of_project = projects.join(first, "project_key", "left")
    out = listed(of_project, [
        ("V2_WRITE_PROJECT_TYPE_UNSUPPORTED", ~F.coalesce(F.col("project_type").isin("classification", "segmentation"), F.lit(False))),
        ("V2_WRITE_ROI_MODE_UNSUPPORTED", ~mode.isin("none", "simple")),
        ("V2_WRITE_ROI_BOUNDS_INVALID", simple & ~F.coalesce(bounded, F.lit(False))),
        ("V2_WRITE_ROI_STAGE_SIZE_REQUIRED", simple & bounded & ~whole & ~F.coalesce("staged", F.lit(False))),
    ], F.lit("$.project"))
    named = classes.withColumns({"__key": nfkc_lower(F.trim("class_name")), "__blank": F.coalesce(F.trim("class_name"), F.lit("")) == ""})
    # Names are reduced before a project's classes meet: equal names are one row each.
    names = named.groupBy("project_key", "__key").agg(F.count("*").alias("n"), F.bool_or("__blank").alias("blank"))
    names = names.groupBy("project_key").agg(F.bool_or(F.col("n") > 1).alias("twice"), F.bool_or("blank").alias("blank"), F.bool_or(F.col("__key") == "ok").alias("ok"), F.sum("n").alias("n"))
    index = lambda df, column: contiguous(df, "project_key", column).select("project_key", "is_contiguous")
    sums = names.join(index(classes, "class_index"), "project_key").join(kinds, "project_key")
    out = out.unionByName(listed(sums, [
        ("V2_WRITE_CLASS_INDEX_INVALID", ~F.col("is_contiguous")), ("V2_WRITE_CLASS_NAME_REQUIRED", F.col("blank")), ("V2_WRITE_CLASS_NAME_DUPLICATE", F.col("twice")),
        ("V2_WRITE_SEGMENTATION_OK_CLASS_RESERVED", is_seg & F.col("ok")), ("V2_WRITE_CLASS_LIMIT_EXCEEDED", F.col("n") + is_seg.cast("int") > MOST_CLASSES),
    ], F.lit("$.classes")))
    out = out.unionByName(listed(index(files, "file_index"), [("V2_WRITE_FILE_INDEX_INVALID", ~F.col("is_contiguous"))], F.lit("$.files")))
    counts = labels.groupBy("project_key", "file_index").agg(F.count("*").alias("n_labels"))
    known = classes.select("project_key", "class_index", F.lit(True).alias("known")).distinct()
    rows = files.join(counts, ["project_key", "file_index"], "left").fillna(0, ["n_labels"]).join(kinds, "project_key").join(known, ["project_key", "class_index"], "left")
    bare = strip_quotes(F.col("source_path"))
    slashed = F.translate(bare, "\\", "/")
    out = out.unionByName(listed(rows, [
        ("V2_WRITE_IMAGE_DIMENSIONS_REQUIRED", ~(positive(F.col("width")) & positive(F.col("height")))),
        ("V2_WRITE_SPLIT_UNSUPPORTED", ~F.coalesce(F.col("split").isin(*codes.SPLITS_V2), F.lit(False))),
        ("V2_WRITE_CLASSIFICATION_OBJECT_LABEL", ~is_seg & (F.col("n_labels") > 0)),
        ("V2_WRITE_CLASS_REFERENCE_INVALID", ~is_seg & F.col("class_index").isNotNull() & F.col("known").isNull()),
        ("V2_WRITE_SEGMENTATION_NORMAL_LABEL_CONFLICT", is_seg & F.col("is_normal") & (F.col("n_labels") > 0)),
        ("V2_WRITE_SEGMENTATION_STATE_CONFLICT", is_seg & ~F.col("is_labeled") & (F.coalesce("is_normal", F.lit(False)) | (F.col("n_labels") > 0))),
        ("V2_WRITE_SEGMENTATION_LABEL_REQUIRED", is_seg & F.col("is_labeled") & ~F.coalesce("is_normal", F.lit(False)) & (F.col("n_labels") == 0)),
        ("V2_WRITE_PATH_LIMIT_EXCEEDED", F.octet_length("source_path") > MOST_PATH_BYTES),
        ("V2_WRITE_EXTERNAL_PATH_CONTROL_CHARACTER", F.col("source_path").rlike(r"[\x00-\x1f\x7f]")),
        ("V2_WRITE_EXTERNAL_PATH_TRAVERSAL", F.array_contains(F.split(slashed, "/"), "..")),
        ("V2_WRITE_EXTERNAL_PATH_RELATIVE", ~F.coalesce(slashed.rlike(r"(?i)^(/|[a-z]:/|file://)"), F.lit(False))),
    ], path("$.files[%d]", "file_index")))
    sized = labels.join(files.select("project_key", "file_index", "width", "height"), ["project_key", "file_index"], "left").join(kinds.filter(is_seg), "project_key").join(known, ["project_key", "class_index"], "left")
    problem = _first([("V2_WRITE_CLASS_REFERENCE_INVALID", F.col("known").isNull())])
    problem = F.coalesce(problem, contour_problem(F.col("rings"), F.col("roles"), F.col("width"), F.col("height")))
    of_labels = sized.select("project_key", problem.alias("code"), path("$.files[%d].labels[%d]", "file_index", "label_index").alias("path")).filter("code is not null")
    return out.unionByName(of_labels)


def _roi_shape(project_id: Column, width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The drawing of a rectangle over the first image, as JSON text."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    identity = F.concat_ws(":", project_id.cast("string"), *map(number, (left, top, right, bottom)))
    uid = lambda part: codes.deterministic_uuid(F.concat(identity, F.lit(f":{part}"))).alias("id")
    rectangle = [(left * width).alias("x"), (top * height).alias("y"), ((right - left) * width).alias("width"), ((bottom - top) * height).alias("height")]
    lit = lambda **k: [F.lit(v).alias(n) for n, v in k.items()]
    def node(attrs: list[Column], name: str, *children: Column) -> Column:
        below = [F.lit(',"children":['), F.concat_ws(",", *children), F.lit("]")] if children else []
        return F.concat(F.lit('{"attrs":'), F.to_json(F.struct(*attrs)), F.lit(f',"className":"{name}"'), *below, F.lit("}"))

    background = node([uid("background"), *lit(isBackground=True), width.alias("width"), height.alias("height"), *lit(fill="black", selectable=False, opacity=0.6, selected=False)], "Rect")
    mask = node([*rectangle, uid("mask"), *lit(fill="white", selectable=False, strokeWidth=1, globalCompositeOperation="destination-out")], "Rect")
    outline = node([*rectangle, uid("outline"), *lit(selectable=False, stroke="white"), F.array(F.lit(2), F.lit(2)).alias("dash"), *lit(shadowColor="black", shadowBlur=1, shadowOffsetX=0.5, shadowOffsetY=0.5, strokeWidth=1, strokeScaleEnabled=False)], "Rect")
    group = node([uid("group"), *lit(name="roi-area", selectable=True, selected=False, UIType="roi", x=0, y=0, scaleX=1, scaleY=1)], "Group", mask, outline)
    return node([*lit(id="base-layer"), F.struct(width.alias("width"), height.alias("height")).alias("stageSize")], "Layer", background, group)


def build_v2(projects: DataFrame, classes: DataFrame, files: DataFrame, labels: DataFrame) -> DataFrame:
    """(project_key, json, n_findings): V2 text of each project that nothing forbids to write, else null.

    Identifiers follow from the project's identity, so the text is the same on
    every run. Segmentation projects get the structural OK class before their
    own. Labels are numbered through in order of file and label.
    """
    findings = write_findings(projects, classes, files, labels).groupBy("project_key").agg(F.count("*").alias("n_findings"))
    ident_classes = classes.groupBy("project_key").agg(F.collect_list(F.struct(F.col("class_index").alias("index"), F.col("class_name").alias("name"))).alias("cs"))
    pathed = files.withColumns({"__path": normalize_path(F.col("source_path"))})
    ident_files = pathed.groupBy("project_key").agg(F.collect_list(F.struct(F.col("file_index").alias("index"), F.col("__path").alias("path"), F.coalesce("file_name", last_segment(F.col("__path"))).alias("file_name"))).alias("fs"))
    empty = lambda c: F.coalesce(c, F.array())
    heads = projects.join(ident_classes, "project_key", "left").join(ident_files, "project_key", "left").join(findings, "project_key", "left").fillna(0, ["n_findings"])
    heads = heads.withColumn("pid", codes.project_number(codes.project_identity(F.col("project_name"), empty(F.col("cs")), empty(F.col("fs"))))).drop("cs", "fs")
    heads = heads.withColumn("at", F.greatest(F.lit(0), F.coalesce("modified_ms", F.lit(0))).cast("bigint")).withColumn("dataset", F.coalesce(F.nullif(F.trim("project_name"), F.lit("")), F.lit("dataset")))
    heads = cut(heads)  # one row per project, used at every level below
    good = heads.filter("n_findings = 0")
    head = good.select("project_key", "pid", "at", "dataset", "project_type")
    is_seg = F.col("project_type") == "segmentation"

    class_row = F.struct(
        F.col("class_index").alias("order"),
        F.struct((F.col("pid") + CLASS_IDS + F.col("class_index")).alias("classId"), F.col("class_name").alias("className"), (F.col("class_index") + is_seg.cast("int")).alias("classNo"), F.lit("").alias("description"), codes.class_color(F.col("class_color"), F.col("class_index")).alias("classColor"), F.coalesce("is_ng", is_seg).alias("isNg")).alias("c"),
    )
    class_list = classes.join(head, "project_key").groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(class_row)), lambda r: r["c"]).alias("class_list"))
    names = classes.select("project_key", "class_index", "class_name")

    drawn = labels.join(head.filter(is_seg).select("project_key"), "project_key", "left_semi").select("project_key", "file_index", "label_index", "class_index", "rings", "roles")
    whole = files.join(head.filter(~is_seg).select("project_key"), "project_key", "left_semi").filter("class_index is not null").select("project_key", "file_index", F.lit(0).alias("label_index"), F.col("class_index").cast(labels.schema["class_index"].dataType).alias("class_index"), F.lit(None).cast(labels.schema["rings"].dataType).alias("rings"), F.lit(None).cast(labels.schema["roles"].dataType).alias("roles"))
    numbered = running_ids(drawn.unionByName(whole), "project_key", ["file_index", "label_index"], F.lit(LABEL_IDS).cast("bigint"), "number")
    placed = numbered.join(names, ["project_key", "class_index"]).join(head, "project_key").withColumn("lid", F.col("pid") + F.col("number"))
    # Interpreted expressions over whole rings, each computed once: they don't fold into the struct below.
    placed = placed.withColumns({"box": bounds(F.col("rings")), "area": contour_area(F.col("rings"), F.col("roles"))})
    box = lambda part, name: F.col(f"box.{part}").alias(name)
    label_row = F.struct(
        F.col("label_index").alias("order"),
        F.struct(
            F.col("lid").alias("labelId"), F.lit("man").alias("labelType"), box("x", "labelPosX"), box("y", "labelPosY"), box("width", "labelWidth"), box("height", "labelHeight"), F.col("at").alias("labeledDate"),
            F.to_json(oriented(F.col("rings"), F.col("roles"))).alias("labelContour"), F.col("area").alias("contourSize"),
            codes.deterministic_uuid(F.concat(F.col("pid").cast("string"), F.lit(":label:"), F.col("lid").cast("string"))).alias("contourId"), F.col("class_name").alias("className"),
        ).alias("l"),
    )
    label_list = placed.groupBy("project_key", "file_index").agg(F.transform(F.array_sort(F.collect_list(label_row)), lambda r: r["l"]).alias("label_list"))
    none = F.array().cast(label_list.schema["label_list"].dataType)
    split = F.element_at(F.create_map(*[F.lit(x) for pair in codes.SPLITS_V2.items() for x in pair]), F.col("split"))
    rows = files.join(head, "project_key").join(label_list, ["project_key", "file_index"], "left").withColumn("label_list", F.coalesce("label_list", none))
    normal = is_seg & F.coalesce("is_normal", F.lit(False))
    file_row = F.struct(
        F.col("file_index").alias("order"),
        F.struct(
            F.col("pid").alias("projectId"), (F.col("pid") + FILE_IDS + F.col("file_index")).alias("fileId"), strip_quotes(F.col("source_path")).alias("filePath"), (normal | (F.size("label_list") > 0)).alias("isLabeled"),
            F.col("at").alias("modifiedDate"), F.col("at").alias("assignedDate"), F.col("dataset").alias("datasetName"), F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"),
            F.when(normal, OK_NAME).otherwise(F.try_element_at("label_list", F.lit(1))["className"]).alias("className"), F.col("label_list").alias("labelDataList"),
            F.when(is_seg, F.array(*[F.create_map().cast("map<string,string>")] * 3)).otherwise(F.array().cast("array<map<string,string>>")).alias("metadata"), F.col("at").alias("registeredDate"),
            F.array(F.struct((F.col("pid") + SPLIT_ID).alias("splitId"), F.lit(SPLIT_NAME).alias("splitName"), split.alias("splitType"))).alias("splitSets"),
        ).alias("f"),
    )
    file_list = rows.groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(file_row), lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)), lambda r: r["f"]).alias("file_list"), F.min_by(F.col("width"), "file_index").alias("stage_width"), F.min_by(F.col("height"), "file_index").alias("stage_height"))

    joined = good.join(class_list, "project_key", "left").join(file_list, "project_key", "left")
    element = class_list.schema["class_list"].dataType
    ok = F.array(F.struct(F.lit(0).cast("bigint").alias("classId"), F.lit(OK_NAME).alias("className"), F.lit(0).alias("classNo"), F.lit("").alias("description"), F.lit(OK_COLOR).alias("classColor"), F.lit(False).alias("isNg"))).cast(element)
    own = F.coalesce("class_list", F.array().cast(element))
    simple = F.col("roi_mode") == "simple"
    full = F.when(~is_seg, True).otherwise(simple)  # classification without a region has the whole image
    edge = lambda s, default: F.when(simple, F.col(f"roi_{s}")).when(~is_seg, F.lit(default)).cast("double")
    edges = [edge("left", 0.0), edge("top", 0.0), edge("right", 1.0), edge("bottom", 1.0)]
    custom = simple & ~((edges[0] == 0) & (edges[1] == 0) & (edges[2] == 1) & (edges[3] == 1))
    project = F.struct(
        F.col("pid").alias("projectId"), F.col("project_name").alias("projectName"), F.when(is_seg, "seg").otherwise("cls").alias("projectType"), F.coalesce("description", F.lit("")).alias("description") if "description" in projects.columns else F.lit("").alias("description"),
        F.when(full, "simple").otherwise("no").alias("roiMode"), edges[0].alias("roiPosX"), edges[1].alias("roiPosY"), edges[2].alias("roiWidth"), edges[3].alias("roiHeight"), F.when(full, "rectangle").alias("roiShapeType"),
        F.when(custom, _roi_shape(F.col("pid"), F.col("stage_width").cast("bigint"), F.col("stage_height").cast("bigint"), *edges)).alias("roiShape"),
        F.col("at").alias("modifiedDate"), F.col("at").alias("createdDate"), F.array().cast("array<string>").alias("metadataList"), F.when(is_seg, F.concat(ok, own)).otherwise(own).alias("classInfos"),
        F.array(F.struct(
            (F.col("pid") + DATASET_ID).alias("datasetId"), F.col("dataset").alias("datasetName"), F.lit("").alias("description"), F.col("at").alias("modifiedDate"), F.col("at").alias("createdDate"), F.lit("admin").alias("createdBy"), F.array().cast("array<string>").alias("projects"), F.array().cast("array<string>").alias("metadataList"),
            F.array(F.struct((F.col("pid") + SPLIT_ID).alias("splitId"), F.lit(SPLIT_NAME).alias("splitName"), F.col("at").alias("createdDate"))).alias("splitSets"),
        )).alias("datasets"),
        F.coalesce("file_list", F.array().cast(file_list.schema["file_list"].dataType)).alias("projectFiles"),
    )
    written = joined.select("project_key", F.to_json(F.struct(project.alias("project"))).alias("json"))
    return heads.select("project_key", "n_findings").join(written, "project_key", "left").select("project_key", "json", "n_findings")
