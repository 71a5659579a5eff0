"""Findings about V2 projects: references, geometry, states, splits and what V1 can't keep; and which outputs remain.

Projects are nested rows shaped like ``v2_inbox``. Every finding is a row
(project_key, code, disposition, path). Rules are expressions over the row of
the label, file or project that they are about: no join, no gathering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.geometry import is_full_box, is_full_contour
from .nested import read_rings

# Source formats and the outputs that are verified for them, the recommended one first.
OUTPUTS = {"v1-srproj": ["visionproj", "subvisionproj", "svpa-zip"], "v1-svpa": ["visionproj", "subvisionproj"], "v2-visionproj": ["svpa-zip"], "v2-subvisionproj": ["svpa-zip", "srproj"]}
# Losses of audit fields that nobody has to confirm.
ROUTINE_LOSSES = ["V2_FILE_METADATA_NOT_IN_V1", "V2_FILE_TIMESTAMP_NOT_IN_V1", "V2_LABEL_TIMESTAMP_NOT_IN_V1", "V2_SPLIT_NAME_NOT_IN_V1", "V2_DATASET_IDENTITY_NOT_IN_V1"]
SUPPORTED_TYPES = ["classification", "segmentation"]
RELATIVE_PATH = "V2_EXTERNAL_PATH_RELATIVE"

Rule = tuple[str, str, Column]


def _found(rows: DataFrame, rules: list[Rule], path: Column) -> DataFrame:
    """One row for each rule (code, disposition, test) that holds."""
    every = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(disposition).alias("disposition"))) for code, disposition, test in rules])
    return rows.select("project_key", F.explode(F.filter(every, lambda d: d.isNotNull())).alias("d"), path.alias("path")).select("project_key", "d.code", "d.disposition", "path")


def _places(infos: Column, test) -> Column:
    return F.filter(F.transform(infos, lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull())


def class_reference(infos: Column, class_id: Column | None, class_no: Column | None = None, class_name: Column | None = None) -> tuple[Column, list[Rule]]:
    """Position of the class that the given references agree on, null if they don't, and the rules that they break.

    A reference that isn't null must hit exactly one class. A class without a
    number has its position as one. Names compare without letter case and
    blanks around them.
    """
    given = []
    if class_id is not None:
        given.append(("V2_CLASS_ID_REFERENCE_INVALID", class_id.isNotNull(), _places(infos, lambda c: c["class_id"] == class_id)))
    if class_no is not None:
        numbered = F.filter(F.transform(infos, lambda c, i: F.when(F.coalesce(c["class_no"], i.cast("bigint")) == class_no, i)), lambda i: i.isNotNull())
        given.append(("V2_CLASS_NUMBER_REFERENCE_INVALID", class_no.isNotNull(), numbered))
    if class_name is not None:
        given.append(("V2_CLASS_NAME_REFERENCE_INVALID", class_name.isNotNull(), _places(infos, lambda c: (F.trim(class_name) != "") & (F.lower(F.trim(c["class_name"])) == F.lower(F.trim(class_name))))))
    bad = [(code, "block", has & (F.coalesce(F.size(hits), F.lit(0)) != 1)) for code, has, hits in given]
    places = F.filter(F.array(*[F.when(has & (F.size(hits) == 1), F.get(hits, F.lit(0))) for _, has, hits in given]), lambda x: x.isNotNull())
    wrong = F.coalesce(F.exists(F.array(*[b[2] for b in bad]), lambda x: x), F.lit(False))
    several = F.size(F.array_distinct(places)) > 1
    place = F.when(~wrong & ~several, F.get(places, F.lit(0)))
    return place, [*bad, ("V2_CLASS_REFERENCE_CONFLICT", "block", ~wrong & several)]


def normal_class(infos: Column) -> Column:
    """Position of the structural OK class of a segmentation project: number 0, named OK, not a defect, all others marked as defects; null if there is none."""
    numbers = F.array_sort(F.transform(infos, lambda c: c["class_no"]))
    whole = numbers == F.sequence(F.lit(0).cast("bigint"), F.size(infos).cast("bigint") - 1)
    is_ok = lambda c, i: F.coalesce((c["class_no"] == 0) & (F.lower(F.trim(c["class_name"])) == "ok") & ~c["is_ng"] & (whole | (i == 0)), F.lit(False))
    oks = F.filter(F.transform(infos, lambda c, i: F.when(is_ok(c, i), i)), lambda i: i.isNotNull())
    defects = F.size(F.filter(infos, lambda c: F.coalesce(c["is_ng"], F.lit(False))))
    return F.when((F.size(infos) > 0) & (F.size(oks) == 1) & (defects == F.size(infos) - 1), F.get(oks, F.lit(0)))


def _typed(inbox: DataFrame) -> DataFrame:
    return inbox.withColumn("kind", codes.mapped(F.col("project_type"), codes.PROJECT_TYPES))


def _has_box(label: Column) -> Column:
    return F.coalesce(*[label[c] for c in ("label_pos_x", "label_pos_y", "label_width", "label_height")]).isNotNull()


def label_findings(inbox: DataFrame) -> DataFrame:
    """What stands against single labels: class references, origin, geometry of their kind, and places outside the image."""
    files = _typed(inbox).select("project_key", "kind", "class_infos", F.posexplode("project_files").alias("i", "f"))
    labels = files.select("project_key", "kind", "class_infos", "i", F.col("f.width").alias("w"), F.col("f.height").alias("h"), F.posexplode("f.label_data_list").alias("j", "l")).filter("l is not null")
    label = F.col("l")
    _, references = class_reference(F.col("class_infos"), label["class_id"], label["class_no"], label["class_name"])
    absent = F.coalesce(label["class_id"].cast("string"), label["class_no"].cast("string"), label["class_name"]).isNull()
    rows = labels.withColumn("rings", read_rings(label["label_contour"]))
    rings, w, h = F.col("rings"), F.col("w"), F.col("h")
    boxed, x, y, bw, bh = _has_box(label), label["label_pos_x"], label["label_pos_y"], label["label_width"], label["label_height"]
    whole_box = x.isNotNull() & y.isNotNull() & (bw > 0) & (bh > 0)
    is_cls, is_seg = F.col("kind") == "classification", F.col("kind") == "segmentation"
    sized = w.isNotNull() & h.isNotNull()
    off_box = boxed & F.coalesce(whole_box, F.lit(False)) & ~is_full_box(x, y, bw, bh, w, h)
    one = F.size(rings) == 1
    off_contour = (F.size(rings) > 1) | (one & ~is_full_contour(F.get(rings, F.lit(0)), w, h))
    full = (boxed | label["label_contour"].isNotNull()) & (~boxed | is_full_box(x, y, bw, bh, w, h)) & (label["label_contour"].isNull() | F.coalesce(one & ~off_contour, F.lit(False)))
    outside = lambda p: (p[0] < 0) | (p[1] < 0) | (p[0] > w) | (p[1] > h)
    return _found(rows, [
        *references, ("V2_CLASS_REFERENCE_INVALID", "block", absent),
        ("V2_LABEL_ORIGIN_NOT_IN_V1", "drop", ~F.coalesce(codes.mapped(label["label_type"], codes.LABEL_ORIGINS) == "manual", F.lit(False))),
        ("V2_CLASSIFICATION_GEOMETRY_INVALID", "block", is_cls & boxed & ~F.coalesce(whole_box, F.lit(False))),
        ("V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1", "block", is_cls & (off_box | F.coalesce(off_contour, F.lit(False)))),
        ("V2_CLASSIFICATION_FULL_IMAGE_GEOMETRY", "preserve", is_cls & full),
        ("V2_LABEL_GEOMETRY_UNSUPPORTED", "block", is_seg & label["label_contour"].isNull()),
        ("V2_LABEL_OUT_OF_BOUNDS", "block", is_cls & sized & whole_box & ((x < 0) | (y < 0) | (x + bw > w) | (y + bh > h))),
        ("V2_CONTOUR_OUT_OF_BOUNDS", "block", sized & F.exists(rings, lambda r: F.exists(r, outside))),
    ], F.format_string("$.project.projectFiles[%d].labelDataList[%d]", "i", "j"))


def file_states(inbox: DataFrame) -> DataFrame:
    """(project_key, file_index, kind, n_labels, is_labeled, file_class, label_class, normal_class, state) of each file.

    ``state``: of segmentation files normal, defect, unlabeled or unknown; of
    classification files classified or unknown.
    """
    rows = _typed(inbox).select("project_key", "kind", "class_infos", normal_class(F.col("class_infos")).alias("normal_class"), F.posexplode("project_files").alias("file_index", "f")).filter("f is not null")
    infos, of_labels = F.col("class_infos"), F.filter(F.col("f.label_data_list"), lambda x: x.isNotNull())
    file_class, _ = class_reference(infos, F.col("f.class_id"))
    named = F.transform(of_labels, lambda x: class_reference(infos, x["class_id"], x["class_no"], x["class_name"])[0])
    bare = F.forall(of_labels, lambda x: ~_has_box(x) & x["label_contour"].isNull() & x["contour_size"].isNull())
    made = rows.select("project_key", "file_index", "kind", "normal_class", F.col("f.is_labeled").alias("is_labeled"), F.coalesce(F.size(of_labels), F.lit(0)).alias("n_labels"), file_class.alias("file_class"), F.coalesce(F.array_distinct(F.filter(named, lambda c: c.isNotNull())), F.array().cast("array<int>")).alias("label_classes"), F.coalesce(bare, F.lit(False)).alias("bare"))
    made = made.withColumn("label_class", F.when(F.size("label_classes") == 1, F.get("label_classes", F.lit(0))))
    normal, file = F.col("normal_class"), F.col("file_class")
    labeled = F.coalesce("is_labeled", F.lit(False))
    marker = (F.col("kind") == "segmentation") & (F.col("n_labels") == 1) & labeled & normal.isNotNull() & (F.col("label_class") == normal) & (file.isNull() | (file == normal)) & F.col("bare")
    made = made.withColumn("marker", F.coalesce(marker, F.lit(False)))
    segmentation = (
        F.when(F.col("marker"), "normal").when(F.col("n_labels") > 0, "defect").when(F.col("is_labeled") == False, "unlabeled").when(labeled & (file == normal), "normal").otherwise("unknown")  # noqa: E712
    )
    agreed = F.when(file.isNull() | F.col("label_class").isNull() | (file == F.col("label_class")), F.coalesce("label_class", file))
    classification = F.when(F.when(F.col("n_labels") == 0, file).otherwise(agreed).isNotNull(), "classified").otherwise("unknown")
    return made.withColumn("state", F.when(F.col("kind") == "segmentation", segmentation).when(F.col("kind") == "classification", classification))


def file_findings(inbox: DataFrame) -> DataFrame:
    """What stands against files: contradictory states and classes, and their split memberships."""
    s = file_states(inbox)
    is_cls, is_seg, labeled = F.col("kind") == "classification", F.col("kind") == "segmentation", F.col("is_labeled")
    n, file, label, normal = F.col("n_labels"), F.col("file_class"), F.col("label_class"), F.col("normal_class")
    at = F.format_string("$.project.projectFiles[%d]", "file_index")
    carries = F.array_contains("label_classes", normal) | F.coalesce(file == normal, F.lit(False))
    states = _found(s, [
        ("V2_CLASSIFICATION_CLASS_MISSING", "block", is_cls & (n == 0) & file.isNull()),
        ("V2_CLASSIFICATION_MULTIPLE_LABELS", "block", is_cls & (n > 1)),
        ("V2_CLASSIFICATION_CLASS_CONFLICT", "block", is_cls & (n > 0) & (file != label)),
        ("V2_CLASSIFICATION_STATE_CONFLICT", "block", is_cls & ~labeled & ((n > 0) | file.isNotNull())),
        ("V2_SEGMENTATION_LABEL_STATE_CONFLICT", "block", is_seg & ~F.col("marker") & (n > 0) & ~labeled),
        ("V2_SEGMENTATION_NORMAL_CLASS_CONTOUR_CONFLICT", "block", is_seg & ~F.col("marker") & (n > 0) & normal.isNotNull() & carries),
        ("V2_SEGMENTATION_UNLABELED_CLASS_CONFLICT", "block", is_seg & (n == 0) & ~labeled & file.isNotNull()),
        ("V2_SEGMENTATION_EMPTY_LABEL_STATE_AMBIGUOUS", "block", is_seg & (n == 0) & ~F.coalesce(~labeled, F.lit(False)) & ~F.coalesce(labeled & (file == normal), F.lit(False))),
    ], at)
    files = inbox.select("project_key", F.posexplode("project_files").alias("file_index", "f")).filter("f is not null")
    split = codes.canonical_split(F.transform("f.split_sets", lambda x: codes.split_type_v2(x["split_type"])))["state"]
    splits = files.select("project_key", "file_index", split.alias("split"))
    return states.unionByName(_found(splits, [("V2_SPLIT_MISSING", "block", F.col("split") == "missing"), ("V2_SPLIT_CONFLICT", "block", F.col("split") == "conflict"), ("V2_MULTIPLE_SPLIT_MEMBERSHIPS", "degrade", F.col("split") == "repeated")], at))


def project_findings(inbox: DataFrame) -> DataFrame:
    """What stands against whole projects, and what of theirs V1 drops or rebuilds: one row per kind of field, however many hold it."""
    rows = _typed(inbox)
    files = F.coalesce(F.filter("project_files", lambda f: f.isNotNull()), F.array().cast(inbox.schema["project_files"].dataType))
    of_labels = F.flatten(F.transform(files, lambda f: F.coalesce(F.filter(f["label_data_list"], lambda x: x.isNotNull()), F.array().cast(inbox.schema["project_files"].dataType.elementType["label_data_list"].dataType))))
    some = lambda column, test: F.coalesce(F.exists(column, test), F.lit(False))
    is_seg = F.col("kind") == "segmentation"
    normal = normal_class(F.col("class_infos"))
    split_names = some(files, lambda f: some(f["split_sets"], lambda s: F.coalesce(s["split_name"], F.lit("")) != "")) | some("datasets", lambda d: some(d["split_sets"], lambda s: F.coalesce(s["split_name"], F.lit("")) != ""))
    split_ids = some(files, lambda f: some(f["split_sets"], lambda s: s["split_id"].isNotNull())) | some("datasets", lambda d: some(d["split_sets"], lambda s: s["split_id"].isNotNull()))
    ids = some("class_infos", lambda c: c["class_id"].isNotNull()) | some("datasets", lambda d: d["dataset_id"].isNotNull()) | some(files, lambda f: f["file_id"].isNotNull()) | some(of_labels, lambda x: x["label_id"].isNotNull())
    return _found(rows, [
        ("V2_PROJECT_TYPE_UNSUPPORTED", "block", ~F.coalesce(F.col("kind").isin(SUPPORTED_TYPES), F.lit(False))),
        ("V2_SEGMENTATION_CLASS_STRUCTURE_INVALID", "block", is_seg & normal.isNull()),
        ("V2_SEGMENTATION_OK_CLASS_RECOGNIZED", "rebuild", is_seg & normal.isNotNull()),
        ("V2_FILE_METADATA_NOT_IN_V1", "drop", some(files, lambda f: F.size(f["metadata"]) > 0)),
        ("V2_FILE_TIMESTAMP_NOT_IN_V1", "drop", some(files, lambda f: f["registered_date"].isNotNull())),
        ("V2_LABEL_TIMESTAMP_NOT_IN_V1", "drop", some(of_labels, lambda x: x["labeled_date"].isNotNull())),
        ("V2_CONTOUR_SIZE_REBUILT", "rebuild", some(of_labels, lambda x: x["contour_size"].isNotNull())),
        ("V2_SEGMENTATION_BOUNDS_REBUILT", "rebuild", is_seg & some(of_labels, lambda x: _has_box(x) & x["label_contour"].isNotNull())),
        ("V2_SPLIT_NAME_NOT_IN_V1", "drop", split_names), ("V2_SPLIT_ID_REBUILT", "rebuild", split_ids),
        ("V2_DATASET_IDENTITY_NOT_IN_V1", "drop", F.coalesce(F.size("datasets"), F.lit(0)) > 0), ("V2_ENTITY_IDS_REBUILT", "rebuild", ids),
    ], F.lit("$.project"))


def findings(inbox: DataFrame) -> DataFrame:
    """All findings (project_key, code, disposition, path) of V2 projects; redelivered ones must have been settled before."""
    return label_findings(inbox).unionByName(file_findings(inbox)).unionByName(project_findings(inbox))


def target_readiness(projects: DataFrame, found: DataFrame) -> DataFrame:
    """(project_key, target, n_block, n_loss, confirmation) for each output that the project's source format and type allow.

    ``projects`` is (project_key, source_format, project_type). Routine losses
    need no confirmation; a relative path is none of a package. ``confirmation``:
    none, loss, relative-path or mixed. Findings are reduced to counts of
    their project before the join.
    """
    table = F.create_map(*[x for k, v in OUTPUTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = projects.filter(F.col("project_type").isin(SUPPORTED_TYPES)).select("project_key", F.explode(F.element_at(table, F.col("source_format"))).alias("target"))
    asked = F.col("disposition").isin("drop", "degrade") & ~F.col("code").isin(ROUTINE_LOSSES)
    relative = F.col("code") == RELATIVE_PATH
    counts = found.groupBy("project_key").agg(F.count_if((F.col("disposition") == "block") & ~relative).alias("__block"), F.count_if((F.col("disposition") == "block") & relative).alias("__block_path"), F.count_if(asked & ~relative).alias("n_loss"), F.count_if(asked & relative).alias("__path"))
    joined = allowed.join(counts, "project_key", "left").fillna(0)
    package = F.col("target") == "svpa-zip"
    paths = F.when(package, F.lit(0)).otherwise(F.col("__path"))
    mode = F.when((F.col("n_loss") == 0) & (paths == 0), "none").when(paths == 0, "loss").when(F.col("n_loss") > 0, "mixed").otherwise("relative-path")
    return joined.select("project_key", "target", (F.col("__block") + F.when(package, F.lit(0)).otherwise(F.col("__block_path"))).alias("n_block"), "n_loss", mode.alias("confirmation"))
