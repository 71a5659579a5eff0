"""Packages: V1 projects with their images and a manifest, and V2 projects with a JSON at the root.

A package is the listing of its entries (archive, entry_name, content), content
only where an entry holds text; see ``archives.read_archives``. Everything
below is joins and aggregates over entries of many packages at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import entry_problem, external_path, nfkc_lower

# Name of the manifest, fields that tell it from a project document, and limits.
MANIFEST, MANIFEST_FIELDS = "svpa_manifest.json", ["ProjectFile", "OriginalProjectDirectory", "Entries"]
MOST_ENTRIES, MOST_PATH_BYTES = 20_000, 4_096
SCHEMA = "ProjectFile string, OriginalProjectDirectory string, Entries array<struct<OriginalPath string, RelativePath string>>"


def entry_key(name: Column) -> Column:
    """Key under which two entries are the same: slashes alike, compatibility form, no letter case."""
    return nfkc_lower(F.translate(name, "\\", "/"))


def _text(content: Column) -> Column:
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")), "^\ufeff", "")


def _kind(value: Column, path: str) -> Column:
    """Kind of the JSON value at a path of a variant: OBJECT, ARRAY, STRING …; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^([A-Z]+)", 1)


def package_kinds(entries: DataFrame) -> DataFrame:
    """(archive, format, project_entry, code): v1-svpa if a manifest lies at the root, v2-visionproj if one JSON does; else why it is neither.

    A V2 document that is called like the manifest is no manifest.
    """
    keyed = entries.select("archive", "entry_name", entry_key(F.col("entry_name")).alias("key"), "content")
    document = F.try_parse_json(_text(F.col("content")))
    like_v2 = (_kind(document, "$.project") == "OBJECT") & ~F.coalesce(*[F.try_variant_get(document, f"$.{f}", "variant").isNotNull() & F.lit(True) for f in MANIFEST_FIELDS[:1]], F.lit(False))
    for field in MANIFEST_FIELDS[1:]:
        like_v2 &= F.try_variant_get(document, f"$.{field}", "variant").isNull()
    at_root = ~F.col("key").contains("/")
    sums = keyed.groupBy("archive").agg(
        F.max(F.when((F.col("key") == MANIFEST) & ~F.coalesce(like_v2, F.lit(False)), F.col("entry_name"))).alias("manifest"),
        F.count_if(at_root & F.col("key").endswith(".json")).alias("n_json"), F.max(F.when(at_root & F.col("key").endswith(".json"), F.col("entry_name"))).alias("json"),
    )
    svpa, vision = F.col("manifest").isNotNull(), F.col("n_json") == 1
    return sums.select(
        "archive", F.when(svpa, "v1-svpa").when(vision, "v2-visionproj").alias("format"), F.when(svpa, F.col("manifest")).when(vision, F.col("json")).alias("project_entry"),
        F.when(~svpa & ~vision, "VISION_PROJECT_JSON_COUNT_INVALID").alias("code"),
    )


def read_manifests(entries: DataFrame) -> DataFrame:
    """(archive, project_file, directory, items, code) of the manifest of each package; ``code`` is the first reason why it can't be used."""
    listing = entries.select("archive", entry_key(F.col("entry_name")).alias("key")).distinct()
    texts = entries.filter(entry_key(F.col("entry_name")) == MANIFEST).select("archive", _text(F.col("content")).alias("text"))
    parsed = texts.select("archive", F.try_parse_json("text").alias("v"), F.from_json("text", SCHEMA).alias("m"))
    project, folder = F.col("m.ProjectFile"), F.col("m.OriginalProjectDirectory")
    rows = parsed.withColumns({
        "root": F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1), "project_kind": _kind(F.col("v"), "$.ProjectFile"), "folder_kind": _kind(F.col("v"), "$.OriginalProjectDirectory"), "entries_kind": _kind(F.col("v"), "$.Entries"),
        "key": entry_key(project), "directory": F.when(F.coalesce(folder, F.lit("")) != "", external_path(folder, F.lit(None).cast("string"))),
    })
    held = rows.join(listing.withColumn("held", F.lit(True)), ["archive", "key"], "left")
    code = (
        F.when(F.col("v").isNull(), "SVPA_MANIFEST_JSON_INVALID").when(F.col("root") != "OBJECT", "SVPA_MANIFEST_ROOT_INVALID")
        .when((F.coalesce("project_kind", F.lit("")) != "STRING") | (F.trim(project) == ""), "SVPA_MANIFEST_FIELD_INVALID").when(entry_problem(project).isNotNull(), "SVPA_PROJECT_PATH_UNSAFE")
        .when(~F.lower(project).endswith(".srproj"), "SVPA_PROJECT_SUFFIX_INVALID").when(F.col("held").isNull(), "SVPA_PROJECT_MISSING")
        .when((F.coalesce("folder_kind", F.lit("STRING")) != "STRING") | (F.octet_length(folder) > MOST_PATH_BYTES) | ((F.coalesce(folder, F.lit("")) != "") & F.col("directory").isNull()), "SVPA_ORIGINAL_DIRECTORY_INVALID")
        .when(F.coalesce("entries_kind", F.lit("")) != "ARRAY", "SVPA_ENTRIES_INVALID").when(F.size("m.Entries") > MOST_ENTRIES, "SVPA_ENTRIES_TOO_MANY")
    )
    return held.select("archive", F.translate(project, "\\", "/").alias("project_file"), F.coalesce("directory", F.lit("")).alias("directory"), F.col("m.Entries").alias("items"), code.alias("code"))


def manifest_items(manifests: DataFrame) -> DataFrame:
    """(archive, position, original_path, relative_path, directory, project_file) of the manifests that can be used."""
    rows = manifests.filter("code is null").select("archive", "directory", "project_file", F.posexplode("items").alias("position", "e"))
    return rows.select("archive", "position", F.col("e.OriginalPath").alias("original_path"), F.col("e.RelativePath").alias("relative_path"), "directory", "project_file")


def external_key(path: Column, directory: Column) -> Column:
    """Key of a path outside the package, against the project's own folder; null where it has no meaning."""
    return F.lower(external_path(path, F.nullif(directory, F.lit(""))))


def item_findings(items: DataFrame, listing: DataFrame) -> DataFrame:
    """(archive, position, code): what stands against entries of manifests, the first reason each.

    ``listing`` is (archive, entry_name). Of entries with one original path
    the first stands; a later one is a duplicate, or a conflict if it points
    elsewhere. Groups are reduced to their first entry, never gathered.
    """
    keyed = items.withColumns({"original": external_key(F.col("original_path"), F.col("directory")), "relative": entry_key(F.col("relative_path")), "own": entry_key(F.col("project_file"))})
    first = keyed.groupBy("archive", "original").agg(F.min("position").alias("first"), F.min_by("relative", "position").alias("first_relative"))
    held = listing.select("archive", entry_key(F.col("entry_name")).alias("relative")).distinct().withColumn("held", F.lit(True))
    joined = keyed.join(first, ["archive", "original"], "left").join(held, ["archive", "relative"], "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    later = F.col("position") > F.col("first")
    code = (
        F.when(blank("original_path") | blank("relative_path"), "SVPA_MANIFEST_FIELD_INVALID").when(F.col("original").isNull(), "SVPA_ORIGINAL_PATH_INVALID").when(entry_problem(F.col("relative_path")).isNotNull(), "SVPA_RELATIVE_PATH_UNSAFE")
        .when(later & F.col("relative").eqNullSafe(F.col("first_relative")), "SVPA_ORIGINAL_PATH_DUPLICATE").when(later, "SVPA_ORIGINAL_PATH_CONFLICT")
        .when((F.col("relative") == F.col("own")) | (F.col("relative") == MANIFEST), "SVPA_IMAGE_REFERENCE_INVALID").when(F.col("held").isNull(), "SVPA_IMAGE_MISSING")
    )
    return joined.select("archive", "position", code.alias("code")).filter("code is not null")


def bind_images(files: DataFrame, items: DataFrame) -> DataFrame:
    """(archive, file_index, position, original_path, relative_path, code) of files (archive, file_index, source_path) and manifest entries.

    Files without an entry are SVPA_PROJECT_IMAGE_UNMAPPED; entries that no
    file refers to are SVPA_MANIFEST_ENTRY_UNUSED, with null file_index. Both
    sides meet by the path against the project's folder.
    """
    folders = items.groupBy("archive").agg(F.max("directory").alias("directory"))
    left = files.join(folders, "archive", "left").select("archive", "file_index", external_key(F.col("source_path"), F.coalesce("directory", F.lit(""))).alias("key"))
    right = items.withColumn("key", external_key(F.col("original_path"), F.col("directory"))).groupBy("archive", "key").agg(F.min(F.struct("position", "original_path", "relative_path")).alias("e"))
    joined = left.join(right, ["archive", "key"], "full")
    code = F.when(F.col("e").isNull(), "SVPA_PROJECT_IMAGE_UNMAPPED").when(F.col("file_index").isNull(), "SVPA_MANIFEST_ENTRY_UNUSED")
    return joined.select("archive", "file_index", "e.position", "e.original_path", "e.relative_path", code.alias("code"))
