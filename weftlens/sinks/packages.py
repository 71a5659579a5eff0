"""Packages to be written: plans with their limits, entry names, manifests, and the entries themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import entry_problem, fit_utf8, last_segment, normalize_path, path_key, safe_file_name
from ..operators.naming import unique_names
from ..sources.archives import MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_NAME_BYTES, MOST_NAMES_BYTES, MOST_TOTAL_BYTES
from ..sources.packages import MANIFEST, entry_key

# Entries besides images, and bytes that an archive has for each entry and for itself.
FIXED_ENTRIES = {"vision": 1, "svpa": 4}
ENTRY_OVERHEAD, BASE_OVERHEAD = 512, 65_536
STEM_BYTES = 180
PROJECT_FOLDER, IMAGE_FOLDER, README = "project", "images", "README.txt"


def package_plan(images: DataFrame, scope: str, kind: str, text_bytes: Column | None = None) -> DataFrame:
    """Per scope of images (scope, entry_name, size): entries, bytes, bytes of names, the estimated size, whether it needs ZIP64, and the first limit exceeded.

    One aggregate by entry key, then one by scope: a scope that holds a third
    of all images is reduced before it meets.
    """
    rows = images.withColumns({"__key": entry_key(F.col("entry_name")), "__bad": entry_problem(F.col("entry_name")).isNotNull()})
    names = rows.groupBy(scope, "__key").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.max("size").alias("largest"), F.sum(F.octet_length("entry_name")).alias("name_bytes"), F.max(F.octet_length("entry_name")).alias("longest"), F.bool_or("__bad").alias("bad"))
    sums = names.groupBy(scope).agg((F.sum("n") + FIXED_ENTRIES[kind]).alias("n_entries"), F.sum("bytes").alias("n_bytes"), F.sum("name_bytes").alias("n_name_bytes"), F.max("largest").alias("__largest"), F.max("longest").alias("__longest"), F.bool_or("bad").alias("__bad"), F.bool_or(F.col("n") > 1).alias("__twice"))
    estimate = F.col("n_bytes") + F.col("n_entries") * ENTRY_OVERHEAD + F.col("n_name_bytes") * 2 + BASE_OVERHEAD
    code = (
        F.when(F.col("n_entries") > MOST_ENTRIES, "OUTPUT_ARCHIVE_ENTRY_LIMIT_EXCEEDED").when(F.col("__bad"), "OUTPUT_ARCHIVE_ENTRY_PATH_UNSAFE").when(F.col("__longest") > MOST_NAME_BYTES, "OUTPUT_ARCHIVE_ENTRY_NAME_LIMIT_EXCEEDED")
        .when(F.col("n_name_bytes") > MOST_NAMES_BYTES, "OUTPUT_ARCHIVE_ENTRY_NAMES_TOTAL_LIMIT_EXCEEDED").when(F.col("__twice"), "OUTPUT_ARCHIVE_ENTRY_DUPLICATE").when(F.col("__largest") > MOST_ENTRY_BYTES, "OUTPUT_ARCHIVE_ENTRY_SIZE_LIMIT_EXCEEDED").when(F.col("n_bytes") > MOST_TOTAL_BYTES, "OUTPUT_ARCHIVE_TOTAL_SIZE_LIMIT_EXCEEDED")
    )
    planned = sums.withColumn("estimated_bytes", estimate)
    return planned.select(scope, "n_entries", "n_bytes", "n_name_bytes", "estimated_bytes", ((F.col("estimated_bytes") >= 0xFFFFFFFF) | (F.col("n_entries") >= 0xFFFF)).alias("zip64"), code.alias("limit_code"))


def image_names(files: DataFrame, scope: str) -> DataFrame:
    """``files`` (scope, file_index, file_name, source_path) with ``entry_name``: a safe name below the image folder, unique in its package."""
    wanted = F.coalesce(F.nullif(last_segment(normalize_path(F.col("file_name"))), F.lit("")), F.nullif(last_segment(normalize_path(F.col("source_path"))), F.lit("")), F.format_string("image_%d", F.col("file_index") + 1))
    named = files.withColumn("__wanted", F.concat(F.lit(f"{IMAGE_FOLDER}/"), safe_file_name(wanted)))
    return unique_names(named, scope, "__wanted", ["file_index"], "entry_name").drop("__wanted")


def output_stem(name: Column) -> Column:
    """File name of a project without suffix: safe, at most 180 bytes, never empty."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"/\\|?*]', "_"), r"[ .]+$", ""))
    named = F.when(F.coalesce(clean, F.lit("")) == "", "project").when(clean.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])([ .]|$)"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return fit_utf8(named, STEM_BYTES)


def equal_contents(images: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Keys whose images aren't all the same bytes: (keys, n_rows, n_contents), by length and SHA-256, never byte for byte across rows."""
    digests = images.groupBy(*keys, F.octet_length(content).alias("__n"), F.sha2(F.col(content), 256).alias("__h")).agg(F.count("*").alias("__rows"))
    return digests.groupBy(*keys).agg(F.sum("__rows").alias("n_rows"), F.count("*").alias("n_contents")).filter("n_contents > 1")


def svpa_entries(projects: DataFrame, images: DataFrame, directory: str = "") -> DataFrame:
    """(archive, entry_name, content, ordinal) of V1 packages, ready for ``write_archives``.

    ``projects`` is (project_key, project_name, xml), ``images`` (project_key,
    file_index, source_path, file_name, content). Files with one original path
    share one entry, the first's. The manifest lists them in order. Projects
    without text have no package.
    """
    heads = projects.filter("xml is not null").select("project_key", "xml", output_stem(F.col("project_name")).alias("stem"))
    heads = heads.withColumns({"archive": F.concat(F.col("project_key").cast("string"), F.lit("/"), F.col("stem"), F.lit(".zip")), "entry": F.concat(F.lit(f"{PROJECT_FOLDER}/"), F.col("stem"), F.lit(".srproj"))})
    single = images.withColumn("__path", path_key(F.col("source_path"))).groupBy("project_key", "__path").agg(F.min_by(F.struct("file_index", "source_path", "file_name", "content"), "file_index").alias("r")).select("project_key", "r.*")
    named = image_names(single, "project_key").join(heads.select("project_key", "archive"), "project_key")
    listed = named.groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_index", F.col("source_path").alias("OriginalPath"), F.col("entry_name").alias("RelativePath")))), lambda e: F.struct(e["OriginalPath"].alias("OriginalPath"), e["RelativePath"].alias("RelativePath"))).alias("items"))
    manifest = F.to_json(F.struct(F.lit(1).alias("SchemaVersion"), F.lit("weftlens").alias("Generator"), F.col("entry").alias("ProjectFile"), F.lit(directory).alias("OriginalProjectDirectory"), F.coalesce("items", F.array().cast(listed.schema["items"].dataType)).alias("Entries")))
    readme = F.concat(F.lit("Unpack all of this archive, then open "), F.col("entry"), F.lit(".\r\n"))
    whole = heads.join(listed, "project_key", "left")
    texts = whole.select("archive", F.explode(F.array(*[F.struct(n.alias("entry_name"), F.encode(c, "UTF-8").alias("content"), F.lit(o).cast("long").alias("ordinal")) for o, n, c in ((-3, F.col("entry"), F.col("xml")), (-2, F.lit(MANIFEST), manifest), (-1, F.lit(README), readme))])).alias("e")).select("archive", "e.*")
    return texts.unionByName(named.select("archive", "entry_name", "content", F.col("file_index").cast("long").alias("ordinal")))


def vision_entries(projects: DataFrame, images: DataFrame) -> DataFrame:
    """(archive, entry_name, content, ordinal) of V2 packages: the project's JSON at the root, then its images.

    ``projects`` is (project_key, project_name, json), ``images`` as in
    ``svpa_entries``; every file has an entry of its own.
    """
    heads = projects.filter("json is not null").select("project_key", "json", output_stem(F.col("project_name")).alias("stem"))
    heads = heads.withColumn("archive", F.concat(F.col("project_key").cast("string"), F.lit("/"), F.col("stem"), F.lit(".visionproj")))
    named = image_names(images, "project_key").join(heads.select("project_key", "archive"), "project_key")
    texts = heads.select("archive", F.concat("stem", F.lit(".json")).alias("entry_name"), F.encode("json", "UTF-8").alias("content"), F.lit(-1).cast("long").alias("ordinal"))
    return texts.unionByName(named.select("archive", "entry_name", "content", F.col("file_index").cast("long").alias("ordinal")))
