"""Joins of the engine: longest-suffix match, full-cover join, class references, bag difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bind
from ..functions.paths import SYSTEM_FILES, last_segment, path_key, segments, slash_form


def _suffixes(parts: Column) -> Column:
    """(depth, hash of the last ``depth`` segments) for every depth: 12 bytes each however long the path is."""
    def hashed(p: Column) -> Column:
        depths = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p))).otherwise(F.array().cast("array<int>"))
        return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.xxhash64(F.array_join(F.slice(p, -d, d), "/")).alias("suffix")))

    return bind(parts, hashed)


def suffix_match(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Longest common path suffix of references (scope, ref_id, path) with candidates (scope, cand_id, path).

    Result: ref_id, status, depth, candidate_count, cand_id. ``matched`` where
    one candidate shares the deepest suffix, ``ambiguous`` where several do,
    ``missing`` where none shares the file name, ``blank`` for null and blank
    paths. A candidate that two different paths match is taken from both
    (``ambiguous``, count 1). An equi-join on suffix hashes: only suffixes that
    references have take part, and candidates are counted before they meet.
    """
    keyed = lambda df, i: df.select("scope", i, path_key(F.col("path")).alias("key")).select("scope", i, "key", segments(F.col("key")).alias("parts"))
    refs = keyed(references, "ref_id")
    asked = refs.select("scope", "ref_id", F.explode(_suffixes(F.col("parts"))).alias("s")).select("scope", "ref_id", "s.*")
    offered = keyed(candidates, "cand_id").select("scope", "cand_id", F.explode(_suffixes(F.col("parts"))).alias("s")).select("scope", "cand_id", "s.*")
    counted = offered.groupBy("scope", "depth", "suffix").agg(F.count("*").alias("candidate_count"), F.min("cand_id").alias("cand_id"))
    best = asked.join(counted, ["scope", "depth", "suffix"]).groupBy("ref_id").agg(F.max_by(F.struct("depth", "candidate_count", "cand_id"), "depth").alias("b"))
    found = refs.join(best, "ref_id", "left")
    status = F.when(F.size("parts") <= 0, "blank").when(F.col("parts").isNull(), "blank").when(F.col("b").isNull(), "missing").when(F.col("b.candidate_count") > 1, "ambiguous").otherwise("matched")
    first = found.select("scope", "ref_id", "key", status.alias("status"), F.coalesce("b.depth", F.lit(0)).alias("depth"), F.coalesce("b.candidate_count", F.lit(0)).alias("candidate_count"), F.when(status == "matched", F.col("b.cand_id")).alias("cand_id"))
    shared = first.filter("cand_id is not null").groupBy("scope", "cand_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("scope", "cand_id", F.lit(True).alias("shared"))
    both = first.join(shared, ["scope", "cand_id"], "left")
    taken = F.coalesce("shared", F.lit(False))
    return both.select("scope", "ref_id", F.when(taken, "ambiguous").otherwise(F.col("status")).alias("status"), "depth", F.col("candidate_count").cast("bigint").alias("candidate_count"), F.when(~taken, F.col("cand_id")).alias("cand_id"))


def match_report(matches: DataFrame) -> DataFrame:
    """Totals by status for each scope, and whether all its references are matched."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return matches.groupBy("scope").agg(F.count("*").alias("total"), count("matched"), count("missing"), count("ambiguous"), count("blank")).withColumn("can_package", F.col("total") == F.col("matched"))


def full_cover(left: DataFrame, right: DataFrame, scope: str = "scope", key: str = "key") -> DataFrame:
    """Per scope: keys on both sides, on the left only (unmapped) and on the right only (unused)."""
    a, b = (df.select(scope, key).distinct() for df in (left, right))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), [scope, key], "full")
    return both.groupBy(scope).agg(F.count_if(F.expr("l is not null and r is not null")).alias("covered"), F.count_if(F.col("r").isNull()).alias("unmapped"), F.count_if(F.col("l").isNull()).alias("unused"))


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows differs: (keys, left_count, right_count). Equal bags give no row."""
    counts = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return counts.groupBy(*keys).agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count")).filter("left_count <> right_count")


def resolve_images(files: DataFrame, entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Where each file's image is: (scope, file_index, source, entry_name, cand_id, issue).

    ``files`` is (scope, file_index, kind, entry_name) with kind ``archive`` or
    ``external``, ``entries`` (scope, entry_name), ``matches`` the outcome of
    ``suffix_match`` by ref_id = file_index. Issues: ARCHIVE_ENTRY_MISSING,
    EXTERNAL_IMAGE_NOT_SELECTED, EXTERNAL_IMAGE_AMBIGUOUS; null where the image is there.
    """
    there = entries.select("scope", "entry_name").distinct().withColumn("__there", F.lit(True))
    chosen = matches.select("scope", F.col("ref_id").alias("file_index"), "status", "cand_id")
    both = files.join(there, ["scope", "entry_name"], "left").join(chosen, ["scope", "file_index"], "left")
    packed = F.col("kind") == "archive"
    issue = (
        F.when(packed & F.col("__there").isNull(), "ARCHIVE_ENTRY_MISSING")
        .when(~packed & (F.col("status") == "ambiguous"), "EXTERNAL_IMAGE_AMBIGUOUS")
        .when(~packed & ~F.coalesce(F.col("status") == "matched", F.lit(False)), "EXTERNAL_IMAGE_NOT_SELECTED")
    )
    return both.select("scope", "file_index", F.when(packed, "archive").otherwise("external").alias("source"), F.when(packed, F.col("entry_name")).alias("entry_name"), F.when(~packed, F.col("cand_id")).alias("cand_id"), issue.alias("issue"))


def merge_selections(selections: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of selections by name; of rows with the same key the one of the earliest selection stays. System files are left out."""
    numbered = [s.withColumn("__from", F.lit(i)) for i, s in enumerate(selections)]
    every = numbered[0]
    for other in numbered[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    columns = [c for c in every.columns if c != "__from"]
    if "path" in columns:
        every = every.filter(~F.coalesce(F.lower(last_segment(slash_form(F.col("path")))).isin(SYSTEM_FILES), F.lit(False)))
    kept = every.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("__from", *[c for c in columns if c != key])).alias("r"))
    return kept.select("r.*")


def resolve_class(labels: DataFrame) -> DataFrame:
    """Position of the class that a label's references name, of labels (…, class_infos, class_id, class_no, class_name).

    Each given reference must hit exactly one class and all hits must agree:
    ``class_state`` is ``ok``, ``absent`` (no reference), ``invalid`` (one hits
    none or several) or ``conflict``. Classes lie in the row, so no join.
    """
    def hits(test) -> Column:
        return F.filter(F.transform("class_infos", lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull())

    refs = [
        (F.col("class_id").isNotNull(), hits(lambda c: c["class_id"] == F.col("class_id"))),
        (F.col("class_no").isNotNull(), hits(lambda c: c["class_no"] == F.col("class_no"))),
        (F.trim("class_name") != "", hits(lambda c: F.lower(F.trim(c["class_name"])) == F.lower(F.trim(F.col("class_name"))))),
    ]
    given = F.filter(F.array(*[F.when(F.coalesce(has, F.lit(False)), F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(-1)) for has, found in refs]), lambda x: x.isNotNull())
    kinds = F.array_distinct(given)
    state = F.when(F.size(given) == 0, "absent").when(F.array_contains(given, -1), "invalid").when(F.size(kinds) > 1, "conflict").otherwise("ok")
    return labels.withColumns({"class_state": state, "class_index": F.when(state == "ok", F.get(kinds, F.lit(0))).otherwise(-1)})
