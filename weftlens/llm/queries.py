"""Queries of the llm subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.functions.visual import form_sql
from weftlens.sources.tables import read_table

from .leak import find_leaks, leak_report
from .lookalike import alike_pairs, vocabulary
from .mixing import default_tokenizer, mix_report, mix_selection, with_token_counts
from .overlap import EVALUATION, TEST, TRAINING, VALIDATION, cross_split_overlaps, overlap_report, split_records
from .residue import residue_documents


def _files(spark: SparkSession, base: str) -> DataFrame:
    return split_records(read_table(spark, base, "project_files", "file_uid", "project_key", "dataset_name", "remark", "split_sets", "received_at"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    records = split_records(read_table(spark, base, "project_files", "file_uid", "remark", "split_sets", "received_at"))
    return cross_split_overlaps(records.select("id", "text", "is_train", "is_eval")).select(F.col("id_a").alias("file_uid_a"), F.col("id_b").alias("file_uid_b"))


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    """Overlapping evaluation records per split, project and dataset: similar ones, and those contained in longer training records."""
    report = overlap_report(_files(spark, base))
    return report.withColumn("most_contained", F.round("most_contained", 6))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    manifest = read_table(spark, base, "manifest_entries", "entry_id", "project_key", "original_path")
    references = read_table(spark, base, "image_references", "ref_id", "project_key", "normalized_path", "file_name")
    field = lambda df, table, i, name: df.select(F.struct(F.lit(table).alias("t"), F.col("project_key").alias("p")).alias("scope"), F.lit(name).alias("field_name"), F.col(i).alias("id"), F.col(name).alias("text")).filter("scope.p is not null")
    rows = field(manifest, "manifest_entries", "entry_id", "original_path").unionByName(field(references, "image_references", "ref_id", "normalized_path")).unionByName(field(references, "image_references", "ref_id", "file_name"))
    # Redelivered rows repeat their text: one row per id.
    rows = rows.groupBy("scope", "field_name", "id").agg(F.min("text").alias("text"))
    return alike_pairs(rows, vocabulary(rows, "text")).select("field_name", "id_a", "id_b")


def leaks(spark: SparkSession, base: str, least_score: int = 16) -> DataFrame:
    return find_leaks(read_table(spark, base, "eval_items", "item_id", "item_text"), read_table(spark, base, "documents", "doc_id", "text"), least_score=least_score)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs whose alignment scores as much as twelve words do, and holds them unbroken."""
    return leaks(spark, base, 24).filter("longest_run >= 12").select("item_id", "doc_id")


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    """Per test item: the documents that hold passages of it, edited copies included."""
    return leak_report(leaks(spark, base), read_table(spark, base, "eval_items", "item_id", "suite", "lang"))


def _mix(spark: SparkSession, base: str, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    tokenizer, pattern = default_tokenizer(spark)
    documents = with_token_counts(read_table(spark, base, "documents", "doc_id", "text", "source"), tokenizer, pattern)
    targets = read_table(spark, base, "mix_targets")
    return mix_selection(documents, targets, total_tokens), targets


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """Report of a mix as large as the listed sources together: large ones are drawn from, small ones repeated."""
    return mix_report(*_mix(spark, base))


def p9_selection(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p9_conservation(spark: SparkSession, base: str) -> DataFrame:
    """Per listed source what a mix must keep whatever it selects: known documents of that source once each, caps, and its quota unless the caps forbid it."""
    selection, targets = _mix(spark, base)
    documents = read_table(spark, base, "documents", F.col("doc_id"), F.col("source").alias("of")).distinct()
    joined = selection.join(documents, "doc_id", "left").join(targets.select("source", "max_repeats"), "source")
    kept = joined.groupBy("source").agg(F.bool_and(F.col("of").eqNullSafe(F.col("source"))).alias("own"), (F.count("*") == F.countDistinct("doc_id")).alias("once"), F.bool_and(F.col("repeats").between(1, F.col("max_repeats"))).alias("capped"))
    held = read_table(spark, base, "documents", "source", "text").filter("trim(text) <> ''").select("source").distinct().join(targets.select("source"), "source", "left_semi")
    return held.join(kept, "source", "left").fillna(False, ["own", "once", "capped"])


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return residue_documents(read_table(spark, base, "documents", "doc_id", "text")).select("doc_id")


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p7_found": p7_found, "p8_found": p8_found, "p8_report": p8_report, "p9_mix": p9_mix, "p9_selection": p9_selection, "p9_conservation": p9_conservation, "p10_found": p10_found}

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_RUNS = "select distinct {0}, array_to_string(w[k:k + {1}], ' ') as g from (select {0}, w, unnest(range(1, len(w) - {1} + 1)) as k from {2})"
_ROLE = r"len(list_filter(s, lambda x: regexp_replace(lower(x.split_type), '[\s_-]+', '', 'g') in ({0}))) > 0"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)

ORACLES: dict[str, str] = {
    "p5_found": f"""
with f as (select file_uid, any_value(remark) as t, any_value(split_sets) as s from project_files group by 1), r as (select file_uid, {_WORDS.format("t")} as w, {_ROLE.format(_IN(TRAINING))} as tr, {_ROLE.format(_IN(EVALUATION))} as ev from f where t is not null),
g as ({_RUNS.format("file_uid", 2, "r")}), n as (select file_uid, count(*) as n from g group by 1),
c as (select a.file_uid as x, b.file_uid as y, count(*) as c from g a join g b using (g) where a.file_uid < b.file_uid group by all)
select x as file_uid_a, y as file_uid_b from c join n a on a.file_uid = x join n b on b.file_uid = y join r p on p.file_uid = x join r q on q.file_uid = y where (p.tr and q.ev or p.ev and q.tr) and c.c >= 0.6 * (a.n + b.n - c.c) - 1e-9""",
    "p5_report": f"""
with f as (select file_uid, any_value(remark) as t, any_value(split_sets) as s, any_value(project_key) as project_key, any_value(dataset_name) as dataset_name from project_files group by 1),
r as (select *, {_WORDS.format("t")} as w, {_ROLE.format(_IN(TRAINING))} as tr, {_ROLE.format(_IN(EVALUATION))} as ev, list_filter([case when {_ROLE.format(_IN(VALIDATION))} then 'validation' end, case when {_ROLE.format(_IN(TEST))} then 'test' end], lambda x: x is not null) as splits from f where t is not null),
g as ({_RUNS.format("file_uid", 2, "r")}), n as (select file_uid, count(*) as n from g group by 1),
c as (select a.file_uid as x, b.file_uid as y, count(*) as c from g a join r p on p.file_uid = a.file_uid and p.ev join g b using (g) join r q on q.file_uid = b.file_uid and q.tr where a.file_uid <> b.file_uid group by all),
l as (select x, y, c.c / a.n as share from c join n a on a.file_uid = x join n b on b.file_uid = y where c.c >= 0.6 * (a.n + b.n - c.c) - 1e-9 or c.c >= 0.8 * a.n - 1e-9),
e as (select x, count(*) as n_pairs, max(share) as most from l group by 1)
select split, project_key, dataset_name, count(*) as n_records, sum(n_pairs)::bigint as n_pairs, round(max(most), 6) as most_contained from (select unnest(splits) as split, project_key, dataset_name, n_pairs, most from e join r on file_uid = x) group by all""",
    "p9_conservation": "select distinct source, true as own, true as once, true as capped from documents join mix_targets using (source) where trim(text) <> ''",
    "p7_found": f"""
with r as (select 'm' as t, project_key as p, 'original_path' as field_name, entry_id as id, min(original_path) as text from manifest_entries group by all union all select 'r', project_key, 'normalized_path', ref_id, min(normalized_path) from image_references group by all union all select 'r', project_key, 'file_name', ref_id, min(file_name) from image_references group by all),
{form_sql("select text from r")}, k as (select * from r join forms using (text) where p is not null)
select a.field_name, a.id as id_a, b.id as id_b from k a join k b on a.t = b.t and a.p = b.p and a.field_name = b.field_name and a.form = b.form where a.id < b.id and a.text <> b.text""",
    "p8_found": f"""
with i as (select item_id, {_WORDS.format("item_text")} as w from eval_items), d as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
ig as ({_RUNS.format("item_id", 11, "i")}), dg as ({_RUNS.format("doc_id", 11, "d")}) select distinct item_id, doc_id from ig join dg using (g)""",
}
