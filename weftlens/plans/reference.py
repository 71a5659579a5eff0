"""Queries over the engine's own operators, each on its whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, geometry, paths
from ..functions.visual import compatible_characters, form_sql
from ..operators import diagnostics as diag
from ..operators.matching import bag_difference, full_cover, match_report, resolve_class, suffix_match
from ..operators.naming import reindex, running_ids, unique_names
from ..operators.nested import flatten_inbox, flatten_tables, read_rings
from ..sinks.projects import write_v1, write_v2
from ..sources import v1_xml, v2_json
from ..sources.archives import archive_summary
from ..sources.tables import first_arrivals, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL twin if there is one."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- paths

def _sql_path(column: str) -> str:
    """SQL of ``paths.normalize_path``."""
    edge = r"[\s\x{00A0}\x{FEFF}]"
    trimmed = f"regexp_replace({column}, '^{edge}+|{edge}+$', '', 'g')"
    bare = f"(case when length({trimmed}) > 1 and ((starts_with({trimmed}, '\"') and ends_with({trimmed}, '\"')) or (starts_with({trimmed}, '''') and ends_with({trimmed}, ''''))) then regexp_replace(substr({trimmed}, 2, length({trimmed}) - 2), '^{edge}+|{edge}+$', '', 'g') else {trimmed} end)"
    bare = f"nfc_normalize({bare})"
    plain = f"regexp_replace({bare}, '^(?i)file://', '')"
    plain = f"(case when regexp_matches({bare}, '^(?i)file://') and regexp_matches({plain}, '^(?i)/[a-z]:[\\\\/]') then substr({plain}, 2) else {plain} end)"
    one = f"regexp_replace(replace({plain}, '\\', '/'), '/{{2,}}', '/', 'g')"
    return f"(case when length({one}) > 1 then regexp_replace({one}, '/+$', '') else {one} end)"


_REFS = f"(select distinct project_key as scope, entry_id as ref_id, lower({_sql_path('original_path')}) as key from manifest_entries)"
_CANDS = f"(select distinct project_key as scope, file_uid as cand_id, lower({_sql_path('source_path')}) as key from project_files)"
_PARTS = "list_filter(string_split(key, '/'), lambda s: s <> '' and s <> '.')"
_MATCH = f"""
with r as (select *, {_PARTS} as parts from {_REFS}), c as (select *, {_PARTS} as parts from {_CANDS}),
rs as (select scope, ref_id, d, array_to_string(parts[len(parts) - d + 1:], '/') as suffix from (select *, unnest(range(1, len(parts) + 1)) as d from r)),
cs as (select scope, d, suffix, count(*) as n, min(cand_id) as cand_id from (select scope, cand_id, d, array_to_string(parts[len(parts) - d + 1:], '/') as suffix from (select *, unnest(range(1, len(parts) + 1)) as d from c)) group by all),
best as (select rs.ref_id, max(rs.d) as depth, arg_max(cs.n, rs.d) as n, arg_max(cs.cand_id, rs.d) as cand_id from rs join cs using (scope, d, suffix) group by 1),
f as (select r.scope, r.ref_id, r.key, case when len(parts) = 0 or parts is null then 'blank' when best.n is null then 'missing' when best.n > 1 then 'ambiguous' else 'matched' end as status, coalesce(depth, 0) as depth, coalesce(n, 0) as candidate_count, case when n = 1 then cand_id end as cand_id from r left join best using (ref_id)),
shared as (select scope, cand_id from f where cand_id is not null group by all having min(key) <> max(key)),
m as (select f.scope, f.ref_id, case when s.cand_id is not null then 'ambiguous' else status end as status, depth, candidate_count, case when s.cand_id is null then f.cand_id end as cand_id from f left join shared s using (scope, cand_id))
"""


@query(f"select entry_id, {_sql_path('original_path')} as normal_path from manifest_entries")
def path_normalize(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "manifest_entries").select("entry_id", paths.normalize_path(F.col("original_path")).alias("normal_path"))


@query(f"select scope as project_key, count(*) as n_paths, count(*) - count(distinct key) as n_repeated from {_REFS} group by 1")
def path_key_duplicates(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "manifest_entries", "project_key", "entry_id", "original_path").distinct()
    return rows.groupBy("project_key").agg(F.count("*").alias("n_paths"), (F.count("*") - F.countDistinct(paths.path_key(F.col("original_path")))).alias("n_repeated"))


def _matches(spark: SparkSession, base: str) -> DataFrame:
    refs = read_table(spark, base, "manifest_entries").select(F.col("project_key").alias("scope"), F.col("entry_id").alias("ref_id"), F.col("original_path").alias("path")).distinct()
    cands = read_table(spark, base, "project_files").select(F.col("project_key").alias("scope"), F.col("file_uid").alias("cand_id"), F.col("source_path").alias("path")).distinct()
    return suffix_match(refs, cands)


@query(_MATCH + "select ref_id, status, depth::int as depth, candidate_count, cand_id from m")
def suffix_matches(spark: SparkSession, base: str) -> DataFrame:
    return _matches(spark, base).drop("scope")


@query(_MATCH + "select scope as project_key, count(*) as total, count_if(status = 'matched') as matched, count_if(status = 'missing') as missing, count_if(status = 'ambiguous') as ambiguous, count_if(status = 'blank') as blank, count(*) = count_if(status = 'matched') as can_package from m group by 1")
def match_totals(spark: SparkSession, base: str) -> DataFrame:
    return match_report(_matches(spark, base)).withColumnRenamed("scope", "project_key")


@query(r"""
with e as (select project_key, entry_name, replace(entry_name, '\', '/') as p, list_filter(string_split(replace(entry_name, '\', '/'), '/'), lambda s: s <> '') as parts from archive_entries)
select project_key, entry_name, case when entry_name is null or trim(entry_name) = '' then 'empty' when regexp_matches(entry_name, '[\x00-\x1f\x7f]') then 'control-character' when starts_with(p, '/') then 'absolute'
 when regexp_matches(p, '^[A-Za-z]:') then 'drive-path' when len(parts) = 0 then 'empty' when len(list_filter(parts, lambda s: s in ('.', '..'))) > 0 then 'traversal'
 when len(list_filter(parts, lambda s: regexp_matches(s, '[<>:"|?*]') or ends_with(s, ' ') or ends_with(s, '.'))) > 0 then 'invalid-character'
 when len(list_filter(parts, lambda s: regexp_matches(s, '^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])([ .]|$)'))) > 0 then 'reserved-name'
 when len(list_filter(parts, lambda s: strlen(s) > 255)) > 0 then 'segment-too-long' end as problem from e""")
def entry_safety(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "archive_entries", "project_key", "entry_name")
    return rows.select("project_key", "entry_name", paths.entry_problem(F.col("entry_name")).alias("problem"))


@query(rf"""
with {form_sql("select entry_name as text from archive_entries", compatible_characters())},
e as (select distinct project_key, entry_name, compressed_size as c, uncompressed_size as u, is_dir, unix_mode from archive_entries),
p as (select *, replace(entry_name, '\', '/') as n, list_filter(string_split(replace(entry_name, '\', '/'), '/'), lambda s: s <> '') as parts from e),
k as (select p.*, lower(form) as key, coalesce(strlen(entry_name) > 4096, false) or coalesce((unix_mode & 61440) = 40960, false) or coalesce(is_dir and u > 0, false) or coalesce(u > 4294967296, false) or coalesce(u > 0 and u > c * 200, false) or trim(entry_name) = '' or regexp_matches(entry_name, '[\x00-\x1f\x7f]') or starts_with(n, '/') or regexp_matches(n, '^[A-Za-z]:') or len(parts) = 0
 or len(list_filter(parts, lambda s: s in ('.', '..') or regexp_matches(s, '[<>:"|?*]') or ends_with(s, ' ') or ends_with(s, '.') or regexp_matches(s, '^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])([ .]|$)') or strlen(s) > 255)) > 0 as bad from p left join forms on text = entry_name)
select project_key, count(*) as n_entries, sum(u)::bigint as n_bytes, sum(strlen(entry_name))::bigint as n_name_bytes, count_if(bad)::bigint as n_unsafe, count(*) - count(distinct key) as n_duplicates, case when count(*) > 20000 then 'ZIP_TOO_MANY_ENTRIES' when sum(strlen(entry_name)) > 8388608 then 'ZIP_TOTAL_NAMES_TOO_LONG' when sum(u) > 34359738368 then 'ZIP_TOTAL_TOO_LARGE' end as limit_code from k group by 1""")
def archive_limits(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "archive_entries").select("project_key", "entry_name", "compressed_size", "uncompressed_size", "is_dir", "unix_mode").distinct()
    return archive_summary(rows, "project_key")


@query(f"select distinct entry_id, list_filter(string_split({_sql_path('original_path')}, '/'), lambda s: s <> '' and s <> '.')[-1] as file_name, lower(regexp_extract(original_path, '\\.([A-Za-z0-9]+)$', 1)) as suffix from manifest_entries")
def path_parts(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "manifest_entries")
    return rows.select("entry_id", paths.last_segment(paths.normalize_path(F.col("original_path"))).alias("file_name"), F.lower(F.regexp_extract("original_path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix")).distinct()


# ---- joins and sets

@query(f"""
with l as (select distinct project_key, lower({_sql_path('relative_path')}) as key from manifest_entries), r as (select distinct project_key, lower({_sql_path('entry_name')}) as key from archive_entries)
select project_key, count_if(l.key is not null and r.key is not null) as covered, count_if(r.key is null) as unmapped, count_if(l.key is null) as unused from l full join r using (project_key, key) group by 1""".replace("l.key", "lk").replace("r.key", "rk").replace("as key from manifest", "as key, 1 as lk from manifest").replace("as key from archive", "as key, 1 as rk from archive"))
def manifest_cover(spark: SparkSession, base: str) -> DataFrame:
    keyed = lambda table, path: read_table(spark, base, table).select("project_key", paths.path_key(F.col(path)).alias("key"))
    return full_cover(keyed("manifest_entries", "relative_path"), keyed("archive_entries", "entry_name"), "project_key")


@query("select project_key, name, sum(l)::bigint as left_count, sum(r)::bigint as right_count from (select project_key, relative_path as name, 1 as l, 0 as r from manifest_entries union all select project_key, entry_name, 0, 1 from archive_entries) group by all having sum(l) <> sum(r)")
def listing_difference(spark: SparkSession, base: str) -> DataFrame:
    left = read_table(spark, base, "manifest_entries").select("project_key", F.col("relative_path").alias("name"))
    right = read_table(spark, base, "archive_entries").select("project_key", F.col("entry_name").alias("name"))
    return bag_difference(left, right, ["project_key", "name"])


@query("select feed_id, project_id, count(*) as n_rows, count(distinct payload) as n_values from raw_exports where project_id is not null group by all having count(distinct payload) > 1")
def entry_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Records of a feed that were exported with different contents."""
    return diag.group_conflicts(read_table(spark, base, "raw_exports", "feed_id", "project_id", "payload").filter("project_id is not null"), ["feed_id", "project_id"], "payload")


_INBOX = "(select project_key, any_value(class_infos) as class_infos, any_value(project_files) as project_files from v2_inbox group by 1)"


@query(f"""
with l as (select project_key, class_infos as ci, unnest(flatten(list_transform(project_files, lambda f: f.label_data_list))) as l from {_INBOX}),
h as (select project_key, case when l.class_id is null then null else list_filter(range(1, len(ci) + 1), lambda i: ci[i].class_id = l.class_id) end as a, case when l.class_no is null then null else list_filter(range(1, len(ci) + 1), lambda i: ci[i].class_no = l.class_no) end as b,
 case when l.class_name is null or trim(l.class_name) = '' then null else list_filter(range(1, len(ci) + 1), lambda i: lower(trim(ci[i].class_name)) = lower(trim(l.class_name))) end as c, l.class_id is not null as ha, l.class_no is not null as hb, coalesce(trim(l.class_name), '') <> '' as hc from l),
g as (select project_key, list_filter([case when ha then case when len(a) = 1 then a[1] - 1 else -1 end end, case when hb then case when len(b) = 1 then b[1] - 1 else -1 end end, case when hc then case when len(c) = 1 then c[1] - 1 else -1 end end], lambda x: x is not null) as given from h)
select project_key, case when len(given) = 0 then 'absent' when list_contains(given, -1) then 'invalid' when len(list_distinct(given)) > 1 then 'conflict' else 'ok' end as class_state, count(*) as n from g group by all""")
def class_references(spark: SparkSession, base: str) -> DataFrame:
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "class_infos", "project_files", "received_at"), "project_key")
    labels = inbox.select("project_key", "class_infos", F.explode(F.flatten(F.transform("project_files", lambda f: F.coalesce(f["label_data_list"], F.array())))).alias("l")).select("project_key", "class_infos", "l.class_id", "l.class_no", "l.class_name")
    return resolve_class(labels).groupBy("project_key", "class_state").agg(F.count("*").alias("n"))


# ---- indexes and names

@query("""
with c as (select distinct project_key, class_index, class_name from project_classes where deleted_at is null), r as (select *, row_number() over (partition by project_key order by class_index nulls last, class_name) - 1 as rank from c)
select project_key, class_index, class_name, (case when min((coalesce(rank = class_index, false))::int) over (partition by project_key) = 1 then class_index else rank end)::int as new_index from r""")
def class_reindex(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "project_classes").filter("deleted_at is null").select("project_key", "class_index", "class_name").distinct()
    return reindex(rows, "project_key", "class_index", ["class_index", "class_name"])


@query("select project_key, min(file_index) as low, max(file_index) as high, count(file_index) as n, count(distinct file_index) as n_distinct, min(file_index) = 0 and max(file_index) = count(file_index) - 1 and count(file_index) = count(distinct file_index) as is_contiguous from (select distinct project_key, file_uid, file_index from project_files) group by 1")
def index_check(spark: SparkSession, base: str) -> DataFrame:
    return diag.contiguous(read_table(spark, base, "project_files", "project_key", "file_uid", "file_index").distinct(), "project_key", "file_index")


@query("select project_key, label_uid, (200000 + row_number() over (partition by project_key order by file_index, label_index, label_uid) - 1)::bigint as label_id from (select distinct project_key, label_uid, file_index, label_index from project_labels)")
def label_ids(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "project_labels", "project_key", "label_uid", "file_index", "label_index").distinct()
    return running_ids(rows, "project_key", ["file_index", "label_index", "label_uid"], F.lit(200000).cast("bigint"), "label_id").select("project_key", "label_uid", F.col("label_id").cast("bigint").alias("label_id"))


@query()
def unique_file_names(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "project_files", "project_key", "file_uid", "file_index", "file_name").distinct()
    return unique_names(rows, "project_key", "file_name", ["file_index", "file_uid"]).select("project_key", "file_uid", "unique_name")


_FNV = "list_reduce([2166136261::bigint] || list_transform(string_split({0}, ''), lambda c: ord(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"select project_key, {_FNV.format('project_name')} as hash, 100000 + {_FNV.format('project_name')} % 700000 as number from (select distinct project_key, project_name from projects where project_name <> '')")
def name_hashes(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "projects", "project_key", "project_name").distinct().filter("project_name <> ''")
    return rows.select("project_key", codes.fnv1a(F.col("project_name")).alias("hash"), codes.project_number(F.col("project_name")).alias("number"))


_HEX = " || ".join("lpad(lower(to_hex(" + _FNV.format(f"('{s}:' || project_name)") + ")), 8, '0')" for s in "abcd")


@query(f"select project_key, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] as uuid from (select project_key, {_HEX} as h from (select distinct project_key, project_name from projects where project_name <> ''))")
def name_uuids(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "projects", "project_key", "project_name").distinct().filter("project_name <> ''")
    return rows.select("project_key", codes.deterministic_uuid(F.col("project_name")).alias("uuid"))


# ---- enumerations, colours, dates, text

_TYPES = "case lower(trim(project_type)) " + " ".join(f"when '{a}' then '{b}'" for a, b in codes.PROJECT_TYPES.items()) + " else case when project_type is not null then 'unknown' end end"


@query(f"select {_TYPES} as type, count(*) as n from projects group by 1")
def project_types(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "projects").groupBy(codes.mapped(F.col("project_type"), codes.PROJECT_TYPES).alias("type")).agg(F.count("*").alias("n"))


_SPLIT = "case when lower(trim(s.split_type)) in ('train', 'training') then 'training' when lower(trim(s.split_type)) in ('val', 'valid', 'validation') then 'validation' when lower(trim(s.split_type)) in ('unassigned', 'not-split', 'not_split') then 'unassigned' else 'unknown' end"
_SPLITS = f"""with f as (select distinct file_uid, project_key, split_sets from project_files),
k as (select file_uid, project_key, coalesce(len(split_sets), 0) as memberships, list_distinct(list_filter(list_transform(split_sets, lambda s: {_SPLIT}), lambda t: t <> 'unknown')) as kinds from f),
c as (select file_uid, project_key, case when memberships = 0 then 'unassigned' when len(kinds) = 1 then kinds[1] else 'unknown' end as split, case when memberships = 0 then 'missing' when len(kinds) > 1 then 'conflict' when memberships > 1 then 'repeated' else 'ok' end as state from k)
"""


def _splits(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "project_files", "file_uid", "project_key", "split_sets").distinct()
    return rows.select("file_uid", "project_key", codes.canonical_split(F.transform("split_sets", lambda s: codes.split_type_v2(s["split_type"]))).alias("c")).select("file_uid", "project_key", "c.split", "c.state")


@query(_SPLITS + "select file_uid, split, state from c")
def canonical_splits(spark: SparkSession, base: str) -> DataFrame:
    return _splits(spark, base).drop("project_key")


@query(_SPLITS + "select project_key, split, count(*) as n from c group by all")
def split_summary(spark: SparkSession, base: str) -> DataFrame:
    return _splits(spark, base).groupBy("project_key", "split").agg(F.count("*").alias("n"))


_ARGB = "(case when regexp_matches(trim(class_color), '^-?[0-9]+$') then case when try_cast(trim(class_color) as hugeint) between -2147483648 and 4294967295 then try_cast(trim(class_color) as bigint) & 4294967295 end when trim(class_color) <> '' and not regexp_matches(class_color, '^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$') then null when regexp_matches(class_color, '^#[0-9a-fA-F]{6}$') then ('0xff' || class_color[2:])::bigint when regexp_matches(class_color, '^#[0-9a-fA-F]{8}$') then ('0x' || class_color[2:])::bigint else [" + ", ".join(f"{c}::bigint" for c in codes.PALETTE_V1) + "][(class_index % 8) + 1] end)"


@query(f"with c as (select project_key, class_index, {_ARGB} as u, class_color from (select distinct project_key, class_index, class_color from project_classes)) select project_key, class_index, case when u > 2147483647 then u - 4294967296 else u end as argb, case when lower(lpad(to_hex(u), 8, '0'))[1:2] = 'ff' then '#' || lower(lpad(to_hex(u), 8, '0'))[3:] else '#' || lower(lpad(to_hex(u), 8, '0')) end as text from c")
def class_colors(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "project_classes", "project_key", "class_index", "class_color").distinct()
    return rows.select("project_key", "class_index", codes.argb_number(F.col("class_color"), F.col("class_index")).alias("argb")).withColumn("text", codes.argb_text(F.col("argb")))


@query(r"select distinct project_key, case when regexp_matches(modified_date, '^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$') then epoch_ms(try_strptime(replace(modified_date, 'T', ' '), '%Y-%m-%d %H:%M:%S')) end as ms from projects")
def v1_dates(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "projects", "project_key", "modified_date")
    return rows.select("project_key", codes.v1_date_ms(F.col("modified_date")).alias("ms")).distinct()


@query("select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as digest from documents where text is not null")
def xml_escaped(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.md5(codes.xml_escape(F.col("text"))).alias("digest"))


@query("select doc_id, strlen(text)::bigint as n_bytes, strlen(text) > 1024 as over from documents where text is not null")
def utf8_budget(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), (F.octet_length("text") > 1024).alias("over"))


# ---- aggregates over diagnostics and sizes

_DIAGS = """(select project_key, file_uid, unnest(list_filter([case when width is null then {'code': 'WIDTH_MISSING', 'disposition': 'degrade'} end, case when trim(remark) <> '' then {'code': 'REMARK_NOT_IN_V1', 'disposition': 'drop'} end,
 case when deleted_at is not null then {'code': 'FILE_DELETED', 'disposition': 'block'} end, {'code': 'FILE_READ', 'disposition': 'preserve'}], lambda x: x is not null)) as d from (select distinct project_key, file_uid, width, remark, deleted_at from project_files))"""


def _diagnostics(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "project_files", "project_key", "file_uid", "width", "remark", "deleted_at").distinct()
    rules = [(F.col("width").isNull(), "WIDTH_MISSING", "degrade"), (F.trim("remark") != "", "REMARK_NOT_IN_V1", "drop"), (F.col("deleted_at").isNotNull(), "FILE_DELETED", "block"), (F.lit(True), "FILE_READ", "preserve")]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.lit(kind).alias("disposition"))) for test, code, kind in rules]), lambda d: d.isNotNull())
    return rows.select("project_key", "file_uid", F.explode(found).alias("d")).select("project_key", "file_uid", "d.*")


@query(f"select project_key, count_if(d.disposition = 'preserve') as n_preserve, count_if(d.disposition = 'rebuild') as n_rebuild, count_if(d.disposition = 'degrade') as n_degrade, count_if(d.disposition = 'drop') as n_drop, count_if(d.disposition = 'block') as n_block, case when n_block > 0 then 'blocked' when n_degrade + n_drop > 0 then 'confirmation-required' else 'compatible' end as status from {_DIAGS} group by 1")
def disposition_summary(spark: SparkSession, base: str) -> DataFrame:
    return diag.disposition_summary(_diagnostics(spark, base), "project_key")


@query(f"with r as (select *, row_number() over (partition by project_key order by file_uid, d.code) as position from {_DIAGS}) select project_key, position::int as position, case when position = 256 then 'PROJECT_DIAGNOSTIC_LIMIT_EXCEEDED' else d.code end as code, case when position = 256 then 'block' else d.disposition end as disposition from r where position <= 256")
def diagnostic_cap(spark: SparkSession, base: str) -> DataFrame:
    return diag.bounded(_diagnostics(spark, base), "project_key", ["file_uid", "code"]).select("project_key", "position", "code", "disposition")


@query("select project_key, count(*) as n_files, coalesce(sum(uncompressed_size), 0)::bigint as n_bytes, case when count(*) > 19996 then 'IMAGE_SOURCE_FILE_LIMIT' when sum(uncompressed_size) > 34359738368 then 'IMAGE_SOURCE_SIZE_LIMIT' end as limit_code from (select distinct project_key, entry_name, uncompressed_size, is_dir from archive_entries) where not is_dir group by 1")
def selection_usage(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "archive_entries").select("project_key", "entry_name", "uncompressed_size", "is_dir").distinct().filter("not is_dir")
    return diag.usage(rows, "project_key", "uncompressed_size")


@query("select source, doc_id, position::int as position from (select source, doc_id, row_number() over (partition by source order by doc_id) as position from documents) where position <= 8")
def source_samples(spark: SparkSession, base: str) -> DataFrame:
    """First eight documents of each source: the limit is the feature."""
    return diag.first_of_each(read_table(spark, base, "documents", "source", "doc_id"), "source", ["doc_id"], 8)


@query("select source, least(sum(n_chars), 100001)::bigint as n_chars from documents group by 1")
def saturated_sizes(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents", "source", "n_chars").groupBy("source").agg(diag.saturating(F.sum("n_chars"), 100_000).cast("bigint").alias("n_chars"))


@query("select feed_id, count_if(json_valid(payload) and coalesce(regexp_replace(json_extract_string(case when json_valid(payload) then payload end, '$.description'), '\\s', '', 'g'), '') not in ('', 'null', '[]', '{}')) as n_description, count(*) as n from raw_exports group by 1")
def field_presence(spark: SparkSession, base: str) -> DataFrame:
    says = diag.meaningful(F.get_json_object("payload", "$.description")) & (F.get_json_object("payload", "$.description") != "")
    return read_table(spark, base, "raw_exports", "feed_id", "payload").groupBy("feed_id").agg(F.count_if(F.coalesce(says, F.lit(False))).alias("n_description"), F.count("*").alias("n"))


# ---- nested records and geometry

_LABELS = f"""(select project_key, file_pos, unnest(labels) as l, unnest(range(len(labels))) as label_pos from (select project_key, file_pos, f.label_data_list as labels from (select project_key, unnest(project_files) as f, unnest(range(len(project_files))) as file_pos from {_INBOX})))"""
_TEXT = "case when json_valid(l.label_contour) then case when json_type(l.label_contour) = 'VARCHAR' then json_extract_string(l.label_contour, '$') else l.label_contour end end"
_RINGS = f"""(select project_key, file_pos, label_pos, l, case when json_valid(t) then case when json_type(t, '$[0][0]') = 'ARRAY' or json_array_length(t, '$[0]') = 0 then try_cast(t as double[][][]) when json_type(t, '$[0]') = 'ARRAY' then [try_cast(t as double[][])] end end as rings from (select *, {_TEXT} as t from {_LABELS}))"""
_RING = f"(select project_key, file_pos, label_pos, unnest(rings) as ring, unnest(range(len(rings))) as ring_pos from {_RINGS})"


def _rings(spark: SparkSession, base: str) -> DataFrame:
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "class_infos", "project_files", "received_at"), "project_key")
    return flatten_inbox(inbox).filter("ring_pos >= 0").select("project_key", "file_pos", "label_pos", "ring_pos", F.col("points").alias("ring"))


@query(f"select project_key::varchar || '.' || file_pos || '.' || label_pos as node, project_key::varchar || '.' || file_pos as parent, label_pos::int as ordinal, l.label_id as label_id, l.label_type as label_type from {_LABELS}")
def label_nodes(spark: SparkSession, base: str) -> DataFrame:
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "project_files", "received_at"), "project_key").drop("received_at")
    return flatten_tables(inbox, "project_key")["project_files.label_data_list"].select("node", "parent", "ordinal", "label_id", "label_type")


@query(f"select project_key, file_pos::int as file_pos, label_pos::int as label_pos, floor(list_min(xs) + 0.5)::bigint as x, floor(list_min(ys) + 0.5)::bigint as y, floor(list_max(xs) - list_min(xs) + 0.5)::bigint as width, floor(list_max(ys) - list_min(ys) + 0.5)::bigint as height from (select *, list_transform(flatten(rings), lambda p: p[1]) as xs, list_transform(flatten(rings), lambda p: p[2]) as ys from {_RINGS} where len(rings) > 0)")
def label_bounds(spark: SparkSession, base: str) -> DataFrame:
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "project_files", "received_at"), "project_key")
    files = inbox.select("project_key", F.posexplode("project_files").alias("file_pos", "f"))
    labels = files.select("project_key", "file_pos", F.posexplode("f.label_data_list").alias("label_pos", "l"))
    rings = labels.select("project_key", "file_pos", "label_pos", read_rings(F.col("l.label_contour")).alias("rings")).filter("size(rings) > 0")
    return rings.select("project_key", "file_pos", "label_pos", geometry.bounds(F.col("rings")).alias("b")).select("project_key", "file_pos", "label_pos", "b.*")


_AREA = "list_reduce([0.0::double] || list_transform(range(1, len(ring) + 1), lambda i: ring[i][1] * ring[i % len(ring) + 1][2] - ring[i % len(ring) + 1][1] * ring[i][2]), lambda s, t: s + t)"


@query(f"select project_key, file_pos::int as file_pos, label_pos::int as label_pos, ring_pos::int as ring_pos, floor(a + 0.5)::bigint as area2, case when a > 0 then 'outer' when a < 0 then 'inner' else 'unknown' end as role from (select *, {_AREA} as a from {_RING})")
def ring_roles(spark: SparkSession, base: str) -> DataFrame:
    rows = _rings(spark, base).withColumn("a", geometry.signed_area2(F.col("ring")))
    return rows.select("project_key", "file_pos", "label_pos", "ring_pos", F.floor(F.col("a") + 0.5).cast("bigint").alias("area2"), geometry.ring_role(F.col("a")).alias("role"))


@query(f"""with w as (select *, list_transform(ring, lambda p: [floor(p[1] + 0.5)::bigint, floor(p[2] + 0.5)::bigint]) as whole from {_RING}),
k as (select *, list_transform(list_filter(range(1, len(whole) + 1), lambda i: i = 1 or whole[i] <> whole[i - 1]), lambda i: whole[i]) as kept from w),
c as (select *, case when len(kept) > 1 and kept[1] = kept[-1] then kept[:len(kept) - 1] else kept end as q from k)
select project_key, file_pos::int as file_pos, label_pos::int as label_pos, ring_pos::int as ring_pos, len(q)::int as n_points, list_sum(list_transform(q, lambda p: p[1]))::bigint as sum_x, len(list_distinct(q)) >= 3 as usable from c""")
def ring_quantised(spark: SparkSession, base: str) -> DataFrame:
    rows = _rings(spark, base).withColumn("q", geometry.quantise(F.col("ring")))
    sum_x = F.aggregate("q", F.lit(0).cast("bigint"), lambda s, p: s + p[0])
    return rows.select("project_key", "file_pos", "label_pos", "ring_pos", F.size("q").alias("n_points"), sum_x.alias("sum_x"), (F.size(F.array_distinct("q")) >= 3).alias("usable"))


@query(f"select project_key, count_if(coalesce(l.label_pos_x = 0 and l.label_pos_y = 0 and l.label_width = width and l.label_height = height, false)) as n_full, count(*) as n from (select project_key, f.width as width, f.height as height, unnest(f.label_data_list) as l from (select project_key, unnest(project_files) as f from {_INBOX})) group by 1")
def full_image_boxes(spark: SparkSession, base: str) -> DataFrame:
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "project_files", "received_at"), "project_key")
    files = inbox.select("project_key", F.explode("project_files").alias("f"))
    labels = files.select("project_key", F.col("f.width").alias("width"), F.col("f.height").alias("height"), F.explode("f.label_data_list").alias("l"))
    full = geometry.is_full_box(F.col("l.label_pos_x"), F.col("l.label_pos_y"), F.col("l.label_width"), F.col("l.label_height"), F.col("width"), F.col("height"))
    return labels.groupBy("project_key").agg(F.count_if(full).alias("n_full"), F.count("*").alias("n"))


# ---- round trips through the writers and parsers

def _as_v1(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "project_name", "project_type", "class_infos", "project_files", "received_at"), "project_key")
    projects = inbox.select("project_key", F.lit("segmentation").alias("project_type"), F.unix_millis("received_at").alias("modified_ms"), F.lit("simple").alias("roi_mode"), *[F.lit(x).alias(f"roi_{s}") for s, x in (("left", 0.1), ("top", 0.2), ("right", 0.8), ("bottom", 0.85))])
    classes = inbox.select("project_key", F.posexplode("class_infos").alias("class_index", "c")).select("project_key", "class_index", F.col("c.class_name").alias("class_name"), F.col("c.class_color").alias("class_color"))
    files = inbox.select("project_key", F.posexplode("project_files").alias("file_index", "f"))
    splits = codes.canonical_split(F.transform("f.split_sets", lambda s: codes.split_type_v2(s["split_type"])))
    rows = files.select("project_key", "file_index", F.col("f.file_path").alias("source_path"), F.col("f.width").alias("width"), F.col("f.height").alias("height"), F.when(splits["split"] == "unknown", "unassigned").otherwise(splits["split"]).alias("split"), F.lit(False).alias("is_normal"), F.lit(None).cast("bigint").alias("class_index"))
    labels = files.select("project_key", "file_index", F.posexplode("f.label_data_list").alias("label_index", "l")).select("project_key", "file_index", "label_index", F.lit(0).alias("class_index"), read_rings(F.col("l.label_contour")).alias("rings"))
    labels = labels.filter("size(rings) > 0").withColumn("roles", F.transform("rings", lambda r, i: F.when(i == 0, "outer").otherwise("inner")))
    return projects, classes, rows, labels


@query(f"""
select i.project_key, coalesce(len(class_infos), 0)::bigint as n_classes, coalesce(len(project_files), 0)::bigint as n_files, coalesce(r.n, 0)::bigint as n_labels, coalesce(r.rings, 0)::bigint as n_rings from {_INBOX} i
left join (select project_key, count(*) as n, sum(len(rings)) as rings from {_RINGS} where len(rings) > 0 group by 1) r using (project_key)""")
def v1_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Projects written as V1 XML and parsed again: classes, files, labels and rings that came back."""
    written = write_v1(*_as_v1(spark, base)).withColumnRenamed("xml", "text")
    parsed = v1_xml.parse_v1(written)
    image = v1_xml.one(F.col("doc.ImageGroup"))["Image"]
    groups = F.flatten(F.transform(image, lambda i: F.coalesce(v1_xml.one(i["LabelGroup"])["Label"], F.array())))
    rings = F.aggregate(F.transform("labels", lambda l: F.size(v1_xml.one(l["ContourGroup"])["Contour"])), F.lit(0), lambda s, n: s + n)
    counted = parsed.select("project_key", F.coalesce(F.size(v1_xml.one(F.col("doc.ClassGroup"))["Class"]), F.lit(0)).alias("n_classes"), F.coalesce(F.size(image), F.lit(0)).alias("n_files"), F.coalesce(groups, F.array()).alias("labels"))
    return counted.select("project_key", F.greatest("n_classes", F.lit(0)).cast("bigint").alias("n_classes"), F.greatest("n_files", F.lit(0)).cast("bigint").alias("n_files"), F.size("labels").cast("bigint").alias("n_labels"), rings.cast("bigint").alias("n_rings"))


@query(f"select project_key, coalesce(len(class_infos), 0)::bigint as n_classes, coalesce(len(project_files), 0)::bigint as n_files, coalesce(len(flatten(list_transform(project_files, lambda f: f.label_data_list))), 0)::bigint as n_labels from {_INBOX}")
def v2_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Projects written as V2 JSON and parsed again: classes, files and labels that came back."""
    inbox = first_arrivals(read_table(spark, base, "v2_inbox"), "project_key")
    back = v2_json.parse_v2(write_v2(inbox).withColumnRenamed("json", "text"))
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    labels = F.aggregate(F.coalesce(F.transform("project.project_files", lambda f: F.coalesce(F.when(f["label_data_list"].isNotNull(), F.size(f["label_data_list"])), F.lit(0))), F.array()), F.lit(0), lambda s, n: s + n)
    return back.select("project_key", size(F.col("project.class_infos")).alias("n_classes"), size(F.col("project.project_files")).alias("n_files"), labels.cast("bigint").alias("n_labels"))
