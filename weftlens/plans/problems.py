"""The p-queries of the core: each applies a problem's operator to its whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.visual import form_sql
from ..operators.drift import aliases, consistent_table, schema_changes
from ..operators.nested import flatten_inbox
from ..operators.orphans import find_reference_orphans
from ..operators.timestamps import ABBREVIATIONS, FAMILIES, MONTHS, normalise_timestamps
from ..operators.units import UNITS, normalise_quantities
from ..sources.tables import first_arrivals, read_table


def _with_station(spark: SparkSession, base: str) -> DataFrame:
    """Projects once each, with their station's settings (24 stations: a fixed table)."""
    projects = first_arrivals(read_table(spark, base, "projects"), "project_key")
    stations = read_table(spark, base, "stations").select("station_id", "zone_id", "day_first", "decimal_mark", F.col("roi_unit").alias("station_unit"), "um_per_px")
    return projects.join(stations, "station_id", "left")


def timestamps_table(spark: SparkSession, base: str) -> DataFrame:
    """Every date text of problem 1 with the outcome of its interpretation."""
    projects = _with_station(spark, base)
    station = ["station_id", "zone_id", "day_first", "received_at"]
    texts = F.explode(F.array(F.struct(F.lit("created_date").alias("field_name"), F.col("created_date").alias("text")), F.struct(F.lit("modified_date").alias("field_name"), F.col("modified_date").alias("text"))))
    own = projects.select(F.lit("projects").alias("table_name"), F.col("project_key").alias("row_id"), *station, texts.alias("t")).select("table_name", "row_id", *station, "t.*")
    files = first_arrivals(read_table(spark, base, "project_files", "file_uid", "project_key", "registered_date", "received_at"), "file_uid")
    of_files = files.join(projects.select("project_key", "station_id", "zone_id", "day_first"), "project_key", "left")
    of_files = of_files.select(F.lit("project_files").alias("table_name"), F.col("file_uid").alias("row_id"), *station, F.lit("registered_date").alias("field_name"), F.col("registered_date").alias("text"))
    every = own.unionByName(of_files)
    return normalise_timestamps(every, "text", "zone_id", ["table_name", "field_name", "station_id"], "day_first", "received_at")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return timestamps_table(spark, base).filter("epoch_ms is not null").select("table_name", "row_id", "field_name", "epoch_ms")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return schema_changes(read_table(spark, base, "raw_exports", "feed_id", "batch_no", "project_id", "payload", "received_at"))


#: Columns of the consistent table of ``raw_exports``: type and first names; renamings found in the feeds add the others.
EXPORT_COLUMNS = {
    "project_name": ("string", ["projectName"]), "project_type": ("string", ["projectType", "projectType.code"]), "format_version": ("double", ["Version"]), "roi_mode": ("string", ["roiMode"]), "roi_pos_x": ("double", ["roiPosX"]),
    "roi_pos_y": ("double", ["roiPosY"]), "roi_width": ("double", ["roiWidth"]), "station": ("string", ["station"]), "created_by": ("string", ["createdBy"]), "description": ("string", ["description"]), "file_count": ("bigint", ["fileCount"]),
}


def p2_table(spark: SparkSession, base: str) -> DataFrame:
    """All records of ``raw_exports`` in one typed table, renamings applied, with the casts that failed and the number of fields left over."""
    records = read_table(spark, base, "raw_exports", "feed_id", "batch_no", "project_id", "payload", "received_at")
    table = consistent_table(records, aliases(schema_changes(records), EXPORT_COLUMNS))
    return table.select("feed_id", "batch_no", "project_id", *EXPORT_COLUMNS, F.array_join("failed_casts", ",").alias("failed_casts"), F.when(F.col("unmapped").isNotNull(), F.size("unmapped")).alias("n_unmapped"))


def quantities_table(spark: SparkSession, base: str) -> DataFrame:
    """Every quantity of problem 3 with its number, unit, pixels and status."""
    projects = _with_station(spark, base)
    scale = ["decimal_mark", "um_per_px", "frame_width"]
    value = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text"))
    own = projects.select(F.lit("projects").alias("table_name"), F.col("project_key").alias("row_id"), *scale, F.col("roi_unit").alias("unit_field"), F.col("station_unit").alias("default_unit"), F.explode(F.array(value("roi_pos_x"), value("roi_width"))).alias("v"))
    own = own.select("table_name", "row_id", *scale, "unit_field", "default_unit", "v.*")
    files = first_arrivals(read_table(spark, base, "project_files", "file_uid", "project_key", "width", "width_unit", "received_at"), "file_uid")
    of_files = files.join(projects.select("project_key", *scale), "project_key", "left").select(
        F.lit("project_files").alias("table_name"), F.col("file_uid").alias("row_id"), *scale, F.col("width_unit").alias("unit_field"), F.lit("px").alias("default_unit"), F.lit("width").alias("field_name"), F.col("width").alias("text")
    )
    return normalise_quantities(own.unionByName(of_files), "text", "unit_field", "default_unit", "decimal_mark", "um_per_px", "frame_width")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return quantities_table(spark, base).filter("unit_status = 'ok'").select("table_name", "row_id", "field_name", F.round("value_px").cast("long").alias("value_px"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    inbox = read_table(spark, base, "v2_inbox", "project_key", "class_infos", "project_files", "received_at")
    return flatten_inbox(first_arrivals(inbox, "project_key")).select("project_key", "file_pos", "label_pos", "ring_pos", "n_points", "class_id")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    read = lambda name, *columns: read_table(spark, base, name, "project_key", "received_at", *columns)
    return find_reference_orphans(
        read("manifest_entries", "entry_id", "original_path", "relative_path"), read("project_files", "source_path", "deleted_at"), read("archive_entries", "entry_name", "deleted_at"),
        read("project_labels", "label_uid", "class_index"), read("project_classes", "class_index", "deleted_at"),
    )


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_table": p2_table, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found}

_SPACES = r"[\s\x{00A0}\x{2007}\x{2009}\x{202F}]"
_NUMBER = r"([+\-]?[0-9](?:[0-9.,'\s\x{00A0}\x{2007}\x{2009}\x{202F}]*[0-9])?(?:[eE][+\-]?[0-9]+)?)"
_ALIASES = ", ".join(f"('{alias}', '{kind}', {factor})" for _, kind, factor, _, aliases in UNITS for alias in aliases)

P3_SQL = rf"""
with p as (select project_key, any_value(station_id) as station_id, any_value(roi_pos_x) as roi_pos_x, any_value(roi_width) as roi_width, any_value(roi_unit) as roi_unit, any_value(frame_width) as frame_width from projects group by 1),
f as (select file_uid, any_value(project_key) as project_key, any_value(width) as width, any_value(width_unit) as width_unit from project_files group by 1),
v as (select 'projects' as table_name, project_key as row_id, 'roi_pos_x' as field_name, station_id, frame_width, roi_pos_x as t, roi_unit as u, false as is_width from p union all select 'projects', project_key, 'roi_width', station_id, frame_width, roi_width, roi_unit, false from p
 union all select 'project_files', file_uid, 'width', station_id, frame_width, width, width_unit, true from f join p using (project_key)),
n as (select v.*, s.um_per_px, regexp_extract(t, '{_NUMBER.replace("'", "''")}', 1) as raw, lower(regexp_replace(regexp_extract(t, '{_NUMBER.replace("'", "''")}(.*)$', 2), '^{_SPACES}+|{_SPACES}+$', '', 'g')) as own, case when is_width then 'px' else s.roi_unit end as fallback, s.decimal_mark from v join stations s using (station_id)),
x as (select *, try_cast(case when decimal_mark = ',' then replace(regexp_replace(raw, '[.''\s\x{{00A0}}\x{{2007}}\x{{2009}}\x{{202F}}]', '', 'g'), ',', '.') else regexp_replace(raw, '[,''\s\x{{00A0}}\x{{2007}}\x{{2009}}\x{{202F}}]', '', 'g') end as double) as number, coalesce(nullif(own, ''), lower(nullif(trim(u), '')), fallback) as alias from n),
a(alias, kind, factor) as (values {_ALIASES})
select table_name, row_id, field_name, round(case kind when 'pixel' then number * factor when 'length' then number * factor / um_per_px else number * factor * frame_width end)::bigint as value_px from x join a using (alias) where number is not null"""

_TEXT = "case when json_valid(l.label_contour) then case when json_type(l.label_contour) = 'VARCHAR' then json_extract_string(l.label_contour, '$') else l.label_contour end end"
P4_SQL = rf"""
with i as (select project_key, any_value(class_infos) as ci, any_value(project_files) as fs from v2_inbox group by 1),
f as (select project_key, ci, unnest(fs) as f, unnest(range(len(fs))) as file_pos from i where len(fs) > 0),
l as (select project_key, ci, file_pos, unnest(f.label_data_list) as l, unnest(range(len(f.label_data_list))) as label_pos from f where len(f.label_data_list) > 0),
c as (select *, coalesce(case when l.class_id is not null then list_filter(ci, lambda c: c.class_id = l.class_id)[1].class_id when l.class_no is not null then list_filter(ci, lambda c: c.class_no = l.class_no)[1].class_id else list_filter(ci, lambda c: c.class_name = l.class_name)[1].class_id end, -1) as class_id, {_TEXT} as t from l),
r as (select *, case when json_valid(t) then case when json_type(t, '$[0][0]') = 'ARRAY' or json_array_length(t, '$[0]') = 0 then try_cast(t as double[][][]) when json_type(t, '$[0]') = 'ARRAY' then [try_cast(t as double[][])] end end as rings from c),
g as (select project_key, file_pos, label_pos, class_id, unnest(rings) as ring, unnest(range(len(rings))) as ring_pos from r where len(rings) > 0)
select project_key, file_pos::int as file_pos, label_pos::int as label_pos, ring_pos::int as ring_pos, len(ring)::int as n_points, class_id from g
union all select project_key, file_pos::int, label_pos::int, -1, 0, class_id from r where rings is null or len(rings) = 0
union all select project_key, file_pos::int, -1, -1, 0, -1 from f where coalesce(len(f.label_data_list), 0) = 0
union all select project_key, -1, -1, -1, 0, -1 from i where coalesce(len(fs), 0) = 0"""

_KEY = r"lower(replace(form, '\', '/'))"
P6_SQL = rf"""
with {form_sql("select original_path as text from manifest_entries union select relative_path from manifest_entries union select source_path from project_files union select entry_name from archive_entries")},
r as (select 'manifest_entries' as table_name, entry_id as row_id, 'original_path' as field_name, project_key, {_KEY} as key, received_at from manifest_entries join forms on text = original_path
 union all select 'manifest_entries', entry_id, 'relative_path', project_key, {_KEY}, received_at from manifest_entries join forms on text = relative_path
 union all select 'project_labels', label_uid, 'class_index', project_key, class_index::varchar, received_at from project_labels where class_index is not null),
f as (select table_name, row_id, field_name, min(project_key) as project_key, min(key) as key, min(received_at) as seen from r group by all),
t as (select 'original_path' as field_name, project_key, {_KEY} as key, received_at, deleted_at from project_files join forms on text = source_path
 union all select 'relative_path', project_key, {_KEY}, received_at, deleted_at from archive_entries join forms on text = entry_name
 union all select 'class_index', project_key, class_index::varchar, received_at, deleted_at from project_classes where class_index is not null),
g as (select field_name, project_key, key, min(case when deleted_at is null then received_at end) as live_at from t group by all),
k as (select f.*, case when g.key is null then 'missing' when g.live_at is null then 'deleted' when g.live_at > f.seen then 'late' end as orphan_kind from f left join g on g.field_name = f.field_name and g.project_key = f.project_key and g.key = f.key)
select table_name, row_id, field_name, orphan_kind, strftime(make_timestamp(epoch_us(seen)), '%Y-%m') as period from k where orphan_kind is not null"""

_NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT', 'DECIMAL')"
P2_SQL = rf"""
with recursive o as (select feed_id, batch_no, project_id, arg_min(payload, (received_at, payload)) as payload from raw_exports where project_id is not null group by all),
w(feed_id, batch_no, project_id, path, v) as (
 select feed_id, batch_no, project_id, e.key, e.value from (select * from o where json_valid(payload) and json_type(case when json_valid(payload) then payload end) = 'OBJECT') x, json_each(x.payload) e
 union all select w.feed_id, w.batch_no, w.project_id, w.path || '.' || e.key, e.value from w, json_each(w.v) e where json_type(w.v) = 'OBJECT'),
p as (select feed_id, batch_no, project_id, path, case when json_type(v) = 'VARCHAR' then 'string' when json_type(v) in {_NUMERIC} then 'number' else lower(json_type(v)) end as kind, case when json_type(v) in {_NUMERIC} then (v::varchar)::double::varchar when json_type(v) = 'VARCHAR' then v->>'$' else v::varchar end as value from w),
b as (select distinct feed_id, batch_no from p), pairs as (select b.feed_id, b.batch_no from b join b a on a.feed_id = b.feed_id and a.batch_no = b.batch_no - 1),
s as (select feed_id, batch_no, path, list_sort(list(distinct kind) filter (kind <> 'null')) as kinds, bool_or(kind = 'object') as is_object from p group by all),
n as (select s.* from s join pairs using (feed_id, batch_no)), q as (select s.feed_id, s.batch_no + 1 as batch_no, s.path, s.kinds, s.is_object from s join pairs on pairs.feed_id = s.feed_id and pairs.batch_no = s.batch_no + 1),
fresh as (select n.* from n anti join q using (feed_id, batch_no, path)), gone as (select q.* from q anti join n using (feed_id, batch_no, path)),
common as (select c.feed_id, c.batch_no, c.project_id from (select distinct feed_id, batch_no, project_id from p) c join (select distinct feed_id, batch_no, project_id from p) d on d.feed_id = c.feed_id and d.project_id = c.project_id and d.batch_no = c.batch_no - 1),
cand as (select f.feed_id, f.batch_no, f.path as field_path, g.path as prior_path from fresh f join gone g using (feed_id, batch_no) where not f.is_object and not g.is_object),
cmp as (select c.feed_id, c.batch_no, field_path, prior_path, bool_and((x.kind is null and y.kind is null) or (x.kind = y.kind and x.value is not distinct from y.value)) as same, count(*) filter (x.kind <> 'null') as known from cand c join common using (feed_id, batch_no)
 left join p x on x.feed_id = c.feed_id and x.batch_no = c.batch_no and x.project_id = common.project_id and x.path = c.field_path left join p y on y.feed_id = c.feed_id and y.batch_no = c.batch_no - 1 and y.project_id = common.project_id and y.path = c.prior_path group by 1, 2, 3, 4),
ren as (select feed_id, batch_no, field_path, prior_path from cmp where same and known >= 3)
select feed_id, batch_no, field_path, 'renamed' as change_kind, prior_path from ren
union all select feed_id, batch_no, path, 'added', '' from fresh f where not exists (select 1 from ren r where r.feed_id = f.feed_id and r.batch_no = f.batch_no and r.field_path = f.path)
union all select feed_id, batch_no, path, 'removed', '' from gone g where not exists (select 1 from ren r where r.feed_id = g.feed_id and r.batch_no = g.batch_no and r.prior_path = g.path)
union all select n.feed_id, n.batch_no, n.path, 'retyped', '' from n join q using (feed_id, batch_no, path) where len(n.kinds) > 0 and len(q.kinds) > 0 and n.kinds <> q.kinds"""

_FAMILY = " ".join(f"when regexp_matches(x, '{pattern}') then '{name}'" for name, pattern, _ in FAMILIES)
_GROUPS = {name: re.sub(r"[$]([0-9])", r"\\\1", groups) for name, _, groups in FAMILIES}
_SPLIT = " ".join(f"when fam = '{name}' then regexp_replace(x, '{pattern}', '{_GROUPS[name]}')" for name, pattern, _ in FAMILIES)
_ZONES = " ".join(f"when '{name}' then {minutes}" for name, minutes in ABBREVIATIONS.items())
_OFFSET = "(epoch_ms(timezone(zone_id, make_timestamptz(({0}) * 1000))) - ({0}))"
P1_SQL = rf"""
with p as (select project_key, any_value(station_id) as station_id, any_value(created_date) as created_date, any_value(modified_date) as modified_date from projects group by 1), f as (select file_uid, any_value(project_key) as project_key, any_value(registered_date) as registered_date from project_files group by 1),
v as (select 'projects' as table_name, project_key as row_id, 'created_date' as field_name, created_date as t, station_id from p union all select 'projects', project_key, 'modified_date', modified_date, station_id from p union all select 'project_files', file_uid, 'registered_date', registered_date, station_id from f join p using (project_key)),
x as (select v.*, s.zone_id, s.day_first, trim(regexp_replace(t, '\s+', ' ', 'g')) as x from v join stations s using (station_id) where t is not null),
q as (select *, case when regexp_matches(x, '^\d{{10}}$') then 'epoch_s' when regexp_matches(x, '^\d{{13}}$') then 'epoch_ms' when regexp_matches(x, '^\d{{16}}$') then 'epoch_us' when regexp_matches(x, '^/Date\(-?\d{{1,17}}([+-]\d{{4}})?\)/$') then 'json_date' {_FAMILY} end as fam from x),
g as (select *, string_split(case {_SPLIT} end, '|') as g from q),
n as (select *, try_cast(g[1] as int) as y, case when fam = 'named' then list_position([{", ".join(f"'{m}'" for m in MONTHS)}], lower(g[2][:3])) else try_cast(g[2] as int) end as a, try_cast(g[3] as int) as b, coalesce(try_cast(g[4] as int), 0) as h0, coalesce(try_cast(g[5] as int), 0) as mi, coalesce(try_cast(g[6] as int), 0) as s, coalesce(try_cast(rpad(g[7][:3], 3, '0') as int), 0) as ms, lower(g[8]) as half, g[9] as z from g),
c as (select *, case when half = '' then h0 when h0 not between 1 and 12 then null when half in ('pm', '오후', '下午', '午後') then h0 % 12 + 12 else h0 % 12 end as h, case when fam = 'numeric' and day_first then b else a end as mo, case when fam = 'numeric' and day_first then a else b end as d from n),
w as (select *, case when h < 24 and mi < 60 and s < 60 then epoch_ms(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) as timestamp)) end as u, case when regexp_matches(z, '^[+-]\d') then (case when z[1] = '-' then -1 else 1 end) * (regexp_replace(z, '[^0-9]', '', 'g')[1:2]::int * 60 + coalesce(try_cast(regexp_replace(z, '[^0-9]', '', 'g')[3:4] as int), 0)) else case z {_ZONES} when 'CST' then case when starts_with(zone_id, 'America') then -360 else 480 end when 'IST' then 330 end end as off from c),
l as (select *, {_OFFSET.format("u - 86400000")} as o1, {_OFFSET.format("u + 86400000")} as o2 from w),
r as (select *, case fam when 'epoch_s' then x::bigint * 1000 when 'epoch_ms' then x::bigint when 'epoch_us' then x::bigint // 1000 when 'json_date' then regexp_extract(x, '^/Date\((-?\d+)', 1)::bigint
 else case when z <> '' then u - off * 60000 when {_OFFSET.format("u - o1")} = o1 and {_OFFSET.format("u - o2")} = o2 then least(u - o1, u - o2) when {_OFFSET.format("u - o1")} = o1 then u - o1 when {_OFFSET.format("u - o2")} = o2 then u - o2 else u - o1 end + ms end as instant from l)
select table_name, row_id, field_name, instant as epoch_ms from r where instant is not null"""

ORACLES = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p6_found": P6_SQL}
