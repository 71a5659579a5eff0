"""Queries over the conversion between the two generations: what is written is parsed again and compared by content.

The nested projects of ``v2_inbox`` stand for the sources: their classes,
files and rings become the canonical tables that both writers take. A path
without a root gets one, and an unknown split is unassigned: the callers of the
writers decide that, the writers refuse to guess.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, paths
from ..functions.paths import is_absolute
from ..operators.images import image_header
from ..operators.matching import resolve_images
from ..operators.nested import read_rings
from ..operators.validation import OUTPUTS, file_findings, file_states, label_findings, project_findings, target_readiness
from ..sinks.packages import package_plan
from ..sinks.projects import write_v1
from ..sinks.v2_build import build_v2, write_findings
from ..sources import v1_xml, v2_json
from ..sources.json_structure import FIELDS, json_findings, json_usage
from ..sources.packages import item_findings
from ..sources.xml_nodes import region_findings, regions, structure_findings, xml_nodes
from ..sources.regions import v2_regions
from ..sources.tables import first_arrivals, read_table
from ..session import cut, ensure_checkpoint_dir
from ..streaming.ingest import first_arrivals as first_arrivals_of_stream
from ..streaming.ingest import stream_table
from . import reference
from .reference import _INBOX, _LABELS, _RINGS

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


def canonical(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Projects, classes, files and labels of ``v2_inbox`` in the shape that the writers take."""
    inbox = first_arrivals(read_table(spark, base, "v2_inbox", "project_key", "project_name", "class_infos", "project_files", "received_at"), "project_key")
    corners = [F.lit(x).alias(f"roi_{s}") for s, x in (("left", 0.125), ("top", 0.25), ("right", 0.75), ("bottom", 0.875))]
    projects = inbox.select("project_key", "project_name", F.lit("segmentation").alias("project_type"), F.unix_millis("received_at").alias("modified_ms"), F.lit("simple").alias("roi_mode"), *corners)
    classes = inbox.select("project_key", F.posexplode("class_infos").alias("class_index", "c")).select("project_key", "class_index", F.col("c.class_name").alias("class_name"), F.col("c.class_color").alias("class_color"), F.col("c.is_ng").alias("is_ng"))
    files = inbox.select("project_key", F.posexplode("project_files").alias("file_index", "f"))
    splits = codes.canonical_split(F.transform("f.split_sets", lambda s: codes.split_type_v2(s["split_type"])))
    rooted = F.when(is_absolute(F.col("f.file_path")), F.col("f.file_path")).otherwise(F.concat(F.lit("C:/data/"), F.coalesce("f.file_path", F.lit(""))))
    rows = files.select("project_key", "file_index", rooted.alias("source_path"), F.col("f.file_name").alias("file_name"), F.col("f.width").alias("width"), F.col("f.height").alias("height"), F.when(splits["split"] == "unknown", "unassigned").otherwise(splits["split"]).alias("split"), F.lit(False).alias("is_normal"), F.lit(None).cast("boolean").alias("is_labeled"), F.lit(None).cast("int").alias("class_index"))
    labels = files.select("project_key", "file_index", F.posexplode("f.label_data_list").alias("label_index", "l")).select("project_key", "file_index", "label_index", F.lit(0).alias("class_index"), read_rings(F.col("l.label_contour")).alias("rings")).filter("size(rings) > 0")
    return projects, classes, rows, labels.withColumn("roles", F.transform("rings", lambda r, i: F.when(i == 0, "outer").otherwise("inner")))


_X, _Y = "list_transform(flatten(rings), lambda p: p[1])", "list_transform(flatten(rings), lambda p: p[2])"
_AREA2 = "list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i][1] * r[i % len(r) + 1][2] - r[i % len(r) + 1][1] * r[i][2]))"
_WRITTEN = f"""
f as (select project_key, unnest(project_files) as f, unnest(range(len(project_files))) as file_index from {_INBOX}),
l as (select r.project_key, r.file_pos as file_index, r.label_pos as label_index, r.rings, f.f.width as w, f.f.height as h, list_transform(r.rings, lambda r: {_AREA2}) as areas from {_RINGS} r join f on f.project_key = r.project_key and f.file_index = r.file_pos where len(r.rings) > 0),
m as (select *, abs(list_sum(list_transform(areas, lambda a, i: case when i = 1 then 1 else -1 end * abs(a) / 2))) as area, floor(list_min({_X}) + 0.5) as x, floor(list_min({_Y}) + 0.5) as y, floor(list_max({_X}) - list_min({_X}) + 0.5) as bw, floor(list_max({_Y}) - list_min({_Y}) + 0.5) as bh from l),
c as (select project_key, class_infos, coalesce(len(class_infos), 0) as n, list_transform(class_infos, lambda c: lower(trim(c.class_name))) as names from {_INBOX}),
d as (
 select project_key, unnest(list_filter([case when len(list_filter(names, lambda x: coalesce(x, '') = '')) > 0 then 'V2_WRITE_CLASS_NAME_REQUIRED' end, case when n - len(list_filter(names, lambda x: x is null)) > len(list_distinct(names)) or len(list_filter(names, lambda x: x is null)) > 1 then 'V2_WRITE_CLASS_NAME_DUPLICATE' end, case when list_contains(names, 'ok') then 'V2_WRITE_SEGMENTATION_OK_CLASS_RESERVED' end], lambda x: x is not null)) as code from c where n > 0
 union all select project_key, 'V2_WRITE_ROI_STAGE_SIZE_REQUIRED' from {_INBOX} where not coalesce(project_files[1].width > 0 and project_files[1].height > 0, false)
 union all select project_key, 'V2_WRITE_IMAGE_DIMENSIONS_REQUIRED' from f where not coalesce(f.width > 0 and f.height > 0, false)
 union all select project_key, 'V2_WRITE_EXTERNAL_PATH_TRAVERSAL' from f where list_contains(string_split(replace(f.file_path, '\\', '/'), '/'), '..')
 union all select project_key, code from (select m.project_key, case when coalesce(c.n, 0) = 0 then 'V2_WRITE_CLASS_REFERENCE_INVALID'
  when len(list_filter(rings, lambda r: r is null or len(r) < 3)) > 0 then 'V2_WRITE_SEGMENTATION_CONTOUR_INVALID'
  when len(list_filter(flatten(rings), lambda p: p[1] is null or p[2] is null or p[1] < 0 or p[2] < 0 or coalesce(p[1] > w, false) or coalesce(p[2] > h, false))) > 0 then 'V2_WRITE_SEGMENTATION_POINT_INVALID'
  when list_contains(areas, 0) then 'V2_WRITE_SEGMENTATION_CONTOUR_AREA_INVALID' when bw <= 0 or bh <= 0 or area <= 0 then 'V2_WRITE_SEGMENTATION_GEOMETRY_INVALID' end as code from m left join c using (project_key)) where code is not null)"""


@query(f"with {_WRITTEN} select project_key, code, count(*) as n from d group by all")
def v2_write_findings(spark: SparkSession, base: str) -> DataFrame:
    """What forbids to write the projects as V2, by project and code."""
    return write_findings(*canonical(spark, base)).groupBy("project_key", "code").agg(F.count("*").alias("n"))


def _written(spark: SparkSession, base: str) -> DataFrame:
    built = build_v2(*canonical(spark, base)).filter("json is not null").withColumnRenamed("json", "text")
    return v2_json.inbox_rows(v2_json.parse_v2(built))


@query(f"""with {_WRITTEN} select m.project_key, file_index::int as file_index, (row_number() over (partition by m.project_key, file_index order by label_index) - 1)::int as label_pos, c.class_infos[1].class_name as class_name, x::bigint as x, y::bigint as y, bw::bigint as width, bh::bigint as height, round(area, 3) as area, len(rings)::int as n_rings, len(flatten(rings))::int as n_points
from m join c using (project_key) where project_key not in (select project_key from d)""")
def v2_written_labels(spark: SparkSession, base: str) -> DataFrame:
    """Labels of the projects written as V2 and parsed again: class, box, area, rings and points."""
    files = _written(spark, base).select("project_key", F.posexplode("project_files").alias("file_index", "f"))
    labels = files.select("project_key", "file_index", F.posexplode("f.label_data_list").alias("label_pos", "l"))
    rings = read_rings(F.col("l.label_contour"))
    whole = lambda c: F.col(f"l.{c}").cast("bigint")
    return labels.select("project_key", "file_index", "label_pos", F.col("l.class_name").alias("class_name"), whole("label_pos_x").alias("x"), whole("label_pos_y").alias("y"), whole("label_width").alias("width"), whole("label_height").alias("height"), F.round("l.contour_size", 3).alias("area"), F.size(rings).alias("n_rings"), F.size(F.flatten(rings)).alias("n_points"))


_KIND = "case when lower(trim(s.split_type)) in ('train', 'training') then 'train' when lower(trim(s.split_type)) in ('val', 'valid', 'validation') then 'val' when lower(trim(s.split_type)) in ('unassigned', 'not-split', 'not_split') then 'not-split' end"


@query(f"""with {_WRITTEN}, k as (select project_key, file_index, f, list_distinct(list_filter(list_transform(f.split_sets, lambda s: {_KIND}), lambda t: t is not null)) as kinds from f where project_key not in (select project_key from d)), n as (select project_key, file_index, count(*) as n from m group by all)
select k.project_key, k.file_index::int as file_index, case when regexp_matches(f.file_path, '^(?i)([\\\\/]|[a-z]:[\\\\/]|file://)') then f.file_path else 'C:/data/' || coalesce(f.file_path, '') end as file_path, f.width as width, f.height as height, case when len(kinds) = 1 then kinds[1] else 'not-split' end as split_type, n.n is not null as is_labeled, coalesce(n.n, 0)::int as n_labels
from k left join n using (project_key, file_index)""")
def v2_written_files(spark: SparkSession, base: str) -> DataFrame:
    """Files of the projects written as V2 and parsed again: path, size, split and labels."""
    files = _written(spark, base).select("project_key", F.posexplode("project_files").alias("file_index", "f"))
    return files.select("project_key", "file_index", F.col("f.file_path").alias("file_path"), F.col("f.width").alias("width"), F.col("f.height").alias("height"), F.get("f.split_sets", F.lit(0))["split_type"].alias("split_type"), F.col("f.is_labeled").alias("is_labeled"), F.size("f.label_data_list").alias("n_labels"))


_QUANTISED = f"""
w as (select project_key, file_pos, label_pos, ring_pos, list_transform(ring, lambda p: [floor(p[1] + 0.5)::bigint, floor(p[2] + 0.5)::bigint]) as whole from (select project_key, file_pos, label_pos, unnest(rings) as ring, unnest(range(len(rings))) as ring_pos from {_RINGS} where len(rings) > 0)),
k as (select *, list_transform(list_filter(range(1, len(whole) + 1), lambda i: i = 1 or whole[i] <> whole[i - 1]), lambda i: whole[i]) as kept from w),
q as (select *, case when len(kept) > 1 and kept[1] = kept[-1] then kept[:len(kept) - 1] else kept end as q from k)"""


@query(f"""with {_QUANTISED}, painted as (select project_key from {_INBOX} where coalesce(len(list_filter(class_infos, lambda c: coalesce(trim(c.class_color), '') <> '' and not regexp_matches(trim(c.class_color), '^(#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{8}})|-?[0-9]{{1,9}})$'))), 0) = 0)
select q.project_key, file_pos::int as file_index, (dense_rank() over (partition by q.project_key, file_pos order by label_pos) - 1)::int as label_pos, case when ring_pos = 0 then 'outer' else 'inner' end as role, len(q)::int as n_points, list_sum(list_transform(q, lambda p: p[1]))::bigint as sum_x, list_sum(list_transform(q, lambda p: p[2]))::bigint as sum_y
from q join painted using (project_key) where len(list_distinct(q)) >= 3""")
def v1_written_rings(spark: SparkSession, base: str) -> DataFrame:
    """Rings of the projects written as V1 and parsed again: role, points and the sums of their coordinates."""
    projects, classes, files, labels = canonical(spark, base)
    parsed = v1_xml.parse_v1(write_v1(projects, classes, files, labels).filter("xml is not null").withColumnRenamed("xml", "text"))
    rows = v1_xml.labels(parsed).select("project_key", "file_index", F.col("label_index").alias("label_pos"), F.explode(F.arrays_zip("rings", "roles")).alias("r"))
    total = lambda i: F.aggregate("r.rings", F.lit(0).cast("bigint"), lambda s, p: s + F.get(p, F.lit(i)).cast("bigint"))
    return rows.select("project_key", "file_index", "label_pos", F.col("r.roles").alias("role"), F.size("r.rings").alias("n_points"), total(0).alias("sum_x"), total(1).alias("sum_y"))


@query(f"""select project_key, 'simple' as roi_mode, 0.125::double as roi_left, 0.25::double as roi_top, 0.75::double as roi_right, 0.875::double as roi_bottom, 'V1_SIMPLE_RECTANGLE_ROI_MAPPED' as codes from {_INBOX}
where coalesce(len(list_filter(class_infos, lambda c: coalesce(trim(c.class_color), '') <> '' and not regexp_matches(trim(c.class_color), '^(#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{8}})|-?[0-9]{{1,9}})$'))), 0) = 0""")
def v1_written_regions(spark: SparkSession, base: str) -> DataFrame:
    """Regions of the projects written as V1, read from the nodes of their texts, with all findings about structure and region."""
    nodes = cut(xml_nodes(write_v1(*canonical(spark, base)).filter("xml is not null").withColumnRenamed("xml", "text")))
    found = structure_findings(nodes).unionByName(region_findings(nodes)).groupBy("project_key").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return regions(nodes).drop("findings").join(found, "project_key", "left")


# ---- findings about V2 projects

def _inbox(spark: SparkSession, base: str) -> DataFrame:
    return first_arrivals(read_table(spark, base, "v2_inbox"), "project_key").drop("received_at")


_FIRST = "(select project_key, any_value(project_name) as project_name, case when lower(trim(any_value(project_type))) in ('seg', 'segmentation') then 'segmentation' when lower(trim(any_value(project_type))) in ('cls', 'classification') then 'classification' when lower(trim(any_value(project_type))) in ('det', 'detection') then 'detection' else 'unknown' end as kind, any_value(class_infos) as ci, any_value(datasets) as ds, any_value(project_files) as fs from v2_inbox group by 1)"
_ID, _NO, _NAME = ("list_filter(range(1, len(ci) + 1), lambda k: ci[k].class_id = l.class_id)", "list_filter(range(1, len(ci) + 1), lambda k: coalesce(ci[k].class_no, k - 1) = l.class_no)", "list_filter(range(1, len(ci) + 1), lambda k: trim(l.class_name) <> '' and lower(trim(ci[k].class_name)) = lower(trim(l.class_name)))")
_LABEL_ROWS = rf"""
f as (select project_key, kind, ci, unnest(fs) as f, unnest(range(len(fs))) as i from {_FIRST}),
g as (select project_key, kind, ci, i, f.width as w, f.height as h, unnest(f.label_data_list) as l, unnest(range(len(f.label_data_list))) as j from f),
t as (select *, case when json_valid(l.label_contour) then case when json_type(l.label_contour) = 'VARCHAR' then json_extract_string(l.label_contour, '$') else l.label_contour end end as t from g where l is not null),
h as (select *, case when json_valid(t) then case when json_type(t, '$[0][0]') = 'ARRAY' or json_array_length(t, '$[0]') = 0 then try_cast(t as double[][][]) when json_type(t, '$[0]') = 'ARRAY' then [try_cast(t as double[][])] end end as rings, coalesce(len({_ID}), 0) as a, coalesce(len({_NO}), 0) as b, coalesce(len({_NAME}), 0) as c, ({_ID})[1] as pa, ({_NO})[1] as pb, ({_NAME})[1] as pc from t)"""
_BOX = "coalesce(l.label_pos_x, l.label_pos_y, l.label_width, l.label_height) is not null"
_WHOLE = "coalesce(l.label_pos_x is not null and l.label_pos_y is not null and l.label_width > 0 and l.label_height > 0, false)"
_FULL = "coalesce(l.label_pos_x = 0 and l.label_pos_y = 0 and l.label_width = w and l.label_height = h, false)"


@query(rf"""with {_LABEL_ROWS},
d as (select *, (l.class_id is not null and a <> 1) or (l.class_no is not null and b <> 1) or (l.class_name is not null and c <> 1) as wrong, len(list_distinct(list_filter([case when l.class_id is not null then pa end, case when l.class_no is not null then pb end, case when l.class_name is not null then pc end], lambda x: x is not null))) as kinds from h),
e as (select project_key, unnest(list_filter([
 case when l.class_id is not null and a <> 1 then 'V2_CLASS_ID_REFERENCE_INVALID' end, case when l.class_no is not null and b <> 1 then 'V2_CLASS_NUMBER_REFERENCE_INVALID' end, case when l.class_name is not null and c <> 1 then 'V2_CLASS_NAME_REFERENCE_INVALID' end,
 case when not wrong and kinds > 1 then 'V2_CLASS_REFERENCE_CONFLICT' end, case when l.class_id is null and l.class_no is null and l.class_name is null then 'V2_CLASS_REFERENCE_INVALID' end,
 case when coalesce(lower(trim(l.label_type)), '') not in ('man', 'manual') then 'V2_LABEL_ORIGIN_NOT_IN_V1' end,
 case when kind = 'classification' and {_BOX} and not {_WHOLE} then 'V2_CLASSIFICATION_GEOMETRY_INVALID' end,
 case when kind = 'segmentation' and l.label_contour is null then 'V2_LABEL_GEOMETRY_UNSUPPORTED' end,
 case when kind = 'classification' and w is not null and h is not null and {_WHOLE} and (l.label_pos_x < 0 or l.label_pos_y < 0 or l.label_pos_x + l.label_width > w or l.label_pos_y + l.label_height > h) then 'V2_LABEL_OUT_OF_BOUNDS' end,
 case when w is not null and h is not null and len(list_filter(flatten(rings), lambda p: p[1] < 0 or p[2] < 0 or p[1] > w or p[2] > h)) > 0 then 'V2_CONTOUR_OUT_OF_BOUNDS' end], lambda x: x is not null)) as code from d)
select project_key, code, count(*) as n from e group by all""")
def v2_label_findings(spark: SparkSession, base: str) -> DataFrame:
    """Findings about labels, by project and code; those about full-image geometry have a query of their own."""
    own = label_findings(_inbox(spark, base)).filter(~F.col("code").isin("V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1", "V2_CLASSIFICATION_FULL_IMAGE_GEOMETRY"))
    return own.groupBy("project_key", "code").agg(F.count("*").alias("n"))


@query(rf"""with {_LABEL_ROWS}, d as (select project_key, ({_BOX}) as boxed, {_WHOLE} as whole, {_FULL} as fits, l.label_contour is not null as drawn, coalesce(len(rings), 0) as n,
 case when len(rings) = 1 then coalesce(len(rings[1]) >= 4 and len(list_filter(rings[1], lambda p: not (p[1] between 0 and w and p[2] between 0 and h and (p[1] = 0 or p[1] = w or p[2] = 0 or p[2] = h)))) = 0
  and len(list_filter(range(1, len(rings[1]) + 1), lambda k: not ((rings[1][k][1] = rings[1][k % len(rings[1]) + 1][1] and (rings[1][k][1] = 0 or rings[1][k][1] = w)) or (rings[1][k][2] = rings[1][k % len(rings[1]) + 1][2] and (rings[1][k][2] = 0 or rings[1][k][2] = h))) or rings[1][k] = rings[1][k % len(rings[1]) + 1])) = 0
  and abs(list_sum(list_transform(range(1, len(rings[1]) + 1), lambda k: rings[1][k][1] * rings[1][k % len(rings[1]) + 1][2] - rings[1][k % len(rings[1]) + 1][1] * rings[1][k][2]))) = 2 * w * h, false) else false end as border from h where kind = 'classification'),
e as (select project_key, unnest(list_filter([case when (boxed and whole and not fits) or n > 1 or (n = 1 and not border) then 'V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1' end, case when (boxed or drawn) and (not boxed or fits) and (not drawn or (n = 1 and border)) then 'V2_CLASSIFICATION_FULL_IMAGE_GEOMETRY' end], lambda x: x is not null)) as code from d)
select project_key, code, count(*) as n from e group by all""")
def v2_full_image_findings(spark: SparkSession, base: str) -> DataFrame:
    """Which classification labels are the whole image and which can't be said in V1, by project."""
    own = label_findings(_inbox(spark, base)).filter(F.col("code").isin("V2_CLASSIFICATION_GEOMETRY_NOT_IN_V1", "V2_CLASSIFICATION_FULL_IMAGE_GEOMETRY"))
    return own.groupBy("project_key", "code").agg(F.count("*").alias("n"))


_SOME = lambda test: f"len(list_filter(fs, lambda f: f is not null and {test})) > 0"
_ANY = lambda test: f"len(list_filter(flatten(list_transform(fs, lambda f: f.label_data_list)), lambda l: l is not null and {test})) > 0"
_NORMAL = "len(list_filter(range(1, len(ci) + 1), lambda k: coalesce(ci[k].class_no = 0 and lower(trim(ci[k].class_name)) = 'ok' and not ci[k].is_ng and (k = 1 or list_sort(list_transform(ci, lambda c: c.class_no)) = range(len(ci))), false))) = 1 and len(list_filter(ci, lambda c: coalesce(c.is_ng, false))) = len(ci) - 1"


@query(rf"""select project_key, code, disposition from (select project_key, unnest(list_filter([
 case when kind not in ('classification', 'segmentation') then {{'code': 'V2_PROJECT_TYPE_UNSUPPORTED', 'disposition': 'block'}} end,
 case when kind = 'segmentation' and not coalesce({_NORMAL}, false) then {{'code': 'V2_SEGMENTATION_CLASS_STRUCTURE_INVALID', 'disposition': 'block'}} end,
 case when kind = 'segmentation' and coalesce({_NORMAL}, false) then {{'code': 'V2_SEGMENTATION_OK_CLASS_RECOGNIZED', 'disposition': 'rebuild'}} end,
 case when {_SOME('len(f.metadata) > 0')} then {{'code': 'V2_FILE_METADATA_NOT_IN_V1', 'disposition': 'drop'}} end, case when {_SOME('f.registered_date is not null')} then {{'code': 'V2_FILE_TIMESTAMP_NOT_IN_V1', 'disposition': 'drop'}} end,
 case when {_ANY('l.labeled_date is not null')} then {{'code': 'V2_LABEL_TIMESTAMP_NOT_IN_V1', 'disposition': 'drop'}} end, case when {_ANY('l.contour_size is not null')} then {{'code': 'V2_CONTOUR_SIZE_REBUILT', 'disposition': 'rebuild'}} end,
 case when kind = 'segmentation' and {_ANY(_BOX + ' and l.label_contour is not null')} then {{'code': 'V2_SEGMENTATION_BOUNDS_REBUILT', 'disposition': 'rebuild'}} end,
 case when {_SOME("len(list_filter(f.split_sets, lambda s: coalesce(s.split_name, '') <> '')) > 0")} or len(list_filter(ds, lambda d: len(list_filter(d.split_sets, lambda s: coalesce(s.split_name, '') <> '')) > 0)) > 0 then {{'code': 'V2_SPLIT_NAME_NOT_IN_V1', 'disposition': 'drop'}} end,
 case when {_SOME('len(list_filter(f.split_sets, lambda s: s.split_id is not null)) > 0')} or len(list_filter(ds, lambda d: len(list_filter(d.split_sets, lambda s: s.split_id is not null)) > 0)) > 0 then {{'code': 'V2_SPLIT_ID_REBUILT', 'disposition': 'rebuild'}} end,
 case when len(ds) > 0 then {{'code': 'V2_DATASET_IDENTITY_NOT_IN_V1', 'disposition': 'drop'}} end,
 case when len(list_filter(ci, lambda c: c.class_id is not null)) > 0 or len(list_filter(ds, lambda d: d.dataset_id is not null)) > 0 or {_SOME('f.file_id is not null')} or {_ANY('l.label_id is not null')} then {{'code': 'V2_ENTITY_IDS_REBUILT', 'disposition': 'rebuild'}} end], lambda x: x is not null)) as d from {_FIRST}), lateral (select d.code as code, d.disposition as disposition)""")
def v2_project_findings(spark: SparkSession, base: str) -> DataFrame:
    """Findings about whole projects: structure of classes, and what V1 drops or rebuilds."""
    return project_findings(_inbox(spark, base)).select("project_key", "code", "disposition")


_STATES = rf"""{_LABEL_ROWS},
r as (select project_key, i, count(*) as n, list_distinct(list_filter(list(case when not ((l.class_id is not null and a <> 1) or (l.class_no is not null and b <> 1) or (l.class_name is not null and c <> 1)) and len(list_distinct(list_filter([case when l.class_id is not null then pa end, case when l.class_no is not null then pb end, case when l.class_name is not null then pc end], lambda x: x is not null))) = 1 then coalesce(case when l.class_id is not null then pa end, case when l.class_no is not null then pb end, case when l.class_name is not null then pc end) end), lambda x: x is not null)) as classes, bool_and(not ({_BOX}) and l.label_contour is null and l.contour_size is null) as bare from h group by 1, 2),
x as (select f.project_key, f.i, f.kind, f.f.is_labeled as labeled, coalesce(r.n, 0) as n, coalesce(r.classes, []) as classes, coalesce(r.bare, false) as bare, case when len(list_filter(range(1, len(ci) + 1), lambda k: ci[k].class_id = f.f.class_id)) = 1 then list_filter(range(1, len(ci) + 1), lambda k: ci[k].class_id = f.f.class_id)[1] end as fc, case when {_NORMAL} then list_filter(range(1, len(ci) + 1), lambda k: coalesce(ci[k].class_no = 0 and lower(trim(ci[k].class_name)) = 'ok' and not ci[k].is_ng, false))[1] end as nc from f left join r using (project_key, i) where f.f is not null),
y as (select *, case when len(classes) = 1 then classes[1] end as lc, coalesce(kind = 'segmentation' and n = 1 and labeled and nc is not null and len(classes) = 1 and classes[1] = nc and (fc is null or fc = nc) and bare, false) as marker from x)"""


@query(rf"""with {_STATES} select project_key, i::int as file_index, case when kind = 'segmentation' then case when marker then 'normal' when n > 0 then 'defect' when labeled = false then 'unlabeled' when labeled and fc = nc then 'normal' else 'unknown' end when kind = 'classification' then case when (n = 0 and fc is not null) or (n > 0 and (fc is null or lc is null or fc = lc) and coalesce(lc, fc) is not null) then 'classified' else 'unknown' end end as state from y""")
def v2_file_states(spark: SparkSession, base: str) -> DataFrame:
    """Whether each file is normal, defect, unlabeled, classified or neither can be told."""
    return file_states(_inbox(spark, base)).select("project_key", "file_index", "state")


_MEMBERS = f"select project_key, i, coalesce(len(f.split_sets), 0) as m, len(list_distinct(list_filter(list_transform(f.split_sets, lambda s: {_KIND}), lambda t: t is not null))) as k from f where f is not null"


@query(rf"""with {_STATES}, s as ({_MEMBERS}), e as (select project_key, unnest(list_filter([
 case when kind = 'classification' and n = 0 and fc is null then 'V2_CLASSIFICATION_CLASS_MISSING' end, case when kind = 'classification' and n > 1 then 'V2_CLASSIFICATION_MULTIPLE_LABELS' end, case when kind = 'classification' and n > 0 and fc <> lc then 'V2_CLASSIFICATION_CLASS_CONFLICT' end, case when kind = 'classification' and labeled = false and (n > 0 or fc is not null) then 'V2_CLASSIFICATION_STATE_CONFLICT' end,
 case when kind = 'segmentation' and not marker and n > 0 and labeled = false then 'V2_SEGMENTATION_LABEL_STATE_CONFLICT' end, case when kind = 'segmentation' and not marker and n > 0 and nc is not null and (list_contains(classes, nc) or coalesce(fc = nc, false)) then 'V2_SEGMENTATION_NORMAL_CLASS_CONTOUR_CONFLICT' end,
 case when kind = 'segmentation' and n = 0 and labeled = false and fc is not null then 'V2_SEGMENTATION_UNLABELED_CLASS_CONFLICT' end, case when kind = 'segmentation' and n = 0 and coalesce(labeled, true) and not coalesce(labeled and fc = nc, false) then 'V2_SEGMENTATION_EMPTY_LABEL_STATE_AMBIGUOUS' end], lambda x: x is not null)) as code from y
 union all select project_key, case when m = 0 then 'V2_SPLIT_MISSING' when k > 1 then 'V2_SPLIT_CONFLICT' when m > 1 then 'V2_MULTIPLE_SPLIT_MEMBERSHIPS' end from s)
select project_key, code, count(*) as n from e where code is not null group by all""")
def v2_file_findings(spark: SparkSession, base: str) -> DataFrame:
    """Findings about files, by project and code."""
    return file_findings(_inbox(spark, base)).groupBy("project_key", "code").agg(F.count("*").alias("n"))


@query(f"""with o(source_format, target) as (values {", ".join(f"('{k}', '{t}')" for k, v in OUTPUTS.items() for t in v)}), p as (select distinct project_key, source_format, case when lower(trim(project_type)) in ('seg', 'segmentation') then 'segmentation' when lower(trim(project_type)) in ('cls', 'classification') then 'classification' end as kind from projects)
select source_format, target, count(*) as n from p join o using (source_format) where kind is not null group by all""")
def allowed_targets(spark: SparkSession, base: str) -> DataFrame:
    """How many projects of each source format may become each output."""
    rows = first_arrivals(read_table(spark, base, "projects", "project_key", "source_format", "project_type", "received_at"), "project_key")
    rows = rows.select("project_key", "source_format", codes.mapped(F.col("project_type"), codes.PROJECT_TYPES).alias("project_type"))
    nothing = rows.select("project_key", F.lit("").alias("code"), F.lit("").alias("disposition")).limit(0)
    return target_readiness(rows, nothing).join(rows.select("project_key", "source_format"), "project_key").groupBy("source_format", "target").agg(F.count("*").alias("n"))


# ---- packages

_UNSAFE = r"""(trim(entry_name) = '' or regexp_matches(entry_name, '[\x00-\x1f\x7f]') or starts_with(replace(entry_name, '\', '/'), '/') or regexp_matches(entry_name, '^[A-Za-z]:') or len(list_filter(string_split(replace(entry_name, '\', '/'), '/'), lambda s: s in ('.', '..') or regexp_matches(s, '[<>:"|?*]') or ends_with(s, ' ') or ends_with(s, '.') or strlen(s) > 255 or regexp_matches(s, '^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])([ .]|$)'))) > 0)"""


@query(rf"""with e as (select distinct project_key, entry_name, uncompressed_size as size from archive_entries where not is_dir),
s as (select project_key, count(*) + 4 as n_entries, sum(coalesce(size, 0))::bigint as n_bytes, sum(strlen(entry_name))::bigint as n_name_bytes, max(size) as largest, max(strlen(entry_name)) as longest, bool_or({_UNSAFE}) as bad, count(*) > count(distinct lower(replace(entry_name, '\', '/'))) as twice from e group by 1)
select project_key, n_entries, n_bytes, n_name_bytes, (n_bytes + n_entries * 512 + n_name_bytes * 2 + 65536)::bigint as estimated_bytes, n_bytes + n_entries * 512 + n_name_bytes * 2 + 65536 >= 4294967295 or n_entries >= 65535 as zip64,
 case when n_entries > 20000 then 'OUTPUT_ARCHIVE_ENTRY_LIMIT_EXCEEDED' when bad then 'OUTPUT_ARCHIVE_ENTRY_PATH_UNSAFE' when longest > 4096 then 'OUTPUT_ARCHIVE_ENTRY_NAME_LIMIT_EXCEEDED' when n_name_bytes > 8388608 then 'OUTPUT_ARCHIVE_ENTRY_NAMES_TOTAL_LIMIT_EXCEEDED' when twice then 'OUTPUT_ARCHIVE_ENTRY_DUPLICATE' when largest > 4294967296 then 'OUTPUT_ARCHIVE_ENTRY_SIZE_LIMIT_EXCEEDED' when n_bytes > 34359738368 then 'OUTPUT_ARCHIVE_TOTAL_SIZE_LIMIT_EXCEEDED' end as limit_code from s""")
def package_plans(spark: SparkSession, base: str) -> DataFrame:
    """Sizes and limits of the packages that the listed entries would make."""
    rows = read_table(spark, base, "archive_entries", "project_key", "entry_name", "uncompressed_size", "is_dir").filter("not is_dir").select("project_key", "entry_name", F.col("uncompressed_size").alias("size")).distinct()
    return package_plan(rows, "project_key", "svpa")


@query()
def manifest_item_findings(spark: SparkSession, base: str) -> DataFrame:
    """What stands against each manifest entry of each package."""
    entries = first_arrivals(read_table(spark, base, "manifest_entries"), "entry_id")
    items = entries.select(F.col("project_key").alias("archive"), F.col("entry_id").alias("position"), "original_path", "relative_path", F.lit("").alias("directory"), F.lit("project/project.srproj").alias("project_file"))
    listing = read_table(spark, base, "archive_entries", F.col("project_key").alias("archive"), F.col("entry_name"))
    return item_findings(items, listing).withColumnRenamed("archive", "project_key")


# ---- identities, names and images

_PATH = reference._sql_path("source_path")
_LAST = "coalesce(list_filter(string_split({0}, '/'), lambda s: s <> '' and s <> '.')[-1], '')"
_FNV = reference._FNV


@query(f"""with p as (select project_key, any_value(project_name) as name from projects where project_name is not null group by 1),
c as (select project_key, string_agg('[' || class_index || ',' || to_json(class_name)::varchar || ']', ',' order by class_index, class_name) as cs from (select distinct project_key, class_index, class_name from project_classes where class_index is not null and class_name is not null) group by 1),
f as (select project_key, string_agg('[' || file_index || ',' || to_json({_PATH})::varchar || ',' || to_json(file_name)::varchar || ']', ',' order by file_index, {_PATH}, file_name) as fs from (select distinct project_key, file_index, source_path, file_name from project_files where file_index is not null and source_path is not null and file_name is not null) group by 1),
i as (select project_key, '{{"name":' || to_json(name)::varchar || ',"classes":[' || coalesce(cs, '') || '],"files":[' || coalesce(fs, '') || ']}}' as identity from p left join c using (project_key) left join f using (project_key))
select project_key, 100000 + {_FNV.format('identity')} % 700000 as number from i""")
def project_numbers(spark: SparkSession, base: str) -> DataFrame:
    """Project numbers made of the whole identity: name, classes and files."""
    projects = read_table(spark, base, "projects", "project_key", "project_name").filter("project_name is not null").groupBy("project_key").agg(F.min("project_name").alias("name"))
    classes = read_table(spark, base, "project_classes", "project_key", "class_index", "class_name").dropna().distinct().groupBy("project_key").agg(F.collect_list(F.struct(F.col("class_index").alias("index"), F.col("class_name").alias("name"))).alias("cs"))
    files = read_table(spark, base, "project_files", "project_key", "file_index", "source_path", "file_name").dropna().distinct()
    files = files.groupBy("project_key").agg(F.collect_list(F.struct(F.col("file_index").alias("index"), paths.normalize_path(F.col("source_path")).alias("path"), "file_name")).alias("fs"))
    joined = projects.join(classes, "project_key", "left").join(files, "project_key", "left")
    listed = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    return joined.select("project_key", codes.project_number(codes.project_identity(F.col("name"), listed("cs", classes), listed("fs", files))).alias("number"))


@query(r"""with n as (select distinct file_name, rtrim(regexp_replace(file_name, '[\x00-\x1f\x7f<>:"|?*\\/]', '_', 'g'), '. ') as clean from project_files where file_name is not null)
select file_name, case when clean = '' then '_' when regexp_matches(clean, '^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])([ .]|$)') then '_' || clean else clean end as safe, case when strlen(file_name) <= 12 then file_name else file_name[:length(file_name) - len(list_filter(range(1, length(file_name) + 1), lambda i: strlen(file_name[:i]) > 12))] end as fitted from n""")
def file_names(spark: SparkSession, base: str) -> DataFrame:
    """File names made safe, and cut to twelve bytes at whole characters."""
    names = read_table(spark, base, "project_files", "file_name").filter("file_name is not null").distinct()
    return names.select("file_name", paths.safe_file_name(F.col("file_name")).alias("safe"), paths.fit_utf8(F.col("file_name"), 12).alias("fitted"))


def _bytes(value: Column, n: int, little: bool) -> Column:
    """Hexadecimal text of a number in ``n`` bytes."""
    digits = F.lpad(F.hex(value), 2 * n, "0")
    return F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))), "") if little else digits


@query("""with f as (select distinct file_uid, case when regexp_matches(width, '^[0-9]{1,9}$') then width::bigint end as w from project_files), s as (select *, case when w between 1 and 65535 then w else 1 + file_uid % 4000 end as width, 1 + file_uid % 3000 as height from f)
select distinct file_uid, ['png', 'gif', 'bmp', 'jpeg', 'webp', 'unknown'][(file_uid % 6 + 1)::int] as format, case when file_uid % 6 < 5 then width end as width, case when file_uid % 6 < 5 then height end as height, case when file_uid % 6 = 5 then 'IMAGE_FORMAT_UNSUPPORTED' end as issue from s""")
def image_headers(spark: SparkSession, base: str) -> DataFrame:
    """Headers of five formats made for the sizes of the files, and what is read from them again."""
    files = read_table(spark, base, "project_files", "file_uid", "width").distinct()
    wide = F.when(F.col("width").rlike("^[0-9]{1,9}$"), F.col("width").try_cast("bigint"))
    sized = files.select("file_uid", F.when(wide.between(1, 65535), wide).otherwise(F.col("file_uid") % 4000 + 1).alias("w"), (F.col("file_uid") % 3000 + 1).alias("h")).distinct()
    w, h, lit = F.col("w"), F.col("h"), F.lit
    kinds = [
        F.concat(lit("89504E470D0A1A0A0000000D49484452"), _bytes(w, 4, False), _bytes(h, 4, False)), F.concat(lit("474946383961"), _bytes(w, 2, True), _bytes(h, 2, True)), F.concat(lit("424D") , lit("00" * 12), lit("28000000"), _bytes(w, 4, True), _bytes(h, 4, True)),
        F.concat(lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), _bytes(h, 2, False), _bytes(w, 2, False), lit("03")), F.concat(lit("524946460000000057454250565038580A00000000000000"), _bytes(w - 1, 3, True), _bytes(h - 1, 3, True)), lit("00112233"),
    ]
    content = F.unhex(F.element_at(F.array(*kinds), (F.col("file_uid") % 6 + 1).cast("int")))
    return sized.select("file_uid", image_header(content).alias("i")).select("file_uid", "i.format", "i.width", "i.height", "i.issue").distinct()


@query("select project_key, entry_name is not null as in_archive, count(*) as n from (select m.project_key, a.entry_name from (select distinct project_key, entry_id, relative_path from manifest_entries) m left join (select distinct project_key, entry_name from archive_entries) a on a.project_key = m.project_key and a.entry_name = m.relative_path) group by all")
def archived_images(spark: SparkSession, base: str) -> DataFrame:
    """How many images of each package lie in its archive under the very name that the manifest gives."""
    files = read_table(spark, base, "manifest_entries", "project_key", "entry_id", "relative_path").distinct()
    files = files.select(F.col("project_key").alias("scope"), F.col("entry_id").alias("file_index"), F.lit("archive").alias("kind"), F.col("relative_path").alias("entry_name"))
    entries = read_table(spark, base, "archive_entries", F.col("project_key").alias("scope"), "entry_name")
    nothing = files.select("scope", F.col("file_index").alias("ref_id"), F.lit("missing").alias("status"), F.lit(None).cast("long").alias("cand_id")).limit(0)
    found = resolve_images(files, entries, nothing)
    return found.groupBy(F.col("scope").alias("project_key"), F.col("issue").isNull().alias("in_archive")).agg(F.count("*").alias("n"))


@query("select count(distinct file_uid) as n, min(file_uid) as low, max(file_uid) as high from project_files")
def streamed_arrivals(spark: SparkSession, base: str) -> DataFrame:
    """First arrivals of a table read as a stream until it is used up: redeliveries are dropped with the watermark's state."""
    table = f"arrivals_{uuid.uuid4().hex}"
    at = f"{ensure_checkpoint_dir(spark)}/{table}"
    stream = first_arrivals_of_stream(stream_table(spark, f"{base}/project_files.parquet").select("file_uid", "received_at"), ["file_uid"], wait="3650 days")
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file_uid long, received_at timestamp").parquet(f"{at}/rows").agg(F.count("*").alias("n"), F.min("file_uid").alias("low"), F.max("file_uid").alias("high"))


@query(r"""with p as (select row_number() over () as rid, feed_id, batch_no, payload, json_valid(payload) as ok from raw_exports), t as (select x.rid, count(*) as n, max(case when j.type in ('OBJECT', 'ARRAY') then 1 + len(regexp_extract_all(j.fullkey, '\.|\[')) else 0 end) as depth from (select * from p where ok) x, json_tree(x.payload) j group by 1)
select feed_id, batch_no, count(*) as n_rows, count_if(not ok) as n_invalid, coalesce(sum(t.n), 0)::bigint as n_values, max(t.depth)::int as depth from p left join t using (rid) group by all""")
def payload_usage(spark: SparkSession, base: str) -> DataFrame:
    """Values and depth of the JSON texts of each batch of exports, and how many are none."""
    rows = read_table(spark, base, "raw_exports", "feed_id", "batch_no", "payload").withColumn("project_key", F.col("feed_id") * 1_000_000 + F.col("batch_no"))
    used = json_usage(rows.withColumnRenamed("payload", "text"))
    sums = used.groupBy("project_key").agg(F.count("*").alias("n_rows"), F.count("code").alias("n_invalid"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"), F.max("depth").alias("depth"))
    return sums.select((F.col("project_key") / 1_000_000).cast("long").alias("feed_id"), (F.col("project_key") % 1_000_000).cast("int").alias("batch_no"), "n_rows", "n_invalid", "n_values", "depth")


@query(f"""with p as (select feed_id, row_number() over () as rid, payload from raw_exports where json_valid(payload)), k as (select p.feed_id, p.rid, j.key, j.type, j.value from p, json_each(p.payload) j)
select feed_id, key as field, count(*) as n from k where key not in ({", ".join(f"'{f}'" for f in FIELDS["project"])}) and type <> 'NULL' and value::varchar not in ('""', '[]', '{{}}') group by all""")
def unmapped_fields(spark: SparkSession, base: str) -> DataFrame:
    """Fields of the exported records that a V2 project doesn't have, by feed."""
    rows = read_table(spark, base, "raw_exports", "feed_id", "payload").select(F.col("feed_id").alias("project_key"), F.concat(F.lit('{"project": '), "payload", F.lit("}")).alias("text"))
    found = json_findings(rows).filter("code = 'V2_UNMAPPED_FIELD'")
    return found.groupBy(F.col("project_key").alias("feed_id"), F.regexp_extract("path", r"^\$\.project\.(.*)$", 1).alias("field")).agg(F.count("*").alias("n"))


@query(f"""with {_WRITTEN} select project_key, 'simple' as mode, 0.125::double as "left", 0.25::double as top, 0.75::double as "right", 0.875::double as bottom, 'V2_SIMPLE_RECTANGLE_ROI,V2_ROI_SHAPE_REBUILT' as codes from {_INBOX} where project_key not in (select project_key from d)""")
def v2_written_regions(spark: SparkSession, base: str) -> DataFrame:
    """Regions of the projects written as V2, read from their boundaries and their drawings, with the findings about both."""
    built = build_v2(*canonical(spark, base)).filter("json is not null")
    field = lambda name, kind: F.get_json_object("json", f"$.project.{name}").cast(kind)
    rows = built.select("project_key", field("roiMode", "string").alias("roi_mode"), *[field(n, "double").alias(c) for n, c in (("roiPosX", "roi_pos_x"), ("roiPosY", "roi_pos_y"), ("roiWidth", "roi_width"), ("roiHeight", "roi_height"))], *[field(n, "string").alias(c) for n, c in (("roiShapeType", "roi_shape_type"), ("roiShape", "roi_shape"), ("roiBitmap", "roi_bitmap"))])
    return v2_regions(rows).select("project_key", "mode", "left", "top", "right", "bottom", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))
