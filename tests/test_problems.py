"""Units, nested records, drift and orphans on small fixtures."""

import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from weftlens.operators.drift import aliases, consistent_table, path_values, schema_changes
from weftlens.operators.nested import flatten_inbox, flatten_tables, read_rings
from weftlens.operators.orphans import find_orphans, numbered_paths, parent_keys, parent_runs
from weftlens.operators.units import normalise_quantities
from weftlens.sources.tables import first_arrivals

T = datetime


def test_units(spark):
    rows = [
        (1, "1 077,5 mm", "px", "fraction", ",", 10.0, 1000, 107750.0, "ok"), (2, "1,004PX", None, "mm", ".", 10.0, 1000, 1004.0, "ok"), (3, "5.5e-1", None, "fraction", ".", 10.0, 1000, 550.0, "ok"),
        (4, "≈ 12 ％", "mm", "px", ".", 10.0, 1000, 120.0, "ok"), (5, "1 thou", None, "px", ".", 2.54, 10, 10.0, "ok"), (6, "200", "um", "px", ".", 5.0, 10, 40.0, "ok"), (7, "see drawing", None, "px", ".", 5.0, 10, None, "no_number"),
        (8, None, None, "px", ".", 5.0, 10, None, "no_number"), (9, "4 furlong", None, "px", ".", 5.0, 10, None, "unknown_unit"), (10, "4 mm", None, "px", ".", None, 10, None, "no_scale"), (11, "+450", "", "px", ".", 5.0, 10, 450.0, "ok"), (12, "9" * 5000, None, "px", ".", 5.0, 10, None, None),
    ]
    df = spark.createDataFrame([r[:7] + ("clash",) for r in rows], "id int, t string, u string, d string, m string, s double, f int, number string")
    found = {r["id"]: r for r in normalise_quantities(df, "t", "u", "d", "m", "s", "f").collect()}
    assert len(found) == len(rows) and found[1]["number_in"] == "clash"
    for i, *_, px, status in rows:
        if status:
            assert found[i]["unit_status"] == status and (px is None and found[i]["value_px"] is None or abs(found[i]["value_px"] - px) < 1e-6), rows[i - 1]
    assert normalise_quantities(df.limit(0), "t", "u", "d", "m", "s", "f").count() == 0


INBOX = """project_key long, class_infos array<struct<class_id:long,class_name:string,class_no:long>>,
 project_files array<struct<file_id:long,label_data_list:array<struct<class_id:long,class_no:long,class_name:string,label_contour:string>>>>, received_at timestamp"""


def test_rings(spark):
    ring = "[[1,2],[3,4],[5,6.5]]"
    classes = [(7, "Burr", 1), (9, "Chip", 2)]
    labels = [(9, None, None, f"[{ring}, {ring}]"), (None, 1, None, ring), (None, None, "Chip", json.dumps(f"[{ring}]")), (5, 1, "Burr", f"[{ring}"), (None, None, None, None), (None, None, "x", "[]"), None]
    rows = [(1, classes, [(1, labels), (None, []), (3, None), None], T(2024, 1, 1)), (2, None, None, T(2024, 1, 1)), (3, None, [], T(2024, 1, 2)), (3, None, [], T(2024, 1, 3))]
    df = first_arrivals(spark.createDataFrame(rows, INBOX), "project_key")
    found = sorted(tuple(r) for r in flatten_inbox(df).select("project_key", "file_pos", "label_pos", "ring_pos", "n_points", "class_id").collect())
    assert found == sorted([
        (1, 0, 0, 0, 3, 9), (1, 0, 0, 1, 3, 9), (1, 0, 1, 0, 3, 7), (1, 0, 2, 0, 3, 9), (1, 0, 3, -1, 0, -1), (1, 0, 4, -1, 0, -1), (1, 0, 5, -1, 0, -1), (1, 0, 6, -1, 0, -1),
        (1, 1, -1, -1, 0, -1), (1, 2, -1, -1, 0, -1), (1, 3, -1, -1, 0, -1), (2, -1, -1, -1, 0, -1), (3, -1, -1, -1, 0, -1),
    ])


def test_ring_texts(spark):
    """Where the marks stand doesn't matter, nor how far apart, nor that the first ring is empty."""
    texts = ["[" + " " * 300 + "[\n\t[1,2],[3,4],[5,6]]]", "[[], [[1,2],[3,4],[5,6]]]", "[ [1,2], [3,4] ]", "[[]]", "[[1,2],[3,4]", "[1,2]", "[]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", read_rings(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in rows] == [[[[1, 2], [3, 4], [5, 6]]], [[], [[1, 2], [3, 4], [5, 6]]], [[[1, 2], [3, 4]]], [[]], None, None, None, None]


def test_labels_carry_the_positions(spark):
    ring = "[[1,2],[3,4],[5,6]]"
    df = spark.createDataFrame([(-7, None, [(1, [(None, None, None, f"[{ring}, [], {ring}]")]), (2, None)], T(2024, 1, 1)), (8, None, None, T(2024, 1, 1))], INBOX)
    assert sorted((r["node"], r["parent"], r["file_pos"], r["label_pos"], r["ring_pos"]) for r in flatten_inbox(df).collect()) == [("-7.0.0.0", "-7.0.0", 0, 0, 0), ("-7.0.0.2", "-7.0.0", 0, 0, 2), ("-7.1", "-7", 1, -1, -1), ("8", None, -1, -1, -1)]


def test_dewey_links(spark):
    df = spark.createDataFrame([(5, [(1, [("a",), ("b",)]), (2, None)])], "id long, xs array<struct<node:long,ys:array<struct<t:string>>>>")
    tables = flatten_tables(df, "id")
    assert set(tables) == {"", "xs", "xs.ys"}
    assert [tuple(r) for r in tables["xs.ys"].orderBy("node").collect()] == [("5.0.0", "5.0", 0, "a"), ("5.0.1", "5.0", 1, "b")]
    assert tables["xs"].columns == ["node", "parent", "ordinal", "node_"]
    assert flatten_tables(df.limit(0), "id")["xs.ys"].count() == 0


def _exports(spark, batches):
    rows = [(1, b, pid, json.dumps(rec) if isinstance(rec, dict) else rec, T(2024, 1, b)) for b, recs in batches.items() for pid, rec in recs]
    return spark.createDataFrame(rows, "feed_id long, batch_no int, project_id long, payload string, received_at timestamp")


def test_changes(spark):
    old = [(i, {"Version": f"{i}", "roiPosX": i / 7, "gone": None, "kept": i}) for i in range(4)]
    new = [(i, {"version": f"{i}", "roi": {"posX": i / 7}, "kept": str(i)}) for i in range(4)]
    df = _exports(spark, {1: [*old, (None, '{"cut'), old[0]], 2: new, 4: [(1, {"far": 1})]})
    found = {tuple(r)[1:] for r in schema_changes(df).collect()}
    assert found == {(2, "version", "renamed", "Version"), (2, "roi.posX", "renamed", "roiPosX"), (2, "roi", "added", ""), (2, "gone", "removed", ""), (2, "kept", "retyped", "")}


def test_two_known_values_are_no_renaming(spark):
    df = _exports(spark, {1: [(1, {"a": 1, "k": 1}), (2, {"a": 2, "k": 1}), (3, {"a": None, "k": 1})], 2: [(1, {"b": 1, "k": 1}), (2, {"b": 2, "k": 1}), (3, {"b": None, "k": 1})]})
    assert {tuple(r)[2:4] for r in schema_changes(df).collect()} == {("b", "added"), ("a", "removed")}
    assert schema_changes(df.limit(0)).count() == 0


def test_consistent_table(spark):
    df = _exports(spark, {1: [(1, {"roiPosX": 0.5, "x": [1]}), (2, {"roi": {"posX": "wide"}}), (3, "{}"), (None, None)]})
    found = {r["project_id"]: r for r in consistent_table(df, {"pos_x": ("double", ["roiPosX", "roi.posX"])}).collect()}
    assert found[1]["pos_x"] == 0.5 and found[1]["unmapped"] == {"x": "[1]"} and found[2]["failed_casts"] == ["pos_x"] and found[2]["pos_x"] is None
    kept = _exports(spark, {1: [(1, {}), (2, {"o": {}}), (3, '{"cut')]})
    rows = {r["project_id"]: r for r in consistent_table(kept, {"a": ("double", ["a"])}).collect()}
    assert set(rows) == {1, 2, 3} and rows[1]["unmapped"] == rows[2]["unmapped"] == {} and rows[3]["unmapped"] is None and consistent_table(kept.limit(0), {"a": ("double", ["a"])}).count() == 0
    clash = path_values(spark.createDataFrame([("k", '{"a":1}')], "path string, payload string"), "payload")
    assert [tuple(r) for r in clash.collect()] == [("k", "a", "number", "1.0")]


def test_renamings_are_applied(spark):
    recs = lambda name: [(i, {name: f"v{i}", "n": i}) for i in range(5)]
    df = _exports(spark, {1: recs("Version"), 2: recs("version"), 3: recs("ver"), 4: [(i, {"ver": [i], "n": "x"}) for i in range(5)]})
    found = aliases(schema_changes(df), {"v": ("string", ["Version"]), "n": ("bigint", ["n"])})
    assert found == {"v": ("string", ["Version", "ver", "version"]), "n": ("bigint", ["n"])}
    rows = {(r["batch_no"], r["project_id"]): r for r in consistent_table(df, found).collect()}
    assert len(rows) == 20 and all(rows[b, i]["v"] == f"v{i}" and rows[b, i]["n"] == i and rows[b, i]["failed_casts"] == [] for b in (1, 2, 3) for i in range(5))
    assert rows[4, 1]["v"] == "[1]" and rows[4, 1]["n"] is None and rows[4, 1]["failed_casts"] == ["n"]


def test_orphans_equal_brute_force(spark):
    """Runs of live and deleted keys, holes, block edges and arrivals on either side, against every key looked up."""
    rng = random.Random(6)
    at = lambda: T(2024, rng.randint(1, 12), rng.randint(1, 28))
    parents = [(rng.randint(1, 3), k, at() if rng.random() < 0.3 else None, at()) for k in [*range(65_500, 65_580), *range(-20, 20)] for _ in range(rng.choice([0, 1, 1, 2]))]
    refs = [(i, rng.choice([1, 2, 3, None]), rng.choice([rng.randint(65_490, 65_590), rng.randint(-30, 30)]), at()) for i in range(1500)]
    expected = set()
    for i, scope, key, seen in refs:
        live = [r for s, k, d, r in parents if (s, k) == (scope, key) and d is None]
        have = [1 for s, k, _, _ in parents if (s, k) == (scope, key)]
        kind = "missing" if not have else "deleted" if not live else "late" if min(live) > seen else None
        if kind:
            expected.add((i, kind, f"{seen:%Y-%m}"))
    df, pf = spark.createDataFrame(refs, "row_id long, scope long, key long, received_at timestamp"), spark.createDataFrame(parents, "scope long, key long, deleted_at timestamp, received_at timestamp")
    assert {tuple(r) for r in find_orphans(df, pf).collect()} == expected and {k for _, k, _ in expected} == {"missing", "deleted", "late"}
    runs = parent_runs(parent_keys(pf)).collect()
    assert sum(r["run_end"] - r["run_start"] + 1 for r in runs) == parent_keys(pf).count() and len(runs) < parent_keys(pf).count() and all(r["run_start"] >> 16 == r["run_end"] >> 16 for r in runs)


def test_numbered_paths(spark):
    paths = ["a/IMG_0009.png", "A\\img_0010.PNG", "a/img_10.png", "a/readme", "a/x" + "9" * 25, "", None, "ａ/img_0011.png", "img_7/0012.png", "a/Ａ.png"]
    rows = spark.createDataFrame([(i, 1, p) for i, p in enumerate(paths)], "i int, project long, path string")
    rows = numbered_paths(rows, "project", "path").orderBy("i").collect()
    scope, key = [r["scope"] for r in rows], [r["key"] for r in rows]
    assert scope[0] == scope[1] == scope[7] != scope[2] and key[:3] == [9, 10, 10] and key[7] == 11 and key[3] == 0 and key[4] == 10**18 - 1 and key[6] is None and key[8] == 12
    assert len({(str(s), k) for s, k in zip(scope, key)}) == len(paths)
    clash = numbered_paths(spark.createDataFrame([(1, "a1", 5)], "project long, path string, key int"), "project", "path").first()
    assert clash["key"] == 1 and clash["key_in"] == 5 and numbered_paths(spark.createDataFrame([], "project long, path string"), "project", "path").count() == 0
    refs = spark.createDataFrame([(i, 1, f"d/f_{n:04d}.png", T(2024, 5, 1)) for i, n in enumerate((3, 7, 12))], "entry_id long, project long, path string, received_at timestamp").withColumnRenamed("entry_id", "row_id")
    refs = numbered_paths(refs, "project", "path")
    files = spark.createDataFrame([(1, f"d\\F_{n:04d}.PNG", None, T(2024, 1, 1)) for n in range(1, 11) if n != 7], "project long, path string, deleted_at timestamp, received_at timestamp")
    files = numbered_paths(files, "project", "path")
    assert {tuple(r) for r in find_orphans(refs, files).collect()} == {(1, "missing", "2024-05"), (2, "missing", "2024-05")}
    assert parent_runs(parent_keys(files)).count() == 2  # nine files, two runs


def test_orphans(spark):
    refs = spark.createDataFrame(
        [(1, 1, 0, T(2024, 3, 5)), (2, 1, 1, T(2024, 3, 5)), (3, 1, 2, T(2024, 3, 5)), (3, 1, 2, T(2024, 9, 5)), (4, 1, 7, T(2024, 4, 1)), (5, 1, None, T(2024, 4, 1)), (6, None, 1, T(2024, 4, 1)), (7, 1, -1, T(2024, 4, 1)), (8, 1, 2, T(2024, 12, 31, 23, 59))],
        "row_id long, scope long, key long, received_at timestamp",
    )
    parents = spark.createDataFrame([(1, 0, None, T(2024, 1, 1)), (1, 1, T(2024, 2, 1), T(2024, 1, 1)), (1, 2, None, T(2024, 6, 1)), (1, 2, T(2024, 1, 2), T(2024, 1, 1)), (2, 7, None, T(2020, 1, 1))], "scope long, key long, deleted_at timestamp, received_at timestamp")
    expected = {(2, "deleted", "2024-03"), (3, "late", "2024-03"), (4, "missing", "2024-04"), (6, "missing", "2024-04"), (7, "missing", "2024-04")}
    assert {tuple(r) for r in find_orphans(refs, parents).collect()} == expected
    wide = lambda df: df.withColumns({"scope": F.expr("if(scope is null, null, struct(scope as project, 5 as a))"), "key": F.col("key") * 70_000})
    assert {tuple(r) for r in find_orphans(wide(refs), wide(parents)).collect()} == expected
    assert find_orphans(refs, parents.limit(0)).count() == 7 and find_orphans(refs.limit(0), parents).count() == 0
