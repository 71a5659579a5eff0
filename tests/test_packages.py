"""Packages written, read again and judged; manifests with every fault; plans against their limits."""

import json

import pytest

from weftlens.sinks.packages import equal_contents, image_names, output_stem, package_plan, svpa_entries, vision_entries
from weftlens.sinks.projects import write_archives
from weftlens.sources import v1_xml
from weftlens.sources.archives import read_archives, read_stored_archives
from weftlens.sources.packages import bind_images, item_findings, manifest_items, package_kinds, read_manifests
from pyspark.sql import functions as F

XML = "<Project><Version>0.9</Version><Type>Classification</Type><ImageGroup><NumberOfImages>2</NumberOfImages><Image><Path>a.png</Path></Image><Image><Path>C:\\w\\B.PNG</Path></Image></ImageGroup></Project>"


@pytest.mark.parametrize("read", [read_archives, read_stored_archives])
def test_round_trip(spark, tmp_path, read):
    projects = spark.createDataFrame([(1, "lot: 7", XML, '{"project": {}}'), (2, None, None, '{"project": {}}')], "project_key long, project_name string, xml string, json string")
    images = spark.createDataFrame([(1, 0, "C:/w/a.png", "a.png", bytearray(b"A")), (1, 1, "C:/w/b.png", "A.png", bytearray(b"B")), (1, 2, "c:\\w\\A.PNG", "x", bytearray(b"A")), (2, 0, "q", None, bytearray(b"Q"))], "project_key long, file_index int, source_path string, file_name string, content binary")
    written = write_archives(svpa_entries(projects, images, "C:/w").unionByName(vision_entries(projects, images)), str(tmp_path)).collect()
    assert {(r["archive"], r["n_entries"]) for r in written} == {("1/lot_ 7.zip", 5), ("1/lot_ 7.visionproj", 4), ("2/project.visionproj", 2)}
    entries = read(spark, str(tmp_path), whole=r"\.(json|srproj|txt)$").withColumnRenamed("prefix", "content")
    short = lambda a: "/".join(a.split("/")[-2:])
    kinds = {short(r["archive"]): (r["format"], r["project_entry"], r["code"]) for r in package_kinds(entries).collect()}
    assert kinds == {"1/lot_ 7.zip": ("v1-svpa", "svpa_manifest.json", None), "1/lot_ 7.visionproj": ("v2-visionproj", "lot_ 7.json", None), "2/project.visionproj": ("v2-visionproj", "project.json", None)}
    manifests = read_manifests(entries)
    (m,) = manifests.collect()
    assert m["code"] is None and m["project_file"] == "project/lot_ 7.srproj" and m["directory"] == "C:/w"
    items = manifest_items(manifests)
    assert [(r["original_path"], r["relative_path"]) for r in items.orderBy("position").collect()] == [("C:/w/a.png", "images/a.png"), ("C:/w/b.png", "images/A_2.png")]
    assert item_findings(items, entries.select("archive", "entry_name")).count() == 0
    files = v1_xml.files(v1_xml.parse_v1(entries.filter("entry_name like '%.srproj'").select(F.col("archive").alias("project_key"), F.decode("content", "UTF-8").alias("text")))).select(F.col("project_key").alias("archive"), "file_index", "source_path")
    assert {(r["file_index"], r["relative_path"], r["code"]) for r in bind_images(files, items).collect()} == {(0, "images/a.png", None), (1, "images/A_2.png", None)}


def test_faulty_manifests(spark):
    whole = {"ProjectFile": "p/x.srproj", "OriginalProjectDirectory": "C:/w", "Entries": []}
    cases = [
        ("{", "SVPA_MANIFEST_JSON_INVALID"), ("[]", "SVPA_MANIFEST_ROOT_INVALID"), ({**whole, "ProjectFile": " "}, "SVPA_MANIFEST_FIELD_INVALID"), ({"Entries": []}, "SVPA_MANIFEST_FIELD_INVALID"), ({**whole, "ProjectFile": 5}, "SVPA_MANIFEST_FIELD_INVALID"), ({**whole, "ProjectFile": "../x.srproj"}, "SVPA_PROJECT_PATH_UNSAFE"),
        ({**whole, "ProjectFile": "p/x.xml"}, "SVPA_PROJECT_SUFFIX_INVALID"), ({**whole, "ProjectFile": "p/y.srproj"}, "SVPA_PROJECT_MISSING"), ({**whole, "OriginalProjectDirectory": 1}, "SVPA_ORIGINAL_DIRECTORY_INVALID"), ({**whole, "OriginalProjectDirectory": "C:/../.."}, "SVPA_ORIGINAL_DIRECTORY_INVALID"),
        ({**whole, "Entries": {}}, "SVPA_ENTRIES_INVALID"), ({"ProjectFile": "P\\X.SRPROJ"}, "SVPA_ENTRIES_INVALID"), (whole, None),
    ]
    rows = [(f"{i}", n, bytearray(c.encode())) for i, (text, _) in enumerate(cases) for n, c in (("svpa_manifest.json", text if isinstance(text, str) else json.dumps(text)), ("p/x.srproj", ""))]
    entries = spark.createDataFrame(rows, "archive string, entry_name string, content binary")
    assert {int(r["archive"]): r["code"] for r in read_manifests(entries).collect()} == {i: code for i, (_, code) in enumerate(cases)}


def test_what_is_a_package(spark):
    rows = [("none", "a.txt", ""), ("two", "a.json", "{}"), ("two", "b.json", "{}"), ("named", "svpa_manifest.json", '{"project": {"projectName": "x"}}'), ("svpa", "SVPA_Manifest.JSON", '{"project": {}, "Entries": []}'), ("deep", "x/a.json", "{}")]
    entries = spark.createDataFrame([(a, n, bytearray(c.encode())) for a, n, c in rows], "archive string, entry_name string, content binary")
    found = {r["archive"]: (r["format"], r["code"]) for r in package_kinds(entries).collect()}
    bad = (None, "VISION_PROJECT_JSON_COUNT_INVALID")
    assert found == {"none": bad, "two": bad, "deep": bad, "named": ("v2-visionproj", None), "svpa": ("v1-svpa", None)}


def test_faulty_items(spark):
    cases = [("C:/w/a", "img/a", None), ("a", "IMG\\A", "SVPA_ORIGINAL_PATH_DUPLICATE"), ("c:\\W\\A", "img/b", "SVPA_ORIGINAL_PATH_CONFLICT"), ("", "img/a", "SVPA_MANIFEST_FIELD_INVALID"), ("C:x", "img/a", "SVPA_ORIGINAL_PATH_INVALID"), ("C:/d", "../a", "SVPA_RELATIVE_PATH_UNSAFE"), ("C:/e", "p/x.srproj", "SVPA_IMAGE_REFERENCE_INVALID"), ("C:/f", "img/none", "SVPA_IMAGE_MISSING")]
    items = spark.createDataFrame([("z", i, o, r, "C:/w", "p/x.srproj") for i, (o, r, _) in enumerate(cases)], "archive string, position int, original_path string, relative_path string, directory string, project_file string")
    listing = spark.createDataFrame([("z", n) for n in ("img/a", "img/b", "p/x.srproj")], "archive string, entry_name string")
    assert {r["position"]: r["code"] for r in item_findings(items, listing).collect()} == {i: c for i, (_, _, c) in enumerate(cases) if c}
    files = spark.createDataFrame([("z", 0, "a"), ("z", 1, "nowhere")], "archive string, file_index int, source_path string")
    found = {(r["file_index"], r["position"], r["code"]) for r in bind_images(files, items.filter("position in (0, 7)")).collect()}
    assert found == {(0, 0, None), (1, None, "SVPA_PROJECT_IMAGE_UNMAPPED"), (None, 7, "SVPA_MANIFEST_ENTRY_UNUSED")}
    assert item_findings(items.limit(0), listing).count() == 0


def test_plans(spark):
    rows = [(1, "images/a.png", 10), (1, "images/é", 5), (2, "images/a", 1), (2, "IMAGES/A", 1), (3, "../a", 1), (4, "images/a", (4 << 30) + 1), (5, "images/" + "x/" * 2100, 1)] + [(6, f"images/{i}", 1) for i in range(20_000)]
    plan = {r["k"]: r for r in package_plan(spark.createDataFrame(rows, "k int, entry_name string, size long"), "k", "svpa").collect()}
    assert (plan[1]["n_entries"], plan[1]["n_bytes"], plan[1]["n_name_bytes"], plan[1]["estimated_bytes"], plan[1]["zip64"], plan[1]["limit_code"]) == (6, 15, 21, 15 + 6 * 512 + 42 + 65536, False, None)
    assert [plan[k]["limit_code"] for k in range(2, 7)] == ["OUTPUT_ARCHIVE_ENTRY_DUPLICATE", "OUTPUT_ARCHIVE_ENTRY_PATH_UNSAFE", "OUTPUT_ARCHIVE_ENTRY_SIZE_LIMIT_EXCEEDED", "OUTPUT_ARCHIVE_ENTRY_NAME_LIMIT_EXCEEDED", "OUTPUT_ARCHIVE_ENTRY_LIMIT_EXCEEDED"] and plan[4]["zip64"]


def test_names_and_contents(spark):
    files = spark.createDataFrame([(1, 0, "con.png", "x"), (1, 1, None, "d/a?.png"), (1, 2, "A?.png", "y"), (1, 3, "", ""), (2, 0, "a?.png", "x")], "k int, file_index int, file_name string, source_path string")
    assert {(r["k"], r["file_index"]): r["entry_name"] for r in image_names(files, "k").collect()} == {(1, 0): "images/_con.png", (1, 1): "images/a_.png", (1, 2): "images/A__2.png", (1, 3): "images/image_4", (2, 0): "images/a_.png"}
    stems = spark.createDataFrame([(i, n) for i, n in enumerate(["a/b", "nul", "  ", None, "é" * 100, "x. "])], "i int, n string")
    assert [r[0] for r in stems.orderBy("i").select(output_stem(F.col("n"))).collect()] == ["a_b", "_nul", "project", "project", "é" * 90, "x"]
    images = spark.createDataFrame([("p", bytearray(b"1")), ("p", bytearray(b"1")), ("q", bytearray(b"1")), ("q", bytearray(b"2"))], "k string, content binary")
    assert [tuple(r) for r in equal_contents(images, ["k"]).collect()] == [("q", 2, 2)]
