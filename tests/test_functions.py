"""Paths, names, geometry, images, archives, writers and streams on small fixtures."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from weftlens.functions import codes, geometry, paths
from weftlens.functions.visual import visual_form
from weftlens.operators.images import probe, verify_images
from weftlens.operators.matching import merge_selections, resolve_images, suffix_match
from weftlens.operators.naming import reindex, running_ids, unique_names
from weftlens.sinks.projects import write_archives, write_v1
from weftlens.sources import v1_xml
from weftlens.sources.archives import entry_code, read_archives
from weftlens.sources.detect import read_project_files
from weftlens.streaming.ingest import first_arrivals


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_visual_form():
    assert visual_form("ＭＡＳＫ\u200b\u00a0сam‑5/ﬁn") == "MASK cam-5/fin"
    assert visual_form("e\u0301") == visual_form("é") != visual_form("e")
    assert visual_form("ﾎﾞﾙﾄ") == "ボルト" and visual_form("상") == visual_form("상") and visual_form(None) is None


def test_paths(spark):
    assert column(spark, [' "C:\\a\\\\b/" ', "file:///C:/x/y.png", "file://nas/x", "/", None, ""], paths.normalize_path) == ["C:/a/b", "C:/x/y.png", "nas/x", "/", None, ""]
    bad = ["", "a\x01", "/a", "C:/a", "a/../b", "a?/b", "a./b", "x/con.txt", "x/" + "é" * 200, "ok/fine.png", "a\\..\\b", None]
    assert column(spark, bad, paths.entry_problem) == ["empty", "control-character", "absolute", "drive-path", "traversal", "invalid-character", "invalid-character", "reserved-name", "segment-too-long", None, "traversal", "empty"]
    assert column(spark, ["aé漢", "abc", None], lambda c: paths.fit_utf8(c, 4)) == ["aé", "abc", None]
    assert column(spark, ["a/b/c/d", "a/b"], paths.redact) == ["…/b/c/d", "a/b"]
    assert column(spark, ["con.png", "a:b. ", ""], paths.safe_file_name) == ["_con.png", "a_b", "_"]


def test_codes(spark):
    assert column(spark, ["abc", "é", ""], codes.fnv1a)[0] == 440920331
    assert column(spark, ["2021-02-30 00:00:00", "2021-02-03T04:05:06", None], codes.v1_date_ms) == [None, 1612325106000, None]
    assert column(spark, [1612325106000], codes.v1_date_text, "long") == ["2021-02-03 04:05:06"]
    assert column(spark, [-16732080, 4294967295, 255, 1 << 40], codes.argb_text, "long") == ["#00b050", "#ffffff", "#000000ff", None]
    assert column(spark, ["1e3", " 1", "-.5", "9007199254740993", "x"], codes.strict_number) == [1000.0, None, -0.5, None, None]


def test_geometry(spark):
    square, back = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]], [[0.0, 3.0], [4.0, 3.0], [4.0, 0.0], [0.0, 0.0]]
    rings = [square, back, [[0.4, 0.4], [0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.2, 0.1]], [], None]
    kind = "array<array<double>>"
    assert column(spark, rings, geometry.signed_area2, kind)[:2] == [24.0, -24.0]
    assert column(spark, rings, lambda r: geometry.ring_role(geometry.signed_area2(r)), kind)[:2] == ["outer", "inner"]
    assert column(spark, rings, lambda r: F.size(geometry.quantise(r)), kind)[:4] == [4, 4, 3, 0]
    assert column(spark, rings, lambda r: geometry.is_full_contour(r, F.lit(4), F.lit(3)), kind) == [True, True, False, False, False]
    assert column(spark, rings, lambda r: geometry.exact_area2(r).cast("long"), kind)[:2] == [24, -24]
    assert column(spark, [2.5, -2.5, 0.49999999999999994, -0.5], geometry.round_half_up, "double") == [3, -2, 0, 0]


def test_suffix_match(spark):
    refs = spark.createDataFrame([(1, 1, "D:\\a\\x\\1.png"), (1, 2, "D:/b/x/1.png"), (1, 3, "q/2.png"), (1, 4, ""), (1, 5, None), (1, 6, "other/y/3.PNG"), (1, 7, "r/y/3.png")], "scope int, ref_id int, path string")
    cands = spark.createDataFrame([(1, 10, "sel/a/x/1.png"), (1, 11, "sel/b/x/1.png"), (1, 12, "y/3.png"), (2, 13, "q/2.png")], "scope int, cand_id int, path string")
    found = {r["ref_id"]: (r["status"], r["depth"], r["candidate_count"], r["cand_id"]) for r in suffix_match(refs, cands).collect()}
    assert found == {1: ("matched", 3, 1, 10), 2: ("matched", 3, 1, 11), 3: ("missing", 0, 0, None), 4: ("blank", 0, 0, None), 5: ("blank", 0, 0, None), 6: ("ambiguous", 2, 1, None), 7: ("ambiguous", 2, 1, None)}


def test_names(spark):
    rows = spark.createDataFrame([(1, 0, "a.png"), (1, 1, "A.png"), (1, 2, "a_2.png"), (2, 0, "b"), (2, 1, "b"), (2, 2, None)], "s int, i int, n string")
    found = {(r["s"], r["i"]): r["unique_name"] for r in unique_names(rows, "s", "n", ["i"]).collect()}
    assert found == {(1, 0): "a.png", (1, 1): "A_2.png", (1, 2): "a_2_2.png", (2, 0): "b", (2, 1): "b_2", (2, 2): None}
    again = reindex(spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (2, 5, "p"), (2, None, "q")], "s int, d int, n string"), "s", "d", ["n"])
    assert {(r["n"], r["new_index"]) for r in again.collect()} == {("x", 1), ("y", 0), ("p", 0), ("q", 1)}


def test_running_ids(spark):
    rows = spark.createDataFrame([("hot", i, i % 7) for i in range(500)] + [(f"s{i % 9}", 1000 + i, i) for i in range(60)] + [(None, 5000, 1), (None, 5001, 0)], "s string, id int, o int")
    found = running_ids(rows, "s", ["o", "id"], F.lit(100), "n").collect()
    groups = {}
    for r in found:
        groups.setdefault(r["s"], []).append((r["o"], r["id"], r["n"]))
    assert len(found) == 562 and all([n for *_, n in sorted(g)] == list(range(100, 100 + len(g))) for g in groups.values())


def test_resolve_images_and_selections(spark):
    files = spark.createDataFrame([(1, 0, "archive", "a"), (1, 1, "archive", "b"), (1, 2, "external", None), (1, 3, "external", None), (1, 4, "external", None)], "scope int, file_index int, kind string, entry_name string")
    matches = spark.createDataFrame([(1, 2, "matched", 7), (1, 3, "ambiguous", None), (1, 4, "missing", None)], "scope int, ref_id int, status string, cand_id int")
    found = {r["file_index"]: r["issue"] for r in resolve_images(files, spark.createDataFrame([(1, "a"), (1, "a")], "scope int, entry_name string"), matches).collect()}
    assert found == {0: None, 1: "ARCHIVE_ENTRY_MISSING", 2: None, 3: "EXTERNAL_IMAGE_AMBIGUOUS", 4: "EXTERNAL_IMAGE_NOT_SELECTED"}
    one, two = spark.createDataFrame([(1, "x/a.png"), (2, "x/Thumbs.db")], "id int, path string"), spark.createDataFrame([(1, "y/a.png"), (3, "y/b.png")], "id int, path string")
    assert {tuple(r) for r in merge_selections([one, two]).collect()} == {(1, "x/a.png"), (3, "y/b.png")}


def test_external_paths(spark):
    rows = [("..\\img\\a.png", "C:\\p\\q", "C:/p/img/a.png"), ("file:///D:/a%20b/c.png", "", "D:/a b/c.png"), ("\\\\nas\\share\\x", "", "//nas/share/x"), ("/a/./b/../c", "", "/a/c"), ("x/y", "/base", "/base/x/y"), ("../../../x", "/a", None), ("C:x", "/a", None), ("//nas", "", None), ("", "/a", None), (None, "/a", None), ("a/b", None, "a/b"), ('"/q/r"', "", "/q/r"), ("file://nas/s/x.png", "", "//nas/s/x.png")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, b string, e string")
    assert [tuple(r) for r in df.orderBy("i").select(paths.external_path(F.col("p"), F.col("b")), "e").collect()] == [(r[2], r[2]) for r in rows]


PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 40, 30)
HEADERS = [
    (PNG, ("png", 40, 30, None)), (b"GIF89a" + struct.pack("<HH", 5, 6), ("gif", 5, 6, None)), (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 7, -8), ("bmp", 7, 8, None)), (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 7, 8), ("bmp", 7, 8, None)),
    (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 9, 11), ("jpeg", 11, 9, None)), (b"RIFF....WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x13\0\0", ("webp", 10, 20, None)), (b"RIFF....WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 16, 12), ("webp", 16, 12, None)),
    (b"RIFF....WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 99 | 49 << 14), ("webp", 100, 50, None)), (b"", ("unknown", None, None, "IMAGE_SOURCE_MISSING")), (b"hello", ("unknown", None, None, "IMAGE_FORMAT_UNSUPPORTED")), (PNG[:18], ("png", None, None, "IMAGE_HEADER_INVALID")),
    (PNG[:16] + struct.pack(">II", 0, 3), ("png", None, None, "IMAGE_DIMENSIONS_INVALID")), (PNG[:16] + struct.pack(">II", 200_000, 3), ("png", 200_000, 3, "IMAGE_DIMENSIONS_TOO_LARGE")),
]


@pytest.mark.parametrize("content,expected", HEADERS)
def test_header(content, expected):
    assert probe(content) == expected


def test_verify_images(spark):
    df = spark.createDataFrame([("a.png", bytearray(PNG), None, 30), ("b.jpg", bytearray(PNG), 41, 30), ("c.png", None, 1, 2)], "path string, content binary, width long, height long")
    found = {r["path"]: r for r in verify_images(df).collect()}
    assert found["a.png"]["width"] == 40 and found["a.png"]["issues"] == [] and found["a.png"]["repaired_path"] is None
    assert found["b.jpg"]["issues"] == ["IMAGE_DIMENSIONS_MISMATCH", "IMAGE_FORMAT_MISMATCH"] and found["b.jpg"]["repaired_path"] == "b.png"
    assert found["c.png"]["issues"] == ["IMAGE_SOURCE_MISSING"]


def test_archives_and_detection(spark, tmp_path):
    entries = spark.createDataFrame([("p.zip", "b.txt", bytearray(b"two"), 1), ("p.zip", "a.txt", bytearray(b"one"), 0), ("q/r.zip", "x/../y", None, 0)], "archive string, entry_name string, content binary, ordinal int")
    written = {r["archive"]: (r["n_entries"], r["n_bytes"]) for r in write_archives(entries, str(tmp_path)).collect()}
    assert written == {"p.zip": (2, 6), "q/r.zip": (1, 0)}
    assert zipfile.ZipFile(tmp_path / "p.zip").namelist() == ["a.txt", "b.txt"]
    back = read_archives(spark, str(tmp_path), 2)
    rows = {r["entry_name"]: r for r in back.withColumn("code", entry_code(back)).collect()}
    assert bytes(rows["a.txt"]["prefix"]) == b"on" and rows["x/../y"]["code"] == "ZIP_UNSAFE_TRAVERSAL" and rows["b.txt"]["code"] is None
    (tmp_path / "m.srproj").write_bytes(b"\xef\xbb\xbf <Project/>")
    (tmp_path / "n.srproj").write_bytes(b'{"project":{}}')
    (tmp_path / "o.srproj").write_bytes(b"<\xff>")
    (tmp_path / "e.json").write_bytes(b"")
    kinds = {r["path"].rsplit("/", 1)[-1]: (r["format"], r["code"], r["text"]) for r in read_project_files(spark, str(tmp_path)).collect()}
    assert kinds["m.srproj"] == ("v1-xml", None, " <Project/>") and kinds["n.srproj"][:2] == ("v2-json", "INPUT_EXTENSION_MISMATCH")
    assert kinds["o.srproj"] == ("v1-xml", "PROJECT_TEXT_UTF8_INVALID", None) and "e.json" not in kinds and kinds["p.zip"][:2] == ("zip", None)


def test_v1_round_trip(spark):
    projects = spark.createDataFrame([(1, "segmentation", 1612325106000, "simple", 0.1, 0.2, 0.8, 0.85)], "project_key long, project_type string, modified_ms long, roi_mode string, roi_left double, roi_top double, roi_right double, roi_bottom double")
    classes = spark.createDataFrame([(1, 1, "b & <c>", None), (1, 0, "a", "#102030")], "project_key long, class_index int, class_name string, class_color string")
    files = spark.createDataFrame([(1, 0, "D:\\x\\1.png", 20, 10, "training", None, False, 0), (1, 1, "D:\\x\\2.png", None, None, "unassigned", None, True, 0)], "project_key long, file_index int, source_path string, width long, height long, split string, class_index long, is_normal boolean, n_labels int")
    outer, inner = [[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0]]
    labels = spark.createDataFrame([(1, 0, 0, 1, ["outer", "inner"], [outer, inner])], "project_key long, file_index int, label_index int, class_index int, roles array<string>, rings array<array<array<double>>>")
    parsed = v1_xml.parse_v1(write_v1(projects, classes, files, labels).withColumnRenamed("xml", "text")).cache()
    assert v1_xml.diagnostics(parsed).count() == 0
    p = v1_xml.projects(parsed).first()
    assert (p["project_type"], p["modified_ms"], p["roi_mode"], round(p["roi_right"], 6)) == ("segmentation", 1612325106000, "simple", 0.8)
    assert [(r["class_name"], r["class_color"]) for r in v1_xml.classes(parsed).orderBy("class_index").collect()] == [("a", "#102030"), ("b & <c>", "#f00000")]
    assert [(r["split"], r["width"], r["is_normal"], r["n_labels"]) for r in v1_xml.files(parsed).orderBy("file_index").collect()] == [("training", 20, False, 1), ("unassigned", None, True, 0)]
    back = v1_xml.labels(parsed).first()
    assert back["roles"] == ["outer", "inner"] and sorted(back["rings"][0]) == sorted(outer) and back["class_index"] == 1


def test_v1_findings(spark):
    texts = [(1, "<!DOCTYPE x><Project/>"), (2, "<Project><Version>0.9</Version>"), (3, "<Project><Version>0.8</Version><Version>0.9</Version><Type>Detection</Type><ClassGroup><NumberOfClasses>2</NumberOfClasses><Class><Name>a</Name></Class></ClassGroup></Project>"), (4, None)]
    found = {}
    for r in v1_xml.diagnostics(v1_xml.parse_v1(spark.createDataFrame(texts, "project_key long, text string"))).collect():
        found.setdefault(r["project_key"], set()).add(r["code"])
    assert found[1] == {"V1_XML_DECLARATION_FORBIDDEN"} and found[2] == {"V1_INVALID_XML"}
    assert found[3] == {"V1_VERSION_UNVERIFIED", "V1_DUPLICATE_ELEMENT", "V1_PROJECT_TYPE_UNSUPPORTED", "V1_CLASS_COUNT_MISMATCH"}


def test_stream(spark, tmp_path):
    spark.sql("select 1L id, timestamp'2024-01-01' received_at union all select 1L, timestamp'2024-01-02' union all select 2L, timestamp'2024-01-02'").write.parquet(str(tmp_path / "in"))
    from weftlens.streaming.ingest import stream_table

    job = first_arrivals(stream_table(spark, str(tmp_path / "in")), ["id"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert spark.table("once").count() == 2


def test_values_of_the_formats(spark):
    """Literal values of the format's own rules."""
    kinds = [[], ["train"], ["train", "banana"], ["banana"], ["train", "TRAINING"], ["train", "val"], ["not-split"], ["none"], [None], None]
    found = column(spark, kinds, lambda c: codes.canonical_split(F.transform(c, lambda t: codes.split_type_v2(t))), "array<string>")
    assert [tuple(r) for r in found] == [("unassigned", "missing"), ("training", "ok"), ("training", "repeated"), ("unknown", "ok"), ("training", "repeated"), ("unknown", "conflict"), ("unassigned", "ok"), ("unknown", "ok"), ("unknown", "ok"), ("unassigned", "missing")]
    assert column(spark, ["none", "Not Split", "Not_split"], codes.split_type) == ["unassigned"] * 3
    colors = ["-65536", "4294901760", "#FF0000", "#80ff0000", " ", None, "red", "4294967296", "-2147483649", "#12345"]
    assert column(spark, colors, lambda c: codes.argb_number(c, F.lit(1))) == [-65536, -65536, -65536, -2130771968, -1048576, -1048576, None, None, None, None]
    assert column(spark, ["a/con .txt", "aux x/b", "a/console.txt", "x/NUL", "lpt1.", "com0"], paths.entry_problem) == ["reserved-name", "reserved-name", None, "reserved-name", "invalid-character", None]


def test_cdata_is_text_and_declarations_are_not(spark):
    texts = [(1, '<Project><Version>0.9</Version><Type><![CDATA[Segmentation]]></Type></Project>'), (2, '<!DOCTYPE x><Project/>'), (3, '<Project><!-- note --><Type>Classification</Type></Project>')]
    parsed = v1_xml.parse_v1(spark.createDataFrame(texts, "project_key long, text string"))
    assert {r["project_key"]: r["project_type"] for r in v1_xml.projects(parsed).collect()} == {1: "segmentation", 3: "classification"}
    assert (2, "V1_XML_DECLARATION_FORBIDDEN") in {tuple(r)[:2] for r in v1_xml.diagnostics(parsed).collect()}


def test_nothing_is_written_by_guessing(spark):
    projects = spark.createDataFrame([(k, "classification", 0, "none", None, None, None, None) for k in (1, 2, 3)], "project_key long, project_type string, modified_ms long, roi_mode string, roi_left double, roi_top double, roi_right double, roi_bottom double")
    classes = spark.createDataFrame([(1, 0, "a", "#102030"), (2, 0, "a", "#102030"), (3, 0, "a", "red")], "project_key long, class_index int, class_name string, class_color string")
    files = spark.createDataFrame([(k, 0, "p", 2, 2, "unknown" if k == 2 else "training", False, 0) for k in (1, 2, 3)], "project_key long, file_index int, source_path string, width long, height long, split string, is_normal boolean, class_index long")
    labels = spark.createDataFrame([], "project_key long, file_index int, label_index int, class_index int, rings array<array<array<double>>>, roles array<string>")
    rows = {r["project_key"]: r for r in write_v1(projects, classes, files, labels).collect()}
    assert rows[1]["code"] is None and "<SplitState>Training</SplitState>" in rows[1]["xml"]
    assert (rows[2]["xml"], rows[2]["code"]) == (None, "SRPROJ_SPLIT_UNSUPPORTED") and (rows[3]["xml"], rows[3]["code"]) == (None, "SRPROJ_CLASS_COLOR_INVALID")


def test_archive_names_stay_in_their_folder(spark, tmp_path):
    entries = spark.createDataFrame([("../out.zip", "a", bytearray(b"x"), 0)], "archive string, entry_name string, content binary, ordinal int")
    with pytest.raises(ValueError):
        write_archives(entries, str(tmp_path))
