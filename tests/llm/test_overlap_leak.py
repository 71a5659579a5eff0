"""Split overlaps and leaks against brute force."""

import contextlib
import os
import random
import re
import threading

import numpy as np
import pytest

from weftlens.llm import leak, overlap
from weftlens.llm.grams import by_record
from weftlens.llm.leak import find_leaks, leak_report
from weftlens.llm.overlap import cross_split_overlaps, overlap_report, split_records
from weftlens.llm.queries import ORACLES, QUERIES
from weftlens.session import ensure_checkpoint_dir

WORDS = re.compile(r"[^\W_]+")


def runs(text, n):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def variants(rng, vocabulary, n):
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.randint(4, 40))] for _ in range(n // 6)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + w + [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        rows.append((i, rng.choice([" ", "  ", ", "]).join(w), rng.random() < 0.6, rng.random() < 0.4))
    return rows


@pytest.mark.parametrize("seed,rare,paired,bits", [(1, 32, 64, 20), (2, 0, 64, 20), (3, 0, 8, 20), (4, 4, 20, 6)])
def test_overlaps_equal_brute_force(spark, monkeypatch, seed, rare, paired, bits):
    for name, value in (("RARE", rare), ("MOST_PAIRED", paired), ("BITS", bits)):
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(seed)
    rows = variants(rng, [f"w{i}" for i in range(60)], 180) + [(900, None, True, True), (901, " ", True, True), (902, "one two", True, False), (903, "one two", False, True), (904, "同 じ 文 章 です", True, False), (905, "同 じ 文 章 です", False, True), (906, "x " * 5000, True, False)]
    sets = {i: runs(t, 3) for i, t, _, _ in rows}
    role = {i: (a, b) for i, _, a, b in rows}
    expected = {}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and (role[i][0] and role[j][1] or role[i][1] and role[j][0]):
                share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if share >= 0.6 - 1e-9:
                    expected[i, j] = share
    df = spark.createDataFrame([(*r, "extra") for r in rows], "id long, text string, is_train boolean, is_eval boolean, gram string")
    found = {(r["id_a"], r["id_b"]): r["jaccard"] for r in cross_split_overlaps(df).collect()}
    assert found.keys() == expected.keys() and (904, 905) in found
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert cross_split_overlaps(df.limit(0)).count() == 0
    contained = {(i, j) for i in sets for j in sets if i != j and role[i][1] and role[j][0] and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i]) - 1e-9}
    assert {(r["id_a"], r["id_b"]) for r in cross_split_overlaps(df, containment=0.8).collect()} == expected.keys() | {(min(p), max(p)) for p in contained} and not {(min(p), max(p)) for p in contained} <= expected.keys()


def test_disk_of_many_records_stays_below_their_texts(spark, monkeypatch):
    """Sets of hashes are larger than their texts, and common words make many candidates: neither may pile up on disk."""
    monkeypatch.setattr(overlap, "LEAST_IN_PARTS", 1, raising=False)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["pixels", "kept", "outer line", "beside the clip", "frame", f"n{rng.randrange(50)}"]) for _ in range(40)), i % 4 > 0, i % 4 == 0) for i in range(6000)]
    rows += [(10_000 + i, text + " " + "once more", not train, train) for i, text, train, _ in rows[:200]]
    records = spark.createDataFrame(rows, "id long, text string, is_train boolean, is_eval boolean").repartition(4)
    context = spark.sparkContext._jsc.sc()
    folders = [str(f) for f in context.env().blockManager().diskBlockManager().localDirs()] + [ensure_checkpoint_dir(spark).removeprefix("file:")]

    def used():
        sizes = [0]
        for p in (os.path.join(at, name) for folder in folders for at, _, names in os.walk(folder) for name in names):
            with contextlib.suppress(FileNotFoundError):
                sizes.append(os.path.getsize(p))
        return sum(sizes)

    floor, most, over = used(), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.02):
            most = max(most, used() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        pairs = cross_split_overlaps(records).collect()
    finally:
        over.set()
        watcher.join()
    assert {(i, 10_000 + i) for i in range(200)} <= {(r["id_a"], r["id_b"]) for r in pairs}
    assert 0 < most < 4 * sum(len(t) for _, t, _, _ in rows)


@pytest.mark.parametrize("parts", [0.5, 8])
def test_a_class_may_run_over_batches_and_keys_may_come_in_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(overlap, "BLOCK", 3)
    monkeypatch.setattr(overlap, "PART_KEYS", parts)
    monkeypatch.setattr(overlap, "LEAST_IN_PARTS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        text = lambda i: " ".join(f"t{i}x{k}" for k in range(8))
        rows = [(i, text(i // 11), i % 3 == 0, i % 3 == 1) for i in range(99)]
        found = {(r["id_a"], r["id_b"], r["jaccard"]) for r in cross_split_overlaps(spark.createDataFrame(rows, "id long, text string, is_train boolean, is_eval boolean"), containment=0.8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(min(a, b), max(a, b), 1.0) for a, s, train, _ in rows if train for b, t, _, evaluation in rows if evaluation and s == t}


def test_order_by_record_is_exact_where_only_the_last_bits_differ():
    rng = np.random.default_rng(4)
    record, step = np.sort(rng.integers(0, 5, 4000)), rng.integers(0, 3, 4000).astype(np.uint8)
    for values in (rng.integers(-(2**63), 2**63, 4000), rng.integers(-40, 40, 4000)):
        for order, keys in ((by_record(record, values), (values.view(np.uint64), record)), (by_record(record, values, step), (values.view(np.uint64), step, record))):
            assert all((k[order] == k[np.lexsort(keys)]).all() for k in keys)


def test_roles_and_report(spark):
    files = spark.createDataFrame(
        [(1, 1, "a", "one two three four", [(1, "x", " Train")], "2024-01-01"), (2, 1, "a", "one two three four", [(1, "x", "VAL"), (2, "y", None)], "2024-01-01"), (2, 1, "a", "one two three four", [(1, "x", "VAL")], "2024-02-01"), (3, 1, "a", "one two three four", None, "2024-01-01"), (4, 1, "a", None, [], "2024-01-01")],
        "file_uid long, project_key long, dataset_name string, remark string, split_sets array<struct<split_id:long,split_name:string,split_type:string>>, received_at string",
    ).selectExpr("* except (received_at)", "cast(received_at as timestamp) received_at")
    records = split_records(files)
    assert {r["id"]: (r["is_train"], r["is_eval"]) for r in records.collect()} == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}
    pairs = cross_split_overlaps(records)
    assert [(r["id_a"], r["id_b"]) for r in pairs.collect()] == [(1, 2)]
    assert [tuple(r) for r in overlap_report(records).collect()] == [("validation", 1, "a", 1, 1, 1.0)]


def test_a_record_inside_a_longer_one_is_reported(spark):
    inner = " ".join(f"w{i}" for i in range(12))
    rows = [(1, inner, False, True, ["test"], 7, "d"), (2, " ".join(f"a{i}" for i in range(40)) + f" {inner} " + " ".join(f"b{i}" for i in range(40)), True, False, [], 7, "d"), (3, inner, True, True, ["test", "validation"], 8, "d"), (4, inner, True, False, [], 8, "d")]
    records = spark.createDataFrame(rows, "id long, text string, is_train boolean, is_eval boolean, splits array<string>, project_key long, dataset_name string")
    assert {tuple(r) for r in overlap_report(records).collect()} == {("test", 7, "d", 1, 3, 1.0), ("test", 8, "d", 1, 2, 1.0), ("validation", 8, "d", 1, 2, 1.0)}
    assert {tuple(r)[3:5] for r in overlap_report(records, containment=None).collect()} == {(1, 2), (1, 1)}
    assert overlap_report(records.limit(0)).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_full_matrix():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 5, rng.integers(0, 25)), rng.integers(0, 5, rng.integers(0, 25))) for _ in range(60)]
    for (a, b), (score, _, _, run) in zip(pairs, leak.align_many(*zip(*pairs))):
        longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 26) if i + k <= len(a) and j + k <= len(b) and (a[i : i + k] == b[j : j + k]).all()), default=0)
        assert score == smith_waterman(a, b) and run == longest
    assert leak.align_many([], []) == []


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    item = lambda: [rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(300)}" for _ in range(rng.randint(8, 40))]
    items = [(i, " ".join(item())) for i in range(25)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(120):
        w = item()
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items[:25])[1].split()
            a = rng.randrange(len(source))
            w += source[a : a + rng.randint(9, 16)]
        docs.append((d, rng.choice([" ", "\n", " / "]).join(w).upper()))
    docs += [(900, None), (901, " "), (902, "z " * 3000 + items[0][1])]
    grams = {i: runs(t, 12) for i, t in items}
    expected = {(i, d) for d, t in docs for i in grams if grams[i] & runs(t, 12)}
    docs_df, items_df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, gram int"), spark.createDataFrame(items + items[:2], "item_id long, item_text string")
    found = find_leaks(items_df, docs_df)
    assert {(r["item_id"], r["doc_id"]) for r in found.filter("longest_run >= 12").collect()} == expected and expected
    assert find_leaks(items_df, docs_df.limit(0)).count() == 0 and find_leaks(items_df.limit(0), docs_df).count() == 0


def test_edited_copy_is_scored(spark):
    text = " ".join(f"u{i}" for i in range(40))
    edited = " ".join(f"u{i}" if i % 6 else "other" for i in range(40))
    df = find_leaks(spark.createDataFrame([(1, text)], "item_id long, item_text string"), spark.createDataFrame([(7, edited), (8, "nothing of it at all here")], "doc_id long, text string"))
    (row,) = df.collect()
    assert row["doc_id"] == 7 and row["longest_run"] == 5 and row["item_share"] > 0.7


@pytest.mark.parametrize("copies,block", [(1, 2_000_000), (8, 2_000_000), (200, 2_000_000), (8, 300)])
def test_edited_copies_are_found_however_many_there_are(spark, monkeypatch, copies, block):
    monkeypatch.setattr(leak, "MOST_BLOCK_WORDS", block)
    rng = random.Random(copies)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(rng.randint(25, 50))) for i in range(20)]
    docs, expected = [], set()
    for k in range(copies):
        for i, w in items:
            edited = list(w)
            kind = (i + k) % 4
            if kind == 0:  # every sixth word changed, the same ones everywhere
                edited = [x if j % 6 else "changed" for j, x in enumerate(w)]
            elif kind == 1:  # words changed here and there
                for j in rng.sample(range(len(w)), len(w) // 8):
                    edited[j] = rng.choice(vocabulary)
            elif kind == 2:  # words put in and left out
                for j in sorted(rng.sample(range(len(w)), 4), reverse=True):
                    edited[j : j + 1] = [] if j % 2 else [w[j], "more"]
            else:  # half of the item
                edited = w[: len(w) // 2 + 1]
            docs.append((len(docs), " ".join(draw(60) + edited + draw(60))))
            expected.add((i, docs[-1][0]))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, item_text string")
    found = find_leaks(frame, spark.createDataFrame(docs, "doc_id long, text string"))
    pairs = {(r["item_id"], r["doc_id"]) for r in found.collect()}
    assert len(pairs & expected) >= 0.97 * len(expected) and len(pairs - expected) <= 0.02 * len(expected)
    report = {r["item_id"]: r for r in leak_report(found, frame).collect()}
    assert len(report) == 20 and sum(r["n_documents"] for r in report.values()) == len(pairs) and all(r["n_unbroken"] <= r["n_documents"] for r in report.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    twin = duck.sql(ORACLES[name])
    place = [twin.columns.index(c) for c in sorted(df.columns)]
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r[i] for i in place) for r in twin.fetchall())
