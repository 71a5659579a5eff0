"""Look-alikes, mixing and residue on small fixtures."""

import random
import unicodedata

import pytest

import residue_cases
from weftlens.functions.visual import LOOK_ALIKES, visual_form
from weftlens.llm import mixing
from weftlens.llm import residue_seeds as seeds
from weftlens.llm.lookalike import SpellingTrie, alike_pairs, canonical_texts, vocabulary
from weftlens.llm.mixing import default_tokenizer, mix_report, mix_selection, route, with_token_counts
from weftlens.llm.residue import ResidueModels, find_residue, fit_models, residue_documents


def test_trie_agrees_with_the_table_at_no_cost():
    trie = SpellingTrie({"camera": 5, "verre dépoli": 2, "ボルト": 1, "상판": 1})
    for token in ["саmеrа", "ｃａｍｅｒａ", "cam​era", "verre dépoli", "ﾎﾞﾙﾄ", "상판"]:
        assert trie.best(token) == visual_form(token)
    assert trie.best("camara") is None and trie.best("camara", 1) == "camera" and trie.best("camra", 1) == "camera" and trie.best("caméra") is None


def test_the_automaton_reads_what_the_table_cannot_tell():
    """Fails where the walk is replaced by the table: it has one reading of each letter and no edits."""
    words = {"lamp": 9, "Image": 4, "IMAGE": 1, "tall": 2, "kernel": 3, "window": 2}
    trie = SpellingTrie(words, several=True)
    for token, spelling in {"Іamp": "lamp", "Іmage": "Image", "Ιmаge": "Image", "taӏl": "tall", "keгneӏ": "kernel", "windoш": "window", "l\u200bаm\u200bp": "lamp"}.items():
        assert trie.best(token) == spelling
    assert visual_form("Іamp") == "Iamp" and SpellingTrie(words).best("Іamp") is None and SpellingTrie(words | {"Iamp": 1}, several=True).best("Іamp") == "Iamp"
    assert trie.best("Іamb", 1) == "lamp" and trie.best("l\u200bamps", 1) == "lamp" and trie.best("kегneӏ") == "kernel"


def test_random_disguises_come_back(spark):
    rng = random.Random(8)
    back: dict[str, list[str]] = {}
    for ch, latin in LOOK_ALIKES.items():
        back.setdefault(latin, []).append(ch)
    words = {"".join(rng.choice("abcdehijklmnopqstuvxyzABCEHIKMOPST") for _ in range(rng.randint(3, 9))): 1 for _ in range(200)} | {"verre dépoli".split()[1]: 1, "gerät": 1, "フォルダ": 1, "상판": 1, "file": 1}
    rows = []
    for word in words:
        out = "".join(rng.choice(back[c]) if c in back and rng.random() < 0.4 else c for c in word)
        out = unicodedata.normalize(rng.choice(["NFC", "NFD"]), out)
        at = rng.randrange(len(out) + 1)
        rows.append((word, out[:at] + rng.choice(["", "\u200b", "\u00ad", "\ufeff", "\u2060"]) + out[at:]))
    df = spark.createDataFrame(rows, "word string, text string")
    trie = SpellingTrie(words)
    assert all(trie.best(text) == word for word, text in rows)
    assert all(r["canonical"] == r["word"] for r in canonical_texts(df, "text", words).collect())


def test_a_hot_group_of_one_spelling_is_no_square(spark):
    df = spark.range(20_000).selectExpr("1 as scope", "'f' as field_name", "id", "if(id = 7, 'МASK', 'MASK') as text")
    found = alike_pairs(df, {})
    assert found.count() == 19_999 and found.filter("id_a <> 7 and id_b <> 7").count() == 0


def test_pairs(spark):
    rows = [(1, "f", 1, "MASK_1"), (1, "f", 2, "МASK_1"), (1, "f", 3, "mask_1"), (2, "f", 4, "MASK_1"), (1, "g", 5, "МASK_1"), (1, "f", 6, None), (1, "f", 7, "MASK_1"), (1, "f", 8, ""), (None, "f", 9, "МASK_1"), (1, "f", 10, "é"), (1, "f", 11, "é"), (1, "f", 12, "e"), (1, "f", 13, "a­b" * 3000), (1, "f", 14, "ab" * 3000)]
    df = spark.createDataFrame(rows, "scope int, field_name string, id long, text string")
    for words in (vocabulary(df, "text"), {}, vocabulary(df, "text", most=1)):
        assert {tuple(r)[2:] for r in alike_pairs(df, words).collect()} == {(1, 2), (2, 7), (10, 11), (13, 14)}
    assert alike_pairs(df.limit(0), {}).count() == 0
    clash = canonical_texts(spark.createDataFrame([("Ａ", None), (None, "x")], "text string, canonical string"), "text", {})
    assert [(r["canonical"], r["canonical_in"]) for r in clash.collect()] == [("A", None), (None, "x")]


def test_route_prefers_unused_texts_and_keeps_caps():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 2}
    flows = route(capacity, {"a": 10, "b": 12}, {"a": 2, "b": 3})
    assert sum(v for (p, s), v in flows.items() if s == "a") == 10 and sum(v for (p, s), v in flows.items() if s == "b") == 12
    assert flows[("a", "b"), "b"] == 10 and flows[("b",), "b"] == 2 and ("a", "b") not in {p for p, s in flows if s == "a"}
    assert sum(route({("a",): 5}, {"a": 100}, {"a": 3}).values()) == 15
    assert route({}, {"a": 5}, {"a": 1}) == {}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    docs = [(i, f"text {i}", "big", rng.randint(5, 40)) for i in range(400)] + [(1000 + i, f"small {i}", "small", rng.randint(5, 40)) for i in range(30)] + [(2000 + i, f"text {i}", "copy", 20) for i in range(50)] + [(3000, None, "big", 0), (3001, "x", "unlisted", 9), (3002, "y", None, 9)]
    targets = spark.createDataFrame([("big", 60.0, 1), ("small", 30.0, 3), ("copy", 10.0, 2), ("none", 5.0, 2)], "source string, target_weight double, max_repeats int")
    return spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens long"), targets


@pytest.mark.parametrize("total", [500, 3000, 8000, 1_000_000])
def test_mix(mixed, total):
    docs, targets = mixed
    chosen = mix_selection(docs, targets, total, seed=4).collect()
    again = mix_selection(docs, targets, total, seed=4).collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again))
    caps, sums = {"big": 1, "small": 3, "copy": 2}, {}
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    for r in chosen:
        assert 1 <= r["repeats"] <= caps[r["source"]]
        sums[r["source"]] = sums.get(r["source"], 0) + r["repeats"] * r["n_tokens"]
    have = {r["source"]: r["t"] for r in docs.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    for source, weight in (("small", 30),):
        quota = total * weight / 105
        assert min(quota, have[source] * caps[source]) <= sums.get(source, 0) <= min(quota + 3 * 40, have[source] * caps[source])
    report = {r["source"]: r for r in mix_report(mix_selection(docs, targets, total, seed=4), targets).collect()}
    assert set(report) == {"big", "small", "copy", "none"} and report["none"]["tokens"] == 0 and abs(report["big"]["target_share"] - 60 / 105) < 1e-9
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


def test_a_mix_as_large_as_its_sources(mixed):
    docs, targets = mixed
    held = docs.filter("source in ('big', 'small', 'copy')").agg({"n_tokens": "sum"}).first()[0]
    report = {r["source"]: r for r in mix_report(mix_selection(docs, targets, None, seed=4), targets).collect()}
    assert abs(report["big"]["tokens"] - held * 60 / 105) <= 40 and report["small"]["most_repeats"] == 3


def test_more_sources_than_patterns_are_routed_for(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 4)
    rng = random.Random(9)
    docs = [(i, f"text {rng.randrange(60)}", f"s{rng.randrange(12)}", 10) for i in range(600)]
    targets = spark.createDataFrame([(f"s{i}", 1.0 + i % 3, 1 + i % 2) for i in range(12)], "source string, target_weight double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens long")
    chosen = mix_selection(df, targets, 4000).collect()
    sums = {}
    for r in chosen:
        assert docs[r["doc_id"]][2] == r["source"] and 1 <= r["repeats"] <= 1 + int(r["source"][1:]) % 2
        sums[r["source"]] = sums.get(r["source"], 0) + r["repeats"] * 10
    have = {s: sum(10 for d in docs if d[2] == s) for s in sums}
    for i in range(12):
        quota, most = 4000 * (1 + i % 3) / 24, have[f"s{i}"] * (1 + i % 2)
        assert min(quota, most) - 10 <= sums[f"s{i}"] <= min(quota + 10, most)


def test_mix_of_nothing(mixed):
    docs, targets = mixed
    assert mix_selection(docs.limit(0), targets, 100).count() == 0 and mix_selection(docs, targets.limit(0), 100).count() == 0


def test_copies_are_documents_of_their_own(spark):
    rows = [(i, "same", "a", 10) for i in range(1, 5)] + [(5, "same", "b", 10), (6, "other", "a", 10), (6, "other", "a", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 5.0, 1), ("b", 1.0, 1)], "source string, target_weight double, max_repeats int")
    picked = lambda total: {(r["doc_id"], r["source"], r["repeats"]) for r in mix_selection(docs, targets, total).collect()}
    assert picked(60) == picked(600) == {(i, "a", 1) for i in (1, 2, 3, 4, 6)} | {(5, "b", 1)}
    assert {d for d, s, _ in picked(24) if s == "a"} == {1, 6}  # before copies, the texts not used yet
    assert route({("a", "b"): 10}, {"a": 100, "b": 100}, {"a": 1, "b": 1}, {(("a", "b"), "a"): 40, (("a", "b"), "b"): 10}) == {(("a", "b"), "a"): 40, (("a", "b"), "b"): 10}


def test_token_counts(spark):
    path, pattern = default_tokenizer(spark)
    df = spark.createDataFrame([(1, "Hello world", 7), (2, None, 7), (3, " ", 7)], "doc_id long, text string, n_tokens long")
    found = {r["doc_id"]: (r["n_tokens"], r["n_tokens_in"]) for r in with_token_counts(df, path, pattern).collect()}
    assert found == {1: (2, 7), 2: (0, 7), 3: (0, 7)}


PROSE = ["The colour of Riss changed from a dull red to a deep blue in revision 9.", "We exported 90 files of lot KK9 and left 12 of them without a split.", "Draw the outer ring first and the hole second, otherwise the writer turns the area round.", "Die Klasse Burr wurde umbenannt, weil 99 Labels doppelt vergeben waren.", "[02:37] INFO DB3340 ring=20 pts=744", "若孔口周围的裂纹长度超过97像素，则标为Void。", "라벨 255개 가운데 223개는 점이 세 개보다 적어 제외했다."]
RESIDUE = [
    "Hello {{ first_name }}, your review of KK9 starts tomorrow.", "The lot ${station} holds 9 images in total.", "Class <%= x %> was renamed to @@DATE@@ by the team.", "Station: [insert lot number here], shift two.", "Lot: XX/XX/20XX", "Übergabe am (Beschreibung eintragen) durch die Schicht.", "摘要：<审核人姓名>",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", "asdf asdf asdf asdf asdf asdf asdf", "This is a dummy paragraph that only shows how the page will look.", "404 Not Found\n\nThe page you requested could not be found.", "Please enable JavaScript in your browser to view this page.", "服务器内部错误，请稍后再试。", "접근이 거부되었습니다.\n권한을 확인하세요. (9c9f9)",
]
CLEAN = [
    'In the header template write "{{ line }}" where the lot number belongs; the writer puts the value in by itself.', "The old mailer used marks such as `__customerRef__`, and every mail we checked had them filled.", 'The JSON of a ring is {"x": 236, "y": 3012} per point, with braces around each of them.',
    "Page not found was the usual reply of the old wiki, which is why we copied all 84 pages of the guide here.", "Filler text in the sample report was replaced last week by the remarks of lot KD9.", "The viewer runs without scripts, so JavaScript may stay switched off on the inspection PCs.", "Station: KD9, shift two.", "why\nthe\nfold\noutranks\nthe\ngouge",
]


@pytest.fixture(scope="module")
def models():
    rng = random.Random(2)
    return ResidueModels(["\n".join(rng.choices(PROSE, k=6)) for _ in range(200)] + CLEAN + RESIDUE[:7])


@pytest.fixture(scope="module")
def fitted(spark, data):
    """Models of the driver's smallest documents."""
    return fit_models(spark.read.parquet(f"{data}/documents.parquet"))


def test_unseen_residue_and_neutral_prose(fitted):
    examples = "\n".join(seeds.NOTICES + seeds.STATUS_LINES + seeds.LATIN + seeds.FILLERS + seeds.INSTRUCTIONS)
    unseen = [t for t in residue_cases.UNSEEN if t not in examples]
    found = [t for t, w in zip(unseen, fitted.windows(unseen, 8.0)) if w]
    assert len(unseen) >= 50 and len(found) >= 0.9 * len(unseen), set(unseen) - set(found)
    assert len(residue_cases.NEUTRAL) >= 50 and [w for w in fitted.windows(residue_cases.NEUTRAL, 8.0) if w] == []


@pytest.mark.parametrize("code", ["__init__", "__main__", "{train}", "[7]", "f(x, y)", "<div>", "5 < 7 and 9 > 3"])
def test_code_in_prose_is_not(fitted, code):
    assert fitted.windows([f"The value of {code} is kept as it was in the second run."], 8.0) == [[]]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found_alone_and_amid_prose(models, text):
    amid = f"{PROSE[0]}\n\n{text}\n\n{PROSE[3]} {PROSE[1]}"
    alone, inside = models.windows([text, amid], 8.0)
    assert alone and inside
    for _, a, b, _ in inside:
        assert amid.index(text) <= a < b <= amid.index(text) + len(text)


@pytest.mark.parametrize("text", CLEAN + PROSE + ["", " ", "\n"])
def test_prose_about_it_is_not(models, text):
    assert models.windows([text, f"{PROSE[0]}\n\n{text}\n{PROSE[3]}"], 8.0) == [[], []]


def test_residue_documents(spark, models):
    rows = [(1, None), (2, " "), (3, PROSE[0]), (4, PROSE[0] + "\n" + seeds.NOTICES[0]), (5, seeds.FILLERS[0] + "\n" + seeds.FILLERS[0]), (6, PROSE[0] * 20_000 + " {{name}}"), (7, "{{name}}"), (7, "{{name}}")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    found = {r["doc_id"]: r for r in residue_documents(df, models=models).collect()}
    assert set(found) == {4, 5, 6, 7} and found[5]["coverage"] > 0.9 and found[6]["coverage"] < 1e-4 and found[4]["kinds"] == ["notice"]
    assert {r["doc_id"] for r in residue_documents(df, models=models, least_coverage=0.5).collect()} == {5, 7}
    assert find_residue(df, models=models).filter("doc_id = 6").first()["start"] == len(PROSE[0]) * 20_000 + 1
    assert residue_documents(df.limit(0)).count() == 0


def test_natural_prose_is_counted_over_all_documents(spark, models):
    # More documents than the sample that was, one of them long; the script of the last is nowhere else.
    rows = [(i, PROSE[i % 3]) for i in range(3500)] + [(5000, (PROSE[4] + "\n") * 900 + "The last line of a long one."), (5001, None), (5002, "この輪は外側から描いてください")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, here = fit_models(df).natural, ResidueModels([t for _, t in rows if t]).natural
    assert whole.total == here.total and all((a == b).all() for a, b in zip(whole.tables, here.tables))
    assert whole.total > sum(len(t) for _, t in rows[:3500])
    for text in ["この輪は外側から描いてください", "Внешнее кольцо рисуют первым", "วาดวงแหวนด้านนอกก่อน"]:  # unseen by every model
        assert models.windows([text, f"{PROSE[0]}\n{text}"], 8.0) == [[], []]


WIDE = ["{{ lot number }}", "${user name}", "{{ lot|upper }}", "{{ f() }}", "{{  lot  }}", "{{\n  lot\n}}", "{% if x %}", "{0}", "{{1}}", "%LOT%", "$LOT", "{{ " + "a" * 60 + " }}", "{{ lot | default('none') | upper }}", "{{ 'x'.join(a) }}"]


@pytest.mark.parametrize("mark", WIDE)
def test_marked_spans_of_any_content(models, mark):
    text = f"{PROSE[0]}\nThe lot {mark} was handed over."
    assert [x[:3] for x in models.windows([text], 8.0)[0]] == [("placeholder", text.index(mark), text.index(mark) + len(mark))]


@pytest.mark.parametrize("text", ['{"x": 236, "y": 3012}', "[[12, 34], [56, 78]]", "{1, 2, 3}", "5% of 10% and 7%", "It cost $5.", "__ and then we went on with it, as before. __", "if (x) { return y; }"])
def test_marked_data_is_no_placeholder(models, text):
    assert [x for x in models.windows([f"{PROSE[0]}\n{text}"], 8.0)[0] if x[0] == "placeholder"] == []


def test_instructions_without_brackets(models):
    for text in ["Insert lot number here", "Station: insert lot number here", "Lot: enter description"]:
        assert "instruction" in {x[0] for x in models.windows([f"{PROSE[0]}\n{text}\n{PROSE[1]}"], 8.0)[0]}


@pytest.mark.parametrize("residue", ["please enable JavaScript in your browser to view this page", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod"])
@pytest.mark.parametrize("join", [", ", ": ", " - ", " | "])
def test_residue_inside_a_longer_line(models, residue, join):
    prose = " and ".join(p.rstrip(".").replace(". ", ", ") for p in PROSE[:4])
    for text in (f"{prose}{join}{residue}{join}{prose}", f"{prose} {prose} {prose} {residue} {prose}"):
        found = models.windows([text], 8.0)[0]
        a, b = text.index(residue), text.index(residue) + len(residue)
        assert found and sum(max(0, min(b, y) - max(a, x)) for _, x, y, _ in found) > 0.7 * len(residue) and all(a - 8 <= x < y <= b + 8 for _, x, y, _ in found)
