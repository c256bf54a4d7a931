"""Operators against brute force, round trips and planted truth, with nulls, ties, repeats and empty tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxloom.llm import canon, components, consensus, mixture, packing, pieces, spans, unify, variants
from voxloom.llm.names import distance, letters, parse

random.seed(11)


# ---------------------------------------------------------------- 1: pieces


def test_cuts_keep_limit_overlap_and_text():
    for _ in range(600):
        text = "".join(random.choices(list("咚字a，。\n」") + ["́"], k=random.choice([0, 1, 60, 400, 900])))
        limit, overlap = random.choice([20, 48]), random.choice([0, 5, 9])
        last = 0
        for k, (end, _) in enumerate(pieces.cuts(text, limit, overlap)):
            assert 0 < end - last <= limit - overlap * (k > 0) or not text
            last = end
        assert last == len(text)


def test_cuts_prefer_natural_boundaries():
    text = "。".join("字" * 30 for _ in range(20)) + "。"
    assert all(text[end - 1] == "。" for end, _ in pieces.cuts(text, 100, 10))
    with pytest.raises(ValueError):
        pieces.cuts("x", 10, 10)


def test_pieces_round_trip(spark):
    rows = [("p1", "s1", 1, "甲" * 50), ("p2", "s1", 2, "乙。" * 40), ("p3", "s1", None, "丙\n丙" * 9), ("p4", None, 4, "x" * 70), ("p5", "s2", 5, None), ("p6", "s2", 6, ""), ("p7", "s1", 3, "短")]
    lines = spark.createDataFrame(rows, "paragraph_id string, scene_id string, paragraph_index int, text string")
    cut = pieces.oversized_pieces(lines, 40, 60, 7)
    got = defaultdict(list)
    for r in cut.collect():
        got[r.item_kind, r.item_id].append(r)
    scene = "\n".join([rows[2][3], rows[0][3], rows[1][3], rows[6][3]])
    whole = {("paragraph", r[0]): r[3] for r in rows if r[3] and len(r[3]) > 40} | {("scene", "s1"): scene}
    assert set(got) == set(whole)
    for key, parts in got.items():
        parts.sort(key=lambda r: (r.segment, r.piece_index))
        assert "".join(r.text[r.overlap :] for r in parts) == whole[key]
        assert all(len(r.text) <= (40 if key[0] == "paragraph" else 60) for r in parts)
        assert all(b.overlap == 7 and a.text.endswith(b.text[:7]) for a, b in zip(parts, parts[1:]) if len(a.text) >= 7)
    found = {tuple(r) for r in pieces.oversized_items(cut, 40).collect()}
    assert ("unbroken", "p4") in found and ("unbroken", "p2") not in found and ("scene", "s1") in found
    assert pieces.oversized_pieces(lines.limit(0), 40, 60, 7).count() == 0


def test_scene_segments_are_bounded(spark):
    lines = spark.range(3000).select(F.lit("s").alias("item_id"), F.col("id").alias("pos"), F.concat(F.lit("行"), "id").alias("text"))
    got = sorted(pieces.scene_segments(lines, pieces.scene_sizes(lines, 0), 1000).collect(), key=lambda r: r.segment)
    assert "".join(r.text for r in got) == "\n".join(f"行{i}" for i in range(3000)) and max(len(r.text) for r in got) < 1100


def _price(text, ends, limit, overlap):
    at, cost = pieces.choices(text, limit - overlap)
    of, even = dict(zip(at.tolist(), cost)), len(text) / -(-len(text) // (limit - overlap))
    return sum(of[e] * (e < len(text)) + ((e - b - even) / even) ** 2 for b, e in zip([0, *ends], ends))


def test_a_scene_in_segments_is_cut_like_a_whole_one(spark):
    make = lambda k: "".join(random.choices("甲乙丙，。！ ", weights=[9, 9, 9, 2, 1, 1, 1], k=k))
    scenes = {
        "even": [make(random.randint(0, 40)) for _ in range(400)],
        "long line": [make(30), "字" * 900, "短", make(200), "咚" * 2100, "x", make(300)] + [make(20) for _ in range(60)],
        "just over": [make(30) for _ in range(20)],
    }
    rows = [(f"{s}{i}", s, i, t) for s, lines in scenes.items() for i, t in enumerate(lines)]
    lines = spark.createDataFrame(rows, "paragraph_id string, scene_id string, paragraph_index int, text string")
    for segment_chars in (300, 500, 2000):
        got = defaultdict(list)
        for r in pieces.oversized_pieces(lines, 10_000, 60, 7, segment_chars).collect():
            got[r.item_id].append(r)
        for s, parts in got.items():
            text = "\n".join(scenes[s])
            parts.sort(key=lambda r: (r.segment, r.piece_index))
            assert "".join(r.text[r.overlap :] for r in parts) == text and all(len(r.text) <= 60 for r in parts)
            assert all(b.overlap == 7 and a.end == b.start and text[b.start - 7 : b.end] == b.text for a, b in zip(parts, parts[1:]))
            whole = [e for e, _ in pieces.cuts(text, 60, 7)]
            assert abs(_price(text, [r.end for r in parts], 60, 7) - _price(text, whole, 60, 7)) < 1e-6, (s, segment_chars)
        assert set(got) == set(scenes)


def test_cuts_are_the_best_of_all():
    from itertools import combinations

    for _ in range(40):
        text = "".join(random.choices("甲乙。\n，", weights=[6, 6, 2, 1, 1], k=random.randint(13, 22)))
        at = pieces.choices(text, 9)[0].tolist()
        ways = [[*c, len(text)] for n in range(0, 5) for c in combinations([p for p in at if p < len(text)], n)]
        ways = [w for w in ways if w[0] <= 12 and all(b - a <= 9 for a, b in zip(w, w[1:]))]
        assert abs(_price(text, [e for e, _ in pieces.cuts(text, 12, 3)], 12, 3) - min(_price(text, w, 12, 3) for w in ways)) < 1e-9


# ---------------------------------------------------------------- 2: mapping


def test_distance_is_a_metric():
    words = ["".join(random.choices("abc", k=random.randint(0, 5))) for _ in range(40)]
    for a in words:
        for b in words:
            assert distance(a, b) == distance(b, a) and (distance(a, b) == 0) == (a == b)
            for c in words[:12]:
                assert distance(a, c) <= distance(a, b) + distance(b, c)
    assert distance("ab", "ba") == 1 and distance("ca", "abc") == 2


def test_tree_finds_all_within():
    words = list({"".join(random.choices("abcd", k=random.randint(1, 6))) for _ in range(300)})
    tree = canon.Tree()
    for w in words:
        tree.add(w, w)
    for q in words[:40]:
        for r in (1, 2):
            assert {k for _, k in tree.within(q, r)} == {w for w in words if distance(w, q) <= r}


CAST = [("c1", "奇勒金·露戈哈", ["月之弦杯厨娘", "大叔"], ["守门官"]), ("c2", "奎威奈·内琼菲", ["大叔", "奎威奈"], []), ("c3", "Ann Lee", None, None)]
STATES = [("st_01", "known", "已确认身份的角色"), ("st_02", "mystery", "有名号但真实身份成谜"), ("st_03", "npc", "h"), ("st_04", "npc_group", "i"), ("st_05", "npsx", None)]


@pytest.mark.parametrize("limit", [10_000, 7])
def test_values_map_to_their_entry(spark, limit):
    keys = spark.createDataFrame(canon.person_keys(CAST), "kind string, key string, entry string")
    want = {
        "奇勒金·露戈哈": "c1", "露戈哈·奇勒金": "c1", "Lugeha, Qilejin": "c1", "月的弦杯厨娘": "c1", "守门官奇勒金＝露戈哈": "c1", "奇金勒·露戈哈": "c1", "“奎威奈”": "c2",
        "露戈哈先生": "c1", "奎·内琼菲": "c2", "奎威奈·內瓊菲（画外音）": "c2", "巴多布·露戈哈": "none", "大叔": "none", "？？？": "none", "": "none", " ": "none", "lee ann": "c3",
    }
    values = spark.createDataFrame([(v, 1) for v in want] * 2, "value string, extra int")
    got = canon.map_values(values, keys, "person", broadcast_keys=limit).collect()
    assert len(got) == 2 * len(want) and {r.value: r.ref_id for r in got} == want


def _edited(words):
    """Every word with one letter left out, doubled, replaced, or swapped with the next."""
    for w in words:
        for i in range(len(w)):
            yield from (w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :])


@pytest.mark.parametrize("how, entries", [("person", CAST), ("status", STATES)])
def test_shards_give_what_one_index_gives(spark, how, entries):
    schema = "id string, name string, aliases array<string>, titles array<string>" if how == "person" else "id string, name string, gloss string"
    keys = canon.keys_of(spark.createDataFrame(entries, schema), how)
    assert {tuple(r) for r in keys.collect()} == set((canon.person_keys if how == "person" else canon.status_keys)(entries))
    words = [x for e in entries for x in (e[1], *((e[2] or []) if how == "person" else [e[2] or ""]))]
    words += ["守门官奇勒金·露戈哈", "露戈哈先生"] if how == "person" else [w for x in canon.WORDINGS.values() for w in x] + ["npcx", "npcn", "nps", "npsc", "a known one", "确认身份"]
    values = spark.createDataFrame([(v,) for v in {*words, *_edited(words)}], "value string")
    one, many = ({r.value: r.ref_id for r in canon.map_values(values, keys, how, n, 50).collect()} for n in (100_000, 40))
    assert one == many and len(set(one.values())) > len(entries) - 1


def test_a_status_by_its_name_or_gloss_alone():
    index = canon.Index(canon.status_keys(STATES, {}))
    want = {"known speaker": "st_01", "mystery person": "st_02", "确认身份": "st_01", "真实身份": "st_02", "身份": None, "kno": "st_01", "nothing": None}
    assert {k: canon._winner(index.status(k)) for k in want} == want


def test_statuses():
    index = canon.Index(canon.status_keys([("st_01", "known", "已确认"), ("st_03", "npc", "h"), ("st_04", "npc_group", "i")]))
    want = {"ｋｎｏｗｎ　": "st_01", "[konwn]": "st_01", "已確認": "st_01", "npcc": "st_03", "NPCs": "st_04", "npc_gruop": "st_04", "ok": None, "-": None}
    assert {k: canon._winner(index.status(k)) for k in want} == want


# ---------------------------------------------------------------- 3: variants


def test_variants_link(spark):
    rows = [
        ("a1", "v1", ["奈史乌麦·阿格卢图", "晨塔的砂歌者"]), ("a2", "v1", ["Agelutu, Naishiwumai", "卫兵"]), ("a3", "v1", ["晨塔的砂歌者"]), ("a4", "v1", ["奈史乌乌麦·阿格卢图"]), ("a5", "v1", ["奈史乌麦君", None]),
        ("b1", "v1", ["哈兰盖基·阿格卢图"]), ("b2", "v2", ["奈史乌麦·阿格卢图"]), ("c1", "v1", ["队长"]), ("c2", "v1", ["队长"]), ("d1", "v1", [None]), ("d2", "v1", None), ("e1", "v1", ["悠郎 黑泽"]), ("e2", "v1", ["黑泽悠郎阁下"]), ("e3", "v1", ["黑泽真郎"]),
        ("f1", "v1", ["Korafï Nabasird"]), ("f2", "v1", ["KORAFI NABASIRD"]), ("f3", "v1", ["K. Nabasird"]), ("g1", None, ["Solo Name"]),
    ]
    people = variants.link_names(spark.createDataFrame(rows, "id string, volume string, names array<string>"))
    got = {tuple(r) for r in variants.linked_pairs(people).collect()}
    groups = [["a1", "a2", "a3", "a4", "a5"], ["e1", "e2"], ["f1", "f2", "f3"]]
    assert got == {(x, y) for g in groups for x in g for y in g if x < y}
    assert variants.link_names(spark.createDataFrame([], "id string, volume string, names array<string>")).count() == 0


def _linked(spark, rows):
    people = variants.link_names(spark.createDataFrame(rows, "id string, volume string, names array<string>"))
    return {tuple(r) for r in variants.linked_pairs(people).collect()}


def test_weights_decide_between_relatives_and_slips(spark):
    family = [(f"r{i}", "v1", [f"{g}·阿格卢图"]) for i, g in enumerate(["哈兰盖基", "布罗尼莎", "科妮莱多", "梅森戈尔", "提尔沃南", "洛库瑞奇"])]
    # one syllable of the given name differs: relatives if several records use both, a slip if only one has it
    relatives = [("a1", "v1", ["奈史乌麦·阿格卢图"]), ("a2", "v1", ["阿格卢图·奈史乌麦"]), ("b1", "v1", ["奈史乌莱·阿格卢图"]), ("b2", "v1", ["Naishiwulai Agelutu"])]
    slip = [("a3", "v1", ["奈史乌乌麦·阿格卢图"])]
    # a slip in each part
    both = [("c1", "v1", ["盖多塔帕·皮霍里夏尼"]), ("c2", "v1", ["盖多帕塔·皮里霍夏尼"])]
    # a slip in a short part weighs too much in the rare given name, not in the family name that many share
    short = [("d1", "v1", ["达乌·阿格卢图"]), ("d2", "v1", ["达尼·阿格卢图"])]
    got = _linked(spark, family + relatives + slip + both + short)
    assert got == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("b1", "b2"), ("c1", "c2")}


def test_rare_parts_count_more():
    parts = variants.Parts({"lu ge": 9.0, "lu ne": 9.0, "shi wu": 3.0, "shi mu": 3.0}, {"lu ge": 5, "lu ne": 1, "shi wu": 5, "shi mu": 1})
    in_common = variants.similarity("lu ge", "shi wu", "lu ge", "shi mu", parts)
    in_rare = variants.similarity("lu ge", "shi wu", "lu ne", "shi wu", parts)
    assert in_common > variants.VERIFIED > in_rare
    assert variants.similarity("lu ge shi wu", "", "lu ge", "shi wu", variants.Parts({"lu ge": 9.0, "shi wu": 3.0, "lu ge shi wu": 9.0, "": 1.0}, {"lu ge": 2, "shi wu": 2})) == 1.0


def test_nicknames_given_beside_a_full_name(spark):
    rows = [("a", "v", ["奈史乌麦·阿格卢图", "小鹰"]), ("b", "v", ["小鹰"]), ("c", "v", ["哈兰盖基·穆罗舍", "阿狸"]), ("d", "v", ["布罗尼莎·穆罗舍", "阿狸"]), ("e", "v", ["阿狸"]), ("f", "w", ["小鹰"])]
    assert _linked(spark, rows) == {("a", "b")}


def test_parsing_names():
    assert parse("Dr. Sohogol Wodoxe").parts == ("Sohogol", "Wodoxe") and parse("BanégerPemago").parts == ("Banéger", "Pemago")
    assert parse("神秘人").kind == "role" and parse(None) is None and parse("…") is None and letters("奈史乌麦") == "naishiwumai"


# ---------------------------------------------------------------- 4: components


def _roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in up}


def test_components_against_union_find(spark):
    edges = [(f"n{random.randint(0, 400):03}", f"n{random.randint(0, 400):03}") for _ in range(300)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"h{i}") for i in range(60)] + [(None, "x"), ("x", None), ("y", "y"), ("n001", "n000"), ("n000", "n001")]
    df = spark.createDataFrame([(*e, 1) for e in edges], "a string, b string, component int")
    assert {tuple(r) for r in components.connected_components(df).collect()} == _roots(edges)
    assert components.connected_components(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 5: consensus


def test_consensus_beats_majority(spark):
    skill = {"good1": 0.92, "good2": 0.9, "mid": 0.65, "bad1": 0.45, "bad2": 0.45, "noise": 0.2}
    rows, truth = [], {}
    for i in range(3000):
        truth[f"d{i}"] = t = f"s{random.randint(0, 4)}"
        copied = None
        for m, p in skill.items():
            if random.random() < 0.25:
                continue
            label = t if random.random() < p else f"s{random.randint(0, 4)}"
            if m == "bad1":
                copied = label
            if m == "bad2" and copied and random.random() < 0.8:
                label = copied
            rows.append((f"d{i}", m, None if random.random() < 0.03 else label, random.choice([None, 0.5, 87.0, -1.0])))
    rows += rows[:50] + [(None, "mid", "s1", 0.5), ("d1", None, "s1", 0.5)]
    items, annotators = consensus.consensus(spark.createDataFrame(rows, "item string, model string, label string, confidence double"))
    got = {r["item"]: r for r in items.collect()}
    majority = {}
    for d in truth:
        votes = Counter(x[2] for x in {x[:3] for x in rows} if x[0] == d and x[2] and x[1])
        if votes:
            majority[d] = min(votes, key=lambda s: (-votes[s], s))
    score = lambda of: sum(of[d] == truth[d] for d in majority) / len(majority)
    assert set(got) == set(majority) and score({d: r.label for d, r in got.items()}) > score(majority) + 0.03
    r = {x.model: x for x in annotators.collect()}
    assert r["good1"].reliability > r["mid"].reliability > r["noise"].reliability and (r["bad1"].copies_of or r["bad2"].copies_of)
    assert all(x.agreement is None or 0 <= x.agreement <= 1 for x in got.values())


def _met(spark, skills, chance, n=400):
    """The agreement of annotators with these reliabilities, without noise; every seventh pair never met."""
    rows = [(f"m{i}", f"m{j}", n + 10 * (i + j), chance + (1 - chance) * a * b) for i, a in enumerate(skills) for j, b in enumerate(skills) if i != j and (i + j) % 7]
    return spark.createDataFrame(rows, "a string, b string, n long, agree double")


@pytest.mark.parametrize("skills, chance", [([0.2, 0.25, 0.3, 0.35, 0.4, 0.5], 0.1), ([0.6, 0.7, 0.75, 0.8, 0.9, 0.95], 0.1), ([0.05, 0.2, 0.5, 0.8, 0.9, 0.95, 0.3], 0.22)])
def test_fit_recovers_planted_reliabilities(spark, skills, chance):
    from voxloom.sources.scratch import Scratch

    for start in (0.1, 0.9):
        c, v = consensus.fit(_met(spark, skills, chance), Scratch(spark), "planted", start)
        got = {r.model: r.r for r in v.where(F.col("c") == c).collect()}
        assert abs(c - chance) < 0.03 and all(abs(got[f"m{i}"] - s) < 0.01 for i, s in enumerate(skills))


def test_fit_is_the_leading_eigenvector(spark):
    import numpy as np

    from voxloom.sources.scratch import Scratch

    names = [f"m{i}" for i in range(7)]
    rows = [r for r in _met(spark, [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.4], 0.2).collect() if r.a < r.b]
    rows = [(a, b, n, agree + random.uniform(-0.05, 0.05)) for a, b, n, agree in rows]
    both = spark.createDataFrame([*rows, *((b, a, n, g) for a, b, n, g in rows)], "a string, b string, n long, agree double")
    c, v = consensus.fit(both, Scratch(spark), "noisy")
    r = np.array([x.r for x in v.where(F.col("c") == c).orderBy("model").collect()])
    filled, most = np.outer(r, r), max(x[2] for x in rows)
    for a, b, n, agree in rows:
        i, j, w = names.index(a), names.index(b), n / most
        filled[i, j] = filled[j, i] = w * (agree - c) / (1 - c) + (1 - w) * r[i] * r[j]
    values, vectors = np.linalg.eigh(filled)
    assert np.abs(np.abs(vectors[:, -1]) * np.sqrt(values[-1]) - r).max() < 2e-3


def test_reliabilities_of_many_items(spark):
    skill = {"a": 0.9, "b": 0.8, "c": 0.6, "d": 0.5, "e": 0.3, "f": 0.05}
    rows = []
    for i in range(6000):
        t = random.randint(0, 3)
        # sure votes are right, unsure ones a guess, so that the level tells them apart
        for m, p in skill.items():
            knows = random.random() < p
            rows.append((f"d{i}", m, f"s{t if knows else random.randint(0, 3)}", (0.9 if knows else 0.2) if m == "c" else 0.5))
    votes = spark.createDataFrame(rows, "item string, model string, label string, confidence double")
    items, annotators = consensus.consensus(votes)
    got = {r.model: r for r in annotators.collect()}
    assert all(abs(got[m].reliability - p) < 0.05 for m, p in skill.items()) and abs(got["a"].chance - 0.25) < 0.05
    assert items.count() == 6000


def test_consensus_of_little(spark):
    schema = "item string, model string, label string, confidence double"
    assert consensus.consensus(spark.createDataFrame([], schema))[0].count() == 0
    one = consensus.consensus(spark.createDataFrame([("d", "m", "b", 0.1), ("d", "n", "a", 0.1), ("e", "m", None, None)], schema))[0].collect()
    assert [(r["item"], r.label, r.n_models, r.agreement) for r in one] == [("d", "a", 2, 0.0)]


# ---------------------------------------------------------------- 6: canonical text


def test_canonical_forms():
    same = [("守⻔官", "守门官"), ("ＡＢ１", "AB1"), ("éx", "éx"), ("РАСТ", "PACT"), ("a​b️", "ab"), ("x　y", "x y"), ("⋯⋯", "……"), ("エ作", "工作"), ("Fiwӧlal", "Fiwölal"), ("ｶﾞ", "ガ"), ("e‍́", "é")]
    for a, b in same:
        assert unify.canonical(a) == unify.canonical(b) == unify.canonical(unify.canonical(a)), (a, b)
    apart = [("瓊", "琼"), ("A", "a"), ("é", "e"), ("。", "!"), ("……", "....."), ("ロシア", "口シア"), ("....", "…")]
    assert all(unify.canonical(a) != unify.canonical(b) for a, b in apart)
    same = [("……", "......"), ("Wait...", "Wait…"), ("𝐀b", "Ab"), ("Ⅳ", "IV"), ("ϲat", "cat"), ("օk", "ok"), ("ᎪB", "AB")]
    assert all(unify.canonical(a) == unify.canonical(b) for a, b in same)
    assert unify.canonical("Анна") == "Анна" and unify.canonical(None) is None and unify.canonical("") == ""


def test_same_reading_pairs(spark):
    rows = [("k", "1", "ＡＢ"), ("k", "2", "AB"), ("k", "3", "AB"), ("k", "4", None), ("j", "5", "AB"), ("k", "6", ""), ("k", "7", "​"), ("k", "8", "A­B")]
    got = {tuple(r) for r in unify.same_reading_pairs(spark.createDataFrame(rows, "item_kind string, item_id string, text string"), salts=3).collect()}
    assert got == {("k", "1", "2"), ("k", "1", "3"), ("k", "1", "8"), ("k", "2", "8"), ("k", "3", "8"), ("k", "6", "7")}


# ---------------------------------------------------------------- 7: packing


def test_packing(spark):
    rows = [(i, random.choice(["a", "a", "b", None]), random.choice([0, 5, 90, 260, 1000, 2048, 5000])) for i in range(4000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    got = packing.pack_texts(sized, 2048).collect()
    room = Counter()
    for r in got:
        room[r.container_id] += r.tokens
    assert max(room.values()) <= 2048
    texts = Counter()
    for r in got:
        texts[r.doc_id] += r.tokens
    assert texts == Counter({i: t for i, _, t in rows if t})
    assert all(r.piece == 0 for r in got if dict((x[0], x[2]) for x in rows[r.doc_id : r.doc_id + 1])[r.doc_id] <= 2048)
    report = packing.fill_report(packing.pack_texts(sized, 2048), 2048).first()
    # as few containers as packing all texts at once takes; how much room these sizes leave depends on the draw
    cut = [min(2048, t - k) for _, _, t in rows for k in range(0, t, 2048)]
    assert report.containers == len(room) <= len(packing.best_fit(cut, 2048)) + 2
    assert packing.pack_texts(sized.limit(0), 2048).count() == 0


def test_windows_keep_the_mixture():
    items = [(i, 0, "a" if i % 4 else "b", 100) for i in range(8000)] + [(9000 + i, 0, "rare", 100) for i in range(40)]
    closed, rest = packing.pack(items, 1000, True)
    by_window = defaultdict(Counter)
    for box in closed:
        for w, x in box:
            by_window[w][x[2]] += x[3]
    assert len(by_window) == 3 and not rest
    for held in by_window.values():
        assert abs(held["b"] / sum(held.values()) - 0.25) < 0.01 and held["rare"] > 1000


def test_every_window_of_many_buckets_keeps_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 800_000)
    monkeypatch.setattr(packing, "WINDOW", 48)
    monkeypatch.setattr(packing, "BLOCK_TEXTS", 700)
    draw = random.Random(5)
    rows = [(i, draw.choice("aaaab") if i % 9 else draw.choice(["c", None]), draw.choice([20, 90, 260, 400])) for i in range(30_000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    packed = packing.pack_texts(sized, 2048)
    report = packing.window_report(packed).collect()
    off = {r.window_id: r.window_deviation for r in report}
    assert len(off) > 50 and max(off.values()) < 0.05
    assert all(abs(sum(r.share for r in report if r.window_id == w) - 1) < 1e-9 for w in list(off)[:5])
    texts, room = Counter(), Counter()
    for r in packed.collect():
        texts[r.doc_id] += r.tokens
        room[r.container_id] += r.tokens
    assert texts == Counter({i: t for i, _, t in rows}) and max(room.values()) <= 2048
    # the sizes are tens, so 2,040 is a full container and 0.4 % of the room can't be filled
    assert packing.fill_report(packed, 2048).first().empty_share < 0.005


# ---------------------------------------------------------------- 8: mixture


def test_mixture(spark):
    rows = [(i, random.choice(["big", "big", "big", "small", "free", None]), random.randint(0, 400)) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), (" SMALL", 0.3, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(sized, targets)
    got, shares = mixed.collect(), {r.source: r for r in report.collect()}
    assert max(r.copies for r in got if r.source == "small") <= 3 and max(r.copies for r in got if r.source == "big") <= 1
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"big", "small"}
    total = sum(r.tokens * r.copies for r in got)
    assert abs(shares["big"].reached_share - 2 / 3) < 400 / total * 2 and shares["gone"].texts == 0 and shares["free"].mixed_tokens == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixture.mix(sized, targets)[0].collect()))
    assert mixture.mix(sized.limit(0), targets)[0].count() == 0


def test_pivotal_keeps_mass_and_expectation():
    rows = [(i, random.randint(1, 50), 0.3) for i in range(60)]
    mass = sum(w * p for _, w, p in rows)
    hits = Counter()
    for seed in range(400):
        out = mixture.pivotal(rows, seed)
        assert abs(sum(w * p for _, w, p in out) - mass) < 1e-6 and sum(0 < p < 1 for *_, p in out) <= 1
        for i, _, p in out:
            hits[i] += p
    assert all(0.18 < hits[i] / 400 < 0.42 for i, _, _ in rows)


# ---------------------------------------------------------------- 9: spans


def _brute(docs, n):
    held = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - n + 1):
            held[t[p : p + n]].add(i)
    return {(a, b) for s in held.values() for a in s for b in s if a < b}


def test_spans_against_brute_force(spark):
    make = lambda k: "".join(random.choices("甲乙丙丁戊己庚辛abc𝔸", k=k))
    shared = [make(k) for k in (64, 64, 63, 100, 300)] + ["咚" * 200, make(20) * 9]
    docs = []
    for i in range(120):
        t = make(random.randint(0, 200))
        for s in random.sample(shared, random.choice([0, 0, 1, 2])):
            a = random.randint(0, max(0, len(s) - 64))
            t += s[a:] + make(random.randint(0, 90))
        docs.append((i, t))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (None, shared[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = spans.shared_spans(df)
    known = [d for d in docs if d[0] is not None]
    assert {tuple(r) for r in spans.sharing_pairs(found).collect()} == _brute(known, 64)
    text = dict(known)
    assert all(text[r.doc_id][r.start : r.start + r.n_chars] == r.span for r in found.collect())
    parts = {r.doc_id: r for r in spans.shared_parts(found, df.where("doc_id is not null")).collect()}
    held = defaultdict(set)
    for i, t in known:
        for p in range(len(t or "") - 63):
            held[t[p : p + 64]].add((i, p))
    for i, t in known:
        cover = {q for s in held.values() if len({d for d, _ in s}) > 1 for d, p in s if d == i for q in range(p, p + 64)}
        assert (parts[i].shared_chars or 0) == len(cover), i
    assert parts[500].shared_chars is None and spans.shared_spans(df.limit(0)).count() == 0


def test_window_hashes_tell_windows_apart():
    import numpy as np

    codes = np.frombuffer("abcabcabd".encode("utf-32-le"), dtype=np.uint32)
    h = spans.window_hashes(codes, 3)
    assert len(h) == 7 and h[0] == h[3] and h[0] != h[6] and len(spans.window_hashes(codes, 10)) == 0


def test_patterns_compile():
    assert all(re.compile(p.pattern) for p in unify._tables()[1:3])
    fold, _, segment, _ = unify._tables()
    # what the JVM takes for stable is rewritten by nothing
    stable = [*map(chr, range(0x80)), *map(chr, range(0x4E00, 0xA000)), *"。、「」『』《》…—“”‘’"]
    assert not [c for c in stable if c in fold or c in unify._TWINS or c in unify.KANA or unify.canonical(c) != c]


# ---------------------------------------------------------------- odd inputs


def _loud(df, *names):
    """The table with extra columns whose names the operators use inside."""
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def test_clashing_columns_and_empty_tables(spark):
    edges = _loud(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"), "u", "v", "m", "low", "node", "component")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    sized = _loud(spark.createDataFrame([(1, "s", 10), (2, None, 10), (3, "s", None)], "doc_id long, source string, tokens long"), "bucket", "copies", "piece", "o", "whole", "p", "level", "s", "t", "b", "block", "run")
    assert packing.pack_texts(sized, 16).count() == 2
    targets = _loud(spark.createDataFrame([("s", 1.0, 2), (None, 0.5, 2)], "source string, target_share double, max_repeats int"), "available", "copies")
    assert [(r.doc_id, r.copies) for r in mixture.mix(sized, targets)[0].collect()] == [(1, 2)]
    names = _loud(spark.createDataFrame([("1", "v", ["甲乙·丙丁"]), ("2", "v", ["甲乙丙丁"])], "id string, volume string, names array<string>"), "kind", "a", "b", "f", "person", "component")
    assert variants.link_names(names).select("person").distinct().count() == 1
    votes = _loud(spark.createDataFrame([("d", "m", "s", None)], "item string, model string, label string, confidence double"), "level", "w", "cast", "r", "votes")
    assert consensus.consensus(votes)[0].first().label == "s"
    texts = _loud(spark.createDataFrame([("k", "1", "Ａ"), ("k", "2", "A")], "item_kind string, item_id string, text string"), "canon", "k", "v", "salt")
    assert unify.same_reading_pairs(texts).count() == 1 and unify.same_reading_pairs(texts.limit(0)).count() == 0
    docs = _loud(spark.createDataFrame([(1, "字" * 70), (2, "字" * 80)], "doc_id long, text string"), "h", "e", "pos", "anchors", "span", "at")
    assert [tuple(r) for r in spans.sharing_pairs(spans.shared_spans(docs)).collect()] == [(1, 2)]
    lines = _loud(spark.createDataFrame([("p", "s", 1, "字" * 70)], "paragraph_id string, scene_id string, paragraph_index int, text string"), "item_id", "segment", "block", "n", "total")
    assert pieces.oversized_pieces(lines, 40, 50, 5).count() == 4
    keys = spark.createDataFrame(canon.person_keys(CAST), "kind string, key string, entry string")
    values = _loud(spark.createDataFrame([("奎威奈",), (None,)], "value string"), "ref_id", "e", "rank", "entry")
    for limit in (10_000, 7):
        assert [r.ref_id for r in canon.map_values(values, keys, "person", broadcast_keys=limit).collect()] == ["c2"]
        assert canon.map_values(values.limit(0), keys, "person", broadcast_keys=limit).count() == 0
    assert [r.ref_id for r in canon.map_values(values, keys.limit(0), "person").collect()] == ["none"]


def test_very_long_texts(spark):
    long = "甲乙丙。" * 200_000
    assert unify.canonical("Ａ" + long) == "A" + long
    last = 0
    for end, _ in pieces.cuts(long, 480, 40):
        assert end - last <= 480
        last = end
    assert last == len(long)
    docs = spark.createDataFrame([(1, "x" * 5 + "咚" * 100_000), (2, "咚" * 70 + "y")], "doc_id long, text string")
    assert [tuple(r) for r in spans.sharing_pairs(spans.shared_spans(docs)).collect()] == [(1, 2)]


def test_spans_with_hot_keys(spark, monkeypatch):
    from voxloom.llm import base

    monkeypatch.setattr(base, "HOT_LEAST", 2)
    monkeypatch.setattr(base, "HOT_SHARE", 40)
    monkeypatch.setattr(spans, "PAIR_BLOCK", 3)
    monkeypatch.setattr(spans, "CHUNK_CHARS", 100)
    span, rare = ("".join(random.choices("甲乙丙丁戊己", k=90)) for _ in range(2))
    docs = [(i, f"第{i}篇" + (span if i % 3 == 0 else rare if i in (1, 2) else "") + "".join(random.choices("庚辛壬癸", k=80))) for i in range(40)]
    found = spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in spans.sharing_pairs(found).collect()} == _brute(docs, 64)
    assert found.groupBy("doc_id").count().count() == 16


def test_hubs_are_joined_apart(spark):
    edges = spark.createDataFrame([("hub", f"n{i:05}") for i in range(1500)] + [("a", "n00003")], "a string, b string")
    got = components.connected_components(edges).select("component").distinct().collect()
    assert [r.component for r in got] == ["a"]
