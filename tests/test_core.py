"""Core operators on small fixtures: the cases that the driver's tables hold too rarely."""

import datetime
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import candidates as C
from voxloom.operators import entities as E
from voxloom.operators import responses as J
from voxloom.operators import rules as R
from voxloom.operators import segmentation as S
from voxloom.operators import store as M
from voxloom.operators import votes as V
from voxloom.operators import windows as W
from voxloom.operators.graph import groups, resolve_aliases
from voxloom.operators.running import running_total
from voxloom.plans import pipeline
from voxloom.sources import files

LINES = "dialogue_id string, window_id string, window_pos int, volume_id string, paragraph_index int, text string, kind string, narration array<string>, after string, context string"
OPTIONS = "window_id string, rank int, entity_id string, display string, names array<string>, markers array<string>"


def line(spark, *rows):
    """(id, pos, text, narration, after)"""
    return spark.createDataFrame([(i, "w", p, "v", p, t, "standalone", n, a, "\n".join([t, *n, a])) for i, p, t, n, a in rows], LINES)


def option(spark, *rows):
    return spark.createDataFrame([("w", k, f"char_{k}", r[0], list(r[0:1]) + list(r[1]), list(r[2])) for k, r in enumerate(rows)], OPTIONS)


def who(df):
    return {r.dialogue_id: (r.s.display, r.s.rule) for r in df.collect()}


def test_rules(spark):
    rows = line(spark, ("d1", 0, "我叫罗伦", [], ""), ("d2", 1, "咱饿了", [], ""), ("d3", 2, "走吧", ["赫萝低声说道"], ""), ("d4", 3, "你好吗？", [], "罗伦被询问后愣住"), ("d5", 4, "罗伦先生，坐", [], ""), ("d6", 5, "咱们走", [], ""), ("d7", 6, "嗯", ["罗伦被问到说的话"], ""))
    opts = option(spark, ("罗伦", [], []), ("赫萝", ["贤狼赫萝"], ["咱"]))
    assert who(R.self_introductions(rows, opts)) == {"d1": ("罗伦", "self_intro")}
    assert who(R.by_marker(rows, opts)) == {"d2": ("赫萝", "marker")}
    assert who(R.by_attribution(rows, opts)) == {"d3": ("赫萝", "attribution")}
    found = who(R.anchors(rows, opts))
    assert found["d4"] == ("赫萝", "listener") and found["d5"] == ("赫萝", "addressed") and "d7" not in found and "d6" not in found
    seg = spark.createDataFrame([(f"d{i + 1}", "w", 0, i) for i in range(4)], "dialogue_id string, window_id string, segment int, segment_pos int")
    anchored = spark.createDataFrame([("d1", ("char_0", "罗伦", "known", 0.98, "x"))], f"dialogue_id string, s {R.SPEAKER}")
    assert who(R.alternation(rows, opts, seg, anchored)) == {"d2": ("赫萝", "turns"), "d3": ("罗伦", "turns"), "d4": ("赫萝", "turns")}
    clash = anchored.union(spark.createDataFrame([("d3", ("char_1", "赫萝", "known", 0.98, "x"))], anchored.schema))
    assert who(R.alternation(rows, opts, seg, clash)) == {}
    villager = who(R.anchors(line(spark, ("d", 0, "罗伦先生好", ["深山的路"], "")), option(spark, ("罗伦", [], []))))
    assert villager == {"d": (R.VILLAGER, "addressed")}


DIALOGUE = "dialogue_id string, text string, dialogue_kind string, context array<string>"
VOTE = "dialogue_id string, model string, weight double, confidence double, speaker_entity_id string, speaker_display string, speaker_status string, needs_review boolean, pos int, evidence array<string>"


def verdict(spark, votes, text="走吧", kind="standalone", context=(), anchored=True):
    d = spark.createDataFrame([("d", text, kind, list(context))], DIALOGUE)
    v = spark.createDataFrame([("d", m, w, c, e, n, s, False, i, list(ev)) for i, (m, w, c, e, n, s, ev) in enumerate(votes)], VOTE)
    r = V.aggregate_votes(d, v, anchored).first()
    return r.speaker_display, r.speaker_status, r.review_reason


def test_votes(spark):
    one = [("m", 1.0, 0.9, "c1", "罗伦", "known", [])]
    assert verdict(spark, one)[2] == "single_model_without_anchor"
    assert verdict(spark, one, context=["罗伦点头说道"])[1:] == ("known", "")
    assert verdict(spark, one, context=["罗伦听说的话"])[2] == "single_model_without_anchor"
    assert verdict(spark, one, text="我叫罗伦")[1:] == ("known", "")
    assert verdict(spark, one, anchored=False)[1:] == ("known", "")
    assert verdict(spark, one, text="他的名字是罗伦")[2] == "speaker_contradiction:third_person_name_reference"
    assert verdict(spark, one, kind="inline")[2] == "non_standalone_quote"
    assert verdict(spark, [("m", 1.0, 0.9, "x", "谜", "mystery", [])])[2] == "single_model_mystery_candidate"
    rule = [("a", 1.0, 0.9, "c2", "赫萝", "known", []), ("b", 1.0, 0.9, "c2", "赫萝", "known", []), ("rule:context", 1.0, 0.98, "c1", "罗伦", "known", [])]
    assert verdict(spark, rule) == ("罗伦", "known", "")
    assert verdict(spark, [("a", 1.0, 0.5, "c1", "甲", "known", []), ("b", 1.0, 0.4, "c2", "乙", "known", [])])[2] == "low_agreement:0.25;margin:0.05;support:1"
    assert verdict(spark, []) == ("待复核", "review", "no_valid_votes")


def test_checks_and_repairs(spark):
    a = spark.createDataFrame([("d1", "c1", "甲", "known", 0.9, ["x"], False, ""), ("d2", "c1", "甲", "known", 0.9, [], False, "")], "dialogue_id string, speaker_entity_id string, speaker_display string, speaker_status string, confidence double, evidence array<string>, needs_review boolean, review_reason string")
    checks = spark.createDataFrame([("d1", "strong", "不合", ["y"], 0, False), ("d2", "weak", "z", [], 0, False)], "dialogue_id string, severity string, reason string, counter array<string>, pos int, resolved boolean")
    got = {r.dialogue_id: r for r in V.apply_checks(a, checks).collect()}
    assert got["d1"].needs_review and got["d1"].evidence == ["x", "y"] and not got["d2"].needs_review
    repairs = spark.createDataFrame([("d1", 0, "unchanged", "c2", "乙", "known", 0.8), ("d1", 1, "resolved", "c3", "丙", "known", 0.7), ("d2", 0, "needs_review", "c3", "丙", "known", 0.7)], "dialogue_id string, pos int, stop_reason string, speaker_entity_id string, speaker_display string, speaker_status string, confidence double")
    fixed = {r.dialogue_id: (r.speaker_display, r.repaired) for r in V.apply_repairs(a, repairs).collect()}
    assert fixed == {"d1": ("丙", True), "d2": ("甲", False)}


def test_scenes_fold_over_the_cap(spark):
    text = ["前言", "第1章", *[f"行{i}" for i in range(5)], "插图", "＊＊＊", "后", "序", "尾声", "末"]
    got = S.chapters_and_scenes(spark.createDataFrame([("volume_01", i, t) for i, t in enumerate(text)], "volume_id string, line_index int, text string"), cap=3).orderBy("line_index").collect()
    assert [(r.chapter_index, r.scene_index) for r in got] == [(0, 1), (1, 1), (1, 1), (1, 1), (1, 2), (1, 2), (1, 2), (1, 2), (1, 2), (1, 3), (1, 3), (2, 1), (2, 1)]
    assert got[1].paragraph_id == "volume_01-c001-s001-p000002" and got[0].chapter_title == "front_matter"


def test_running_total_over_blocks(spark):
    rows = running_total(spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.lit(2).alias("v")), ["k"], "o", "v", "t", block=7)
    assert all(r.t == 2 * (r.o + 1) for r in rows.collect())


def test_windows_and_packing(spark):
    schema = "dialogue_id string, dialogue_index int, volume_id string, chapter_id string, scene_id string, paragraph_index int"
    rows = [("d1", 0, "v", "c", "s1", 10), ("d2", 1, "v", "c", "s1", 11), ("d3", 2, "v", "c", "s1", 23), ("d4", 3, "v", "c", "s2", None)]
    got = {r.dialogue_id: r.window_id for r in W.dialogue_windows(spark.createDataFrame(rows, schema), 2, 4).collect()}
    assert got == {"d1": "d1_to_d2", "d2": "d1_to_d2", "d3": "d3", "d4": "d4"}
    p = spark.createDataFrame([("s", i, f"p{i}", n) for i, n in enumerate([1, 1, 0, 3, 1])], "scene_id string, paragraph_index int, paragraph_id string, n_dialogues int")
    jobs = {r.paragraph_id: r.request_id for r in W.pack_requests(p, 2, 2).collect()}
    assert jobs == {"p0": "s-r001", "p1": "s-r001", "p3": "s-r002", "p4": "s-r003"} or jobs["p2"] == jobs["p3"]


def test_entity_store(spark):
    schema = "entity_id string, volume_id string, seq int, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, confidence double, first_seen_scene_id string"
    rows = [("a", "v", 1, "克拉福·罗伦斯", ["商人"], None, ["咱", "这是一句很长很长的话"], 0.5, "s1"), ("b", "v", 2, "罗伦斯", [], ["骑士"], ["喵"], 0.9, "s2"), ("c", "v", 3, "赫萝", ["商人"], None, None, None, "s3"), ("d", "w", 1, "罗伦斯", None, None, None, 0.1, "s4"), ("e", "v", 4, " ", None, None, None, 0.1, "s4")]
    got = {r.first_record: r for r in E.upsert_characters(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "c", "d"} and got["a"].record_ids == ["a", "b"] and got["a"].titles == ["商人", "骑士"] and got["a"].speech_markers == ["咱", "喵"] and got["a"].confidence == 0.9 and got["c"].confidence == 0.5


def test_every_sure_edge_merges(spark):
    rows = [(1, "a", "b", 0.9), (2, "a", "c", 0.9), (3, "c", "b", 0.95), (4, "d", "a", 0.99), (5, "a", "e", 0.8), (6, "x", "y", 0.9), (7, "y", "x", 0.9), (8, "z", "z", 1.0), (9, None, "a", 1.0), (2, "a", "c", 0.9)]
    m = E.merges(spark.createDataFrame(rows, "edge_id int, source_entity_id string, target_entity_id string, confidence double"))
    assert {tuple(r) for r in m.collect()} == {("a", "b", 1), ("b", "c", 2), ("d", "c", 4), ("x", "y", 6)}
    assert {tuple(r) for r in resolve_aliases(m).collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("d", "c"), ("x", "y"), ("y", "y")}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "x"), (None, "q"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in groups(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "t"), ("y", "t"), ("t", "t")}
    got = {tuple(r) for r in resolve_aliases(e.toDF("source", "target")).collect()}
    assert got == {("a", "c"), ("b", "c"), ("c", "c"), ("x", "x"), ("y", "x"), ("t", "x")}
    assert groups(e.limit(0)).count() == 0 and resolve_aliases(e.limit(0).toDF("source", "target")).count() == 0


def test_answers(spark):
    raw = ['```json\n{"annotations": [{"dialogue_id": "d1", "speaker_display": "村民们", "speaker_status": "mystery", "confidence": 3}]}\n```', '说明 {"votes": [{"dialogue_id": "d1", "speaker_entity_id": "c1"}, {"dialogue_id": "d1", "speaker_entity_id": "c2", "speaker_status": "known"}]} 完', '{"speaker_entity_id": "c9", "speaker_status": "known"}', "nothing"]
    df = spark.createDataFrame([(f"r{i}", "m", x) for i, x in enumerate(raw)], "request_id string, model string, raw string").withColumn("v", J.parse_json(F.col("raw")))
    assert [r.request_id for r in df.where("v is null").collect()] == ["r3"]
    win = spark.createDataFrame([("r0", "d1"), ("r0", "d2"), ("r1", "d1"), ("r2", "d3")], "request_id string, dialogue_id string")
    got = {(r.dialogue_id, r.speaker_entity_id, r.speaker_status, r.confidence, r.needs_review) for r in J.votes(df.where("v is not null"), win, spark.createDataFrame([("m", 2.0)], "model string, weight double")).collect()}
    assert ("d1", "npc:村民们", "npc", 1.0, False) in got and ("d1", "c2", "known", 0.0, False) in got and ("d3", "c9", "known", 0.0, False) in got and any(x[0] == "d2" and x[2] == "review" for x in got)
    lines = spark.createDataFrame([("r", 0, '{"response": "甲"}'), ("r", 1, ""), ("r", 2, '{"response": "乙", "done": true}'), ("r", 3, '{"response": "丙"}'), ("s", 0, '{"error": "bad"}')], "request_id string, pos int, line string")
    assert {r.request_id: (r.raw, r.error) for r in J.join_stream(lines).collect()} == {"r": ("甲乙", None), "s": ("", "bad")}


def test_candidates(spark):
    cards = spark.createDataFrame([("c1", "v", "罗伦斯", ["行商人罗伦"], ["商人", "会长"], [], "s1", "s2", 0.5), ("c2", "v", "赫萝", ["咱"], None, None, "s9", "s9", None)], "entity_id string, volume_id string, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, first_seen_scene_id string, latest_seen_scene_id string, confidence double")
    w = spark.createDataFrame([("w1", "v", "s2", "会长罗伦斯看着咱"), ("w2", "u", "s2", "罗伦斯")], "window_id string, volume_id string, scene_id string, text string")
    assert [(r.window_id, r.entity_id, r.score) for r in C.score_characters(w, cards).collect()] == [("w1", "c1", 11.55)]
    got = {r.entity_id: (r.names, r.markers) for r in C.speaker_options(cards).collect()}
    assert got["c2"] == (["赫萝"], ["咱"])


def test_notes(spark):
    now = datetime.datetime(2024, 1, 10)
    notes = spark.createDataFrame([("episodic", "a.md", now, "x\n钥匙\ny\nz\nw"), ("semantic", "b.md", now, None)], "type string, name string, mtime timestamp, content string")
    assert [(r.line_no, r.hit) for r in M.search(notes, "钥匙").orderBy("line_no").collect()] == [(1, False), (2, True), (3, False), (4, False)]
    up = M.categorize(notes, spark.createDataFrame([("episodic", "a.md", now, "more"), ("semantic", "c.md", now, "new")], notes.schema))
    assert {r.name: r.content for r in up.collect()}["a.md"].endswith("# Merged\n\nmore") and up.count() == 3
    assert M.usage(notes.limit(0)).first().status == "safe" and M.snapshot(notes, now).count() == 2


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("　甲\t乙 ",)], "t string")
    assert [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()] == ["", "", "甲 乙"]
    assert spark.range(1).select(X.join_field(F.lit("a / b"), F.lit("c"), 2)).first()[0] == "b / c"
    assert spark.range(1).select(X.is_related(F.lit("克拉福·罗伦斯"), F.lit("罗伦斯"))).first()[0]


@pytest.fixture
def endpoint():
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            out = [{"error": "busy"}] if body["prompt"] == "bad" else [{"response": "甲"}, {"response": body["prompt"], "done": True}]
            self.wfile.write("".join(json.dumps(x) + "\n" for x in out).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_endpoint_and_files(spark, endpoint, tmp_path):
    asked = spark.createDataFrame([("r1", "m", "乙"), ("r2", "m", "bad")], "request_id string, model string, prompt string")
    got = {r.request_id: (r.raw, r.error) for r in files.generate(asked, endpoint, 5).collect()}
    assert got["r1"] == ("甲乙", None) and "busy" in got["r2"][1]
    files.write_jsonl(asked, f"{tmp_path}/x", ["request_id"], single=True)
    assert files.read_jsonl(spark, f"{tmp_path}/x", asked.schema).count() == 2 and files.read_optional(spark, f"{tmp_path}/none", asked.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_required(spark, f"{tmp_path}/none", asked.schema)
    (tmp_path / "bad.json").write_text('{"request_id": "a"}\n{oops\n')
    assert [r.line for r in files.bad_lines(spark, f"{tmp_path}/bad.json", "request_id string").collect()] == ["{oops"]
    (tmp_path / "novel01.txt").write_text("﻿序幕\r\n「走吧」")
    assert files.find_volume(spark, str(tmp_path), 1).endswith("novel01.txt") and files.read_volumes(spark, f"{tmp_path}/novel01.txt").first().text.startswith("序幕")


def test_pipeline(spark):
    text = "目录\n序幕\n罗伦走进村落。\n「我叫罗伦。」\n「你好啊。」\n赫萝笑着说道。\n第1章\n夜里，赫萝说「走吧」就跑了。\n「嗯。」"
    t = pipeline.preprocess(spark.createDataFrame([("volume_01", text)], "volume_id string, text string"), 1, 20)
    d = t["dialogues"].orderBy("dialogue_index").collect()
    assert [(r.dialogue_id, r.text, r.dialogue_kind) for r in d] == [("volume_01-d000001", "我叫罗伦。", "standalone"), ("volume_01-d000002", "你好啊。", "standalone"), ("volume_01-d000003", "走吧", "inline"), ("volume_01-d000004", "嗯。", "standalone")]
    assert d[1].prev_context[0].text == "「我叫罗伦。」" and d[2].chapter_title == "第1章"
    cards = spark.createDataFrame([("c1", "volume_01", "罗伦", [], [], [], None, None, 0.5), ("c2", "volume_01", "赫萝", [], [], [], None, None, 0.5)], "entity_id string, volume_id string, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, first_seen_scene_id string, latest_seen_scene_id string, confidence double")
    models = spark.createDataFrame([("m", 1.0)], "model string, weight double")
    asked = pipeline.requests(t["dialogues"], cards, models)[0].collect()
    first = min(r.request_id for r in asked)
    answers = spark.createDataFrame([(first, '{"annotations": [{"dialogue_id": "volume_01-d000002", "speaker_entity_id": "c2", "speaker_display": "赫萝", "speaker_status": "known", "confidence": 0.9}]}', 0)], "request_id string, raw string, pos int")
    out = pipeline.annotate(t["dialogues"], t["paragraphs"], cards, models, answers)
    said = {r.dialogue_id: (r.speaker_display, r.needs_review) for r in out["annotations"].collect()}
    assert said["volume_01-d000001"] == ("罗伦", False) and said["volume_01-d000002"] == ("赫萝", False) and said["volume_01-d000003"][1]
    labeled = {r.text for r in out["labeled"].collect()}
    assert "【罗伦】「我叫罗伦。」" in labeled and out["failures"].count() == len(asked) - 1
    raw = '{"characters": [{"display_name": "罗伦", "aliases": ["商人"]}, {"name": "赫萝"}]}'
    assert pipeline.discover(spark.createDataFrame([("s-r001", "v", 1, raw), ("s-r002", "v", 2, "x")], "request_id string, volume_id string, seq int, raw string")).count() == 2


def _variants(spark, *rows):
    return spark.createDataFrame(rows, "request_id string, pos int, raw string").withColumn("r", F.try_parse_json("raw"))


def test_reader_answers(spark):
    from voxloom.operators import reader

    got = reader.annotations(_variants(spark, ("q", 0, '{"dialogue_id": "d1", "status": "NPC", "display_name": "村民们", "confidence": 2}'), ("q", 1, '{"dialogue_id": "zz"}')), spark.createDataFrame([("q", "d1"), ("q", "d2")], "request_id string, dialogue_id string"))
    assert {(r.dialogue_id, r.speaker_entity_id, r.speaker_status, r.confidence, r.needs_review) for r in got.collect()} == {("d1", "npc_group:村民们", "npc_group", 1.0, False), ("d2", "unknown", "unknown", 0.0, True)}
    c = reader.contradictions(_variants(spark, ("q", 0, '{"dialogue_id": "d1", "has_contradiction": true, "severity": "huge", "reason": "x"}'), ("q", 1, '{"dialogue_id": "d2", "severity": "weak", "needs_review": true}')))
    assert {(r.dialogue_id, r.severity, r.needs_review) for r in c.collect()} == {("d1", "strong", True), ("d2", "weak", False)}
    e = reader.evidence(_variants(spark, ("q", 0, '{"dialogue_id": "d1", "speech_markers": ["咱", {"marker": "喵", "owner_display": "猫"}], "positive_evidence": "一句"}'))).first()
    assert [(m.marker, m.owner_display) for m in e.speech_markers] == [("咱", ""), ("喵", "猫")]
    before = spark.createDataFrame([("d1", "a", False), ("d2", "a", False)], "dialogue_id string, speaker_entity_id string, needs_review boolean")
    trace = reader.repair_trace(before, before.where("dialogue_id = 'd9'"), c).collect()
    assert [(t.dialogue_id, t.stop_reason, t.trigger_reason) for t in trace] == [("d1", "missing_response", "x")]
    fixed = reader.repairs(_variants(spark, ("q", 0, '{"dialogue_id": "d1", "new_speaker_entity_id": "b"}'), ("q", 1, '{"dialogue_id": "d8"}')), before)
    assert [(r.dialogue_id, r.stop_reason, r.speaker_entity_id) for r in fixed.collect()] == [("d1", "unchanged", "b")]
    said = spark.createDataFrame([("v", 1, '{"summary": "一", "new_facts": ["甲", "甲"]}'), ("v", 2, '{"summary": "二", "retained_facts": ["乙"], "keep_pending": ["m1"], "expire_pending": [{"entity_id": "m0"}]}')], "volume_id string, chunk int, raw string").withColumn("v", F.try_parse_json("raw"))
    last, rows = reader.facts(said)
    assert last.first().summary == "二" and {(r.fact_type, r.text) for r in rows.collect()} == {("new_facts", "甲"), ("retained_facts", "乙")}
    pending = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "entity_id string")
    done = reader.resolutions(said, pending, spark.createDataFrame([("m0", "m2")], "node string, resolved string"))
    assert {(r.entity_id, r.last_checked, r.expired, r.reason) for r in done.collect()} == {("m1", 2, False, None), ("m2", None, True, "expired_by_model"), ("m3", None, False, None)}
    assert reader.chunk_summaries(said.select(F.lit("c").alias("chunk_id"), "v")).count() == 2 and reader.events(pending, last).count() == 4


def test_pending_stream(spark, tmp_path):
    from voxloom.streaming.streams import pending_events

    schema = "volume_id string, entity_id string, name string, chunk int"
    spark.createDataFrame([("v", "m1", "谜", 1), ("v", "m1", "谜", 5), ("v", "m1", "谜", 14), ("v", "m2", "影", 3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = pending_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("pending").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert {(r.entity_id, r.event, r.chunk) for r in spark.table("pending").collect()} == {("m1", "added", 1), ("m1", "expired", 14), ("m2", "added", 3)}


def test_mysteries(spark):
    rows = spark.createDataFrame([("w1", "v", "s1", "黑衣人走近", ["d1"]), ("w2", "v", "s2", "黑衣人不见了", ["d9"])], "window_id string, volume_id string, scene_id string, text string, ids array<string>")
    m = spark.createDataFrame([("m1", "v", "黑衣人", "s1-r002", ["d7"], 0.5), ("m2", "v", "歌声", "s8", ["d1"], None), ("m3", "v", "商人", "s1", ["d1"], 0.9), ("m4", "v", None, "s1", None, 0.9)], "mystery_id string, volume_id string, name string, scene_id string, evidence array<string>, confidence double")
    got = {(r.window_id, r["rank"], r.mystery_id, r.score) for r in C.score_mysteries(rows, m).collect()}
    assert got == {("w1", 0, "m2", 8.05), ("w1", 1, "m1", 6.05)}


def test_memories_of_all_dialogues(spark):
    from voxloom.operators import reader

    w = spark.createDataFrame([("w", "s", 3, 12), ("w", "s", 4, 12), ("x", "s", 11, 12), ("y", "t", 9, 10), ("z", "u", 0, None)], "window_id string, scene_id string, offset int, length int")
    m = spark.createDataFrame([("s", "m1", 1), ("s", "m2", 2), ("s", "m3", 3), ("t", "n1", 1), ("t", "n2", 2), ("u", "o1", 1), ("u", "o2", 2)], "scene_id string, memory_id string, chunk int")
    pick = lambda *a: sorted((r.window_id, r.memory_id) for r in reader.memories(w, *a).collect())
    assert pick(m, 0, 6) == [("w", "m1"), ("w", "m2"), ("x", "m3"), ("y", "n2"), ("z", "o1"), ("z", "o2")]
    assert pick(m, 1, 2) == [("w", "m1"), ("w", "m2"), ("x", "m2"), ("x", "m3"), ("y", "n1"), ("y", "n2"), ("z", "o1"), ("z", "o2")]
    # nothing within the radius: the first ones
    assert pick(m.where("scene_id = 't' and chunk = 1").withColumn("chunks", F.lit(4)), 0, 6) == [("y", "n1")]


def test_volumes_from_a_hundred_on(spark, tmp_path):
    from voxloom.__main__ import main

    (tmp_path / "in").mkdir()
    for n in ("1", "12", "120", "123"):
        (tmp_path / "in" / f"novel{n}.txt").write_text("序幕\n「走吧」", encoding="utf-8")
    assert main(["preprocess", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out"]) == 0
    got = spark.read.parquet(f"{tmp_path}/out/dialogues").select("volume_id", "dialogue_id").collect()
    assert sorted(map(tuple, got)) == [(v, f"{v}-d000001") for v in ("volume_01", "volume_12", "volume_120", "volume_123")]


def test_paragraph_cards_keep_360_characters(spark, tmp_path):
    from voxloom.plans.reader_queries import j_paragraph_cards

    spark.createDataFrame([("p1", "字" * 61), ("p2", "字" * 360), ("p3", "字" * 361)], "paragraph_id string, text string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    spark.createDataFrame([("d1", "p1")], "dialogue_id string, paragraph_id string").write.parquet(f"{tmp_path}/dialogues.parquet")
    got = {r.paragraph_id: (r.text, r.dialogue_ids) for r in j_paragraph_cards(spark, str(tmp_path)).collect()}
    assert got == {"p1": ("字" * 61, "d1"), "p2": ("字" * 360, ""), "p3": ("字" * 359 + "…", "")}


def test_prompts_hold_memories_mysteries_and_context(spark):
    import json

    text = "第1章\n罗伦走进村落。\n「我叫罗伦。」\n门外有人影。\n「你好啊。」"
    t = pipeline.preprocess(spark.createDataFrame([("volume_01", text)], "volume_id string, text string"), 1, 20)
    d = t["dialogues"].orderBy("dialogue_index").collect()
    cards = spark.createDataFrame([("c1", "volume_01", "罗伦", [], [], [], None, None, 0.5), ("c2", "volume_01", "赫萝", [], [], [], None, None, 0.5)], "entity_id string, volume_id string, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, first_seen_scene_id string, latest_seen_scene_id string, confidence double")
    models = spark.createDataFrame([("m", 1.0)], "model string, weight double")
    memories = spark.createDataFrame([(f"{d[0].scene_id}-r001", d[0].scene_id, 1, 1, "两人相遇", ["赫萝"], ["旅伴"], "夜")], "scene_id string, parent_scene_id string, chunk_index int, chunk_count int, scene_summary string, active_characters array<string>, relationships array<string>, notes string")
    mysteries = spark.createDataFrame([("m1", "volume_01", "黑衣人", d[0].scene_id, "门外的人", [d[1].dialogue_id], 0.5), ("m2", "volume_01", "别人", "elsewhere", "", ["none"], 0.5)], "mystery_id string, volume_id string, name string, scene_id string, description string, evidence array<string>, confidence double")
    asked, _, _, options = pipeline.requests(t["dialogues"], cards, models, t["paragraphs"], memories, mysteries)
    p = [json.loads(r.prompt.split("\n", 1)[1]) for r in asked.collect()]
    assert len(p) == 1 and [x["entity_id"] for x in p[0]["candidates"]] == ["c2", "c1"] and {r.entity_id for r in options.collect()} == {"c1", "c2"}
    assert [(x["scene_summary"], x["active_characters"]) for x in p[0]["scene_memory"]] == [("两人相遇", ["赫萝"])] and [x["mystery_id"] for x in p[0]["mysteries"]] == ["m1"]
    assert "门外有人影。" in [x["text"] for x in p[0]["paragraphs"]] and [x["target_dialogue_ids"] for x in p[0]["paragraphs"] if x["text"] == "「你好啊。」"] == [[d[1].dialogue_id]]


def test_merged_cards_keep_summaries_and_evidence(spark):
    schema = "entity_id string, entity_type string, display_name string, aliases array<string>, importance string, dialogue_count int, latest_seen_chunk_id string, summary string, evidence_refs array<string>"
    rows = [(i, t, i, [], "minor", 1, "v-r000001", s, e) for i, t, s, e in (("a", "mystery", "甲", ["e1"]), ("b", "npc_group", "乙" * 119, ["e2", "e1"]), ("c", "character", "丙 甲", ["e3"]), ("d", "character", " 丁 ", None), ("x", "character", None, ["e4"]))]
    m = spark.createDataFrame([("a", "b", 2), ("b", "c", 3), ("d", "c", 1)], "source string, target string, edge_id int")
    got = {r.entity_id: (r.merged, r.summary, r.evidence_refs) for r in E.merge_cards(spark.createDataFrame(rows, schema), resolve_aliases(m), m).collect()}
    assert got == {"c": (4, "丙 甲 丁 " + "乙" * 119 + "…", ["e3", "e2", "e1"]), "x": (1, "", ["e4"])}


def test_structured_window(spark):
    import json

    from voxloom.plans import structured

    text = "第1章\n罗伦走进村落。\n「我们走。」\n门外有人影。\n「你好啊。」\n「再见。」"
    t = pipeline.preprocess(spark.createDataFrame([("volume_01", text)], "volume_id string, text string"), 1, 20)
    d = [r.dialogue_id for r in t["dialogues"].orderBy("dialogue_index").collect()]
    window = f"{d[0]}_to_{d[2]}"
    card = "entity_id string, volume_id string, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, first_seen_scene_id string, latest_seen_scene_id string, confidence double"
    cards = spark.createDataFrame([("c1", "volume_01", "罗伦", [], [], [], None, None, 0.5), ("c2", "volume_01", "赫萝", [], [], [], None, None, 0.5)], card)
    models = spark.createDataFrame([(r, m, 1.0) for r in ("evidence", "judge", "contradiction") for m in ("m", "n") if r == "judge" or m == "m"], "role string, model string, weight double")
    vote = lambda i, who, name, c=0.9: {"dialogue_id": d[i], "speaker_entity_id": who, "speaker_display": name, "speaker_status": "known", "confidence": c}
    answers = {
        f"evidence--{window}--m": {"evidence": [{"dialogue_id": d[0], "positive_evidence": ["门外"]}, {"dialogue_id": d[0], "positive_evidence": ["人影", "人影"]}]},
        f"judge--{window}--m": {"annotations": [vote(0, "c1", "罗伦"), vote(1, "c1", "罗伦"), vote(2, "c1", "罗伦")]},
        f"judge--{window}--n": {"annotations": [vote(0, "c1", "罗伦"), vote(1, "c1", "罗伦"), vote(2, "c1", "罗伦")]},
        f"contradiction--{window}--m": {"checks": [{"dialogue_id": d[1], "severity": "strong", "reason": "称呼不符", "counter_evidence": ["你好"]}, {"dialogue_id": d[2], "has_contradiction": True}]},
    }
    repair = {f"repair--{window}--iter1--m": {"annotations": [vote(1, "c2", "赫萝"), vote(2, "c1", "罗伦")]}}
    run = lambda a: structured.annotate(t["dialogues"], t["paragraphs"], cards, models, spark.createDataFrame([(k, json.dumps(v), 0) for k, v in a.items()], "request_id string, raw string, pos int"))
    out = run(answers | repair)
    said = {r.dialogue_id: (r.speaker_entity_id, r.needs_review, r.review_reason) for r in out["annotations"].collect()}
    assert said == {d[0]: ("c1", False, ""), d[1]: ("c2", False, ""), d[2]: ("c1", True, "strong_contradiction:")}
    assert {(r.dialogue_id, r.initial, r.repaired, r.stop_reason) for r in out["repairs"].collect()} == {(d[1], "c1", "c2", "resolved"), (d[2], "c1", "c1", "unchanged")}
    assert {r.dialogue_id: r.positive_evidence for r in out["evidence"].collect()} == {d[0]: ["人影"], d[1]: [], d[2]: []}
    asked = {r.request_id: r.prompt for r in out["requests"].collect()}
    assert set(asked) == set(answers | repair) and "人影" in asked[f"judge--{window}--m"] and "judgements" in asked[f"contradiction--{window}--m"]
    assert "称呼不符" in asked[f"repair--{window}--iter1--m"] and out["failures"].count() == 0
    assert {(r.model, r.dialogue_id) for r in out["votes"].collect()} >= {("judge:m", d[0]), ("repair:m", d[1])}
    out = run({k: v for k, v in answers.items() if not k.startswith("evidence")})
    assert {r.stop_reason for r in out["repairs"].collect()} == {"repair_cache_missing"} and [r.role for r in out["failures"].collect()] == ["evidence"]
    assert {r.dialogue_id: r.review_reason for r in out["annotations"].collect()}[d[1]] == "strong_contradiction:称呼不符"
    out = run(answers | {f"repair--{window}--iter1--m": {"annotations": [{**vote(1, "c2", "赫萝"), "needs_review": True}]}})
    assert {(r.dialogue_id, r.stop_reason) for r in out["repairs"].collect()} == {(d[1], "needs_review"), (d[2], "missing_response")}


def test_a_marker_of_another_contradicts(spark):
    rows = line(spark, ("d1", 0, "咱饿了", [], ""), ("d2", 1, "走吧", [], ""))
    opts = option(spark, ("罗伦", [], []), ("赫萝", [], ["咱"]))
    votes = spark.createDataFrame([(i, m, 1.0, 0.9, "char_0", "罗伦", "known", False, 1, []) for i in ("d1", "d2") for m in ("m", "n")], "dialogue_id string, model string, weight double, confidence double, speaker_entity_id string, speaker_display string, speaker_status string, needs_review boolean, pos int, evidence array<string>")
    d = rows.select("dialogue_id", "text", F.col("kind").alias("dialogue_kind"), F.col("narration").alias("context"))
    got = {r.dialogue_id: (r.needs_review, r.review_reason) for r in V.aggregate_votes(d, votes, checked=True, markers=R.marker_owners(rows, opts)).collect()}
    assert got == {"d1": (True, "speaker_contradiction:speech_marker:赫萝"), "d2": (False, "")}


def test_second_reader(spark):
    import json

    from voxloom.plans import reading

    schema = "volume_id string, chapter_id string, chapter_index int, scene_id string, paragraph_index int, paragraph_id string, text string"
    p = spark.createDataFrame([("v", "v-c001", 1, f"v-s{i // 2:03d}", i, f"p{i}", f"「第{i}句」" * 3) for i in range(6)], schema)
    d = spark.createDataFrame([(f"d{i}", i, f"p{i}", f"第{i}句") for i in range(6)], "dialogue_id string, dialogue_index int, paragraph_id string, text string")
    known = lambda i, e, n: {"dialogue_id": f"d{i}", "speaker_status": "known", "speaker_entity_id": e, "speaker_display": n, "confidence": 0.9}
    answers = {
        "v-r000001--annotation--m": {"annotations": [{"dialogue_id": "d0", "speaker_status": "mystery", "speaker_entity_id": "v:mystery_v2_000001", "speaker_display": "黑影", "confidence": 0.8}]},
        "v-r000001--chunk_summary--m": {"summary": "黑影出现"},
        "v-r000001--entity_discovery--m": {"entities": [{"entity_type": "mystery", "display_name": "黑影", "importance": "major"}, {"entity_type": "character", "display_name": "赫萝", "importance": "medium"}]},
        "v-r000001--global_summary--m": {"summary": "开端", "new_facts": ["有黑影"]},
        "v-r000002--annotation--m": {"annotations": [known(2, "v:char_v2_000001", "赫萝"), {"dialogue_id": "d3", "speaker_status": "unknown"}]},
        "v-r000002--entity_discovery--m": {"entities": [{"entity_type": "mystery", "display_name": "老者", "importance": "medium"}]},
        "v-r000002--entity_update--m": {"updates": [{"entity_id": "v:char_v2_000001", "relationship_updates": ["与黑影相识"], "summary": "贤狼"}, {"entity_id": "nobody", "summary": "x"}]},
        "v-r000003--mystery_resolution--m": {"merges": [{"source_entity_id": "v:mystery_v2_000001", "target_entity_id": "v:char_v2_000001", "confidence": 0.95}], "expire_pending": [{"entity_id": "v:mystery_v2_000002"}]},
        "v-r000002--repair--m": {"repairs": [{"dialogue_id": "d3", "stop_reason": "resolved", **{k: x for k, x in known(3, "v:char_v2_000001", "赫萝").items() if k != "dialogue_id"}}]},
    }
    stored = spark.createDataFrame([(k, json.dumps(x), 0) for k, x in answers.items()], "request_id string, raw string, pos int")
    out = reading.annotate(p, d, stored, "m")
    got = {r.dialogue_id: (r.speaker_entity_id, r.speaker_status) for r in out["annotations"].collect()}
    assert got == {"d0": ("v:char_v2_000001", "known"), "d1": ("unknown", "unknown"), "d2": ("v:char_v2_000001", "known"), "d3": ("v:char_v2_000001", "known"), "d4": ("unknown", "unknown"), "d5": ("unknown", "unknown")}
    cards = {r.entity_id: r for r in out["entities"].collect()}
    assert set(cards) == {"v:char_v2_000001", "v:mystery_v2_000002"} and cards["v:char_v2_000001"].importance == "major" and cards["v:char_v2_000001"].relationships == ["与黑影相识"]
    events = [(r.chunk, r.entity_id, r.event, r.rank) for r in out["pending"].orderBy("chunk", "event", "rank").collect()]
    assert events == [
        (0, "v:mystery_v2_000001", "added", None), (0, "v:mystery_v2_000001", "pending", 0), (1, "v:mystery_v2_000002", "added", None), (1, "v:mystery_v2_000001", "pending", 0),
        (1, "v:mystery_v2_000002", "pending", 1), (2, "v:mystery_v2_000002", "expired", None), (2, "v:mystery_v2_000001", "merged", None),
    ]
    prompts = {r.request_id: r.prompt for r in out["prompts"].collect()}
    assert "黑影出现" in prompts["v-r000002--annotation--m"] and "开端" in prompts["v-r000003--annotation--m"] and "黑影出现" not in prompts["v-r000001--annotation--m"]
    assert out["failures"].where("error_type = 'CacheMiss'").count() == 21 - len(answers) and out["facts"].count() == 1
    assert {r.event_type for r in out["events"].collect()} >= {"entity_discovery", "entity_update", "entity_merge", "pending_mystery_added", "pending_mystery_expired"}
    assert reading.annotate(p, d, stored, "m", 1, 1)["annotations"].count() == 2


def test_pending_timeline_evicts_and_expires(spark):
    from voxloom.plans import reading

    signs = [("v", c, 0, "", "end", 0, None) for c in range(6)] + [("v", 0, 1, "a", "seen", 1, None), ("v", 0, 2, "b", "seen", 2, None), ("v", 0, 3, "c", "seen", 0, None), ("v", 1, 1, "d", "seen", 1, None), ("w", 3, 1, "a", "seen", 1, None), ("v", 4, 1, "b", "seen", 1, None)]
    rows = spark.createDataFrame(signs, "volume_id string, chunk int, pos int, entity_id string, sign string, level int, reason string")
    got = {(r.volume_id, r.chunk, r.entity_id, r.event) for r in reading.pending_timeline(rows, 2, 3).collect() if r.event != "pending"}
    assert got == {("v", 0, "a", "added"), ("v", 0, "b", "added"), ("v", 1, "d", "added"), ("v", 1, "a", "evicted"), ("v", 3, "b", "expired"), ("v", 4, "b", "added"), ("v", 4, "d", "expired"), ("w", 3, "a", "added")}
    assert reading.pending_timeline(rows.limit(0)).count() == 0


def test_discovery(spark):
    import json

    schema = "volume_id string, scene_id string, paragraph_index int, paragraph_id string, text string"
    p = spark.createDataFrame([("v", f"v-s{i:03d}", i, f"p{i}", f"「第{i}句」") for i in range(3)], schema)
    d = spark.createDataFrame([(f"d{i}", f"p{i}", f"第{i}句") for i in range(3)], "dialogue_id string, paragraph_id string, text string")
    said = {"characters": [{"display_name": "罗伦"}], "mysteries": [{"temporary_name": " 黑影 ", "evidence": [{"text": "有人影"}, "有人影", {"dialogue_id": "d0"}]}, {}], "scene_memory": {"scene_summary": "相遇", "active_characters": ["罗伦"]}}
    stored = spark.createDataFrame([("v-s000-r001--discovery--m", json.dumps(said), 0), ("v-s001-r001--discovery--m", "no", 0)], "request_id string, raw string, pos int")
    out = pipeline.discovery(p, d, stored, "m")
    assert {(r.name, tuple(r.evidence), r.confidence) for r in out["mysteries"].collect()} == {("黑影", ("有人影", "d0"), 0.5), ("mystery_unknown", (), 0.5)}
    assert [r.display_name for r in out["characters"].collect()] == ["罗伦"] and out["scene_memories"].first().scene_summary == "相遇"
    assert {(r.request_id, r.error_type) for r in out["failures"].collect()} == {("v-s001-r001--discovery--m", "JSONDecodeError"), ("v-s002-r001--discovery--m", "CacheMiss")}
    prompts = {r.request_id: r.prompt for r in out["requests"].collect()}
    assert "罗伦" in prompts["v-s001-r001--discovery--m"] and "罗伦" not in prompts["v-s000-r001--discovery--m"]


def test_upsert_takes_the_earliest_related_owner(spark):
    schema = "entity_id string, volume_id string, seq long, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, confidence double, first_seen_scene_id string"
    names = ["旅人罗伦斯", "商人罗伦斯", "罗伦斯", "斯", "狼神赫萝", "赫萝", "罗伦"]
    cards = spark.createDataFrame([(f"c{i}", "v", i, n, [], [], [], 0.5, None) for i, n in enumerate(names)], schema)
    got = {r.first_record: r.record_ids for r in E.upsert_characters(cards).collect()}
    assert got == {"c0": ["c0", "c2"], "c1": ["c1"], "c3": ["c3"], "c4": ["c4"], "c5": ["c5"], "c6": ["c6"]}


def test_store_state_and_structure(spark, tmp_path):
    import datetime as dt
    import json

    from voxloom.operators import store as M

    now = dt.datetime(2024, 5, 1)
    state = M.update_state(M.init_state(spark), spark.createDataFrame([("check", now), ("warning", now), ("warning", now)], "kind string, at timestamp_ntz"))
    assert tuple(state.first()) == (now, None, None, 2) and tuple(M.init_state(spark, state).first()) == tuple(state.first()) and M.init_state(spark, state.limit(0)).first().warnings == 0
    notes = M.init_notes(spark, spark.createDataFrame([("semantic", "README.md", now, "x"), ("inbox", "a.md", now, "see people/b.md#who and see c.md"), ("people", "b.md", dt.datetime(2023, 1, 1), "b")], "type string, name string, mtime timestamp_ntz, content string"), now)
    assert notes.count() == 5
    sorted_ = M.sort_inbox(notes, spark.createDataFrame([("a.md", "projects"), ("b.md", "x")], "name string, target string"))
    assert {(r.type, r.name) for r in sorted_.collect()} >= {("projects", "a.md"), ("people", "b.md")}
    assert {(r.target, r.anchor, r.found) for r in M.references(notes).collect()} == {("people/b.md", "who", True), ("c.md", None, False)}
    moved = {r.name: (r.type, r.reason) for r in M.archive(notes, dt.datetime(2024, 1, 1), now).collect() if r.reason}
    assert moved == {"b.md": ("archive/people", "old")} and M.health(notes).first().bytes == len("x# episodic# procedural")
    files_ = spark.createDataFrame([(".", "INDEX.md"), ("people", "INDEX.md"), ("people", "b.md"), ("x", "a.md")], "category string, name string")
    assert {(r.category, r.files, r.has_index) for r in M.structure(files_).collect()} == {(".", 1, False), ("people", 2, True), ("x", 1, False)}
    assert M.structure(files_.limit(0)).count() == 1 and {r.category: r.too_long for r in M.index_sizes(spark.createDataFrame([(".",)] * 21 + [("x",)] * 21, "category string")).collect()} == {".": True, "x": False}
    files.write_json(spark, f"{tmp_path}/a/b.json", {"名": ["一"]})
    assert json.loads((tmp_path / "a" / "b.json").read_text(encoding="utf-8")) == {"名": ["一"]} and "名" in (tmp_path / "a" / "b.json").read_text(encoding="utf-8")
