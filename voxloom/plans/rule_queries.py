"""Queries and SQL of candidate retrieval and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import candidates as C
from voxloom.operators import rules as R
from voxloom.operators import windows as W
from voxloom.operators.votes import INDIRECT, VERBS
from voxloom.plans.sql import ONCE, any_of, clean, in_list, quoted
from voxloom.plans.window_queries import DIALOGUE, WINDOWS
from voxloom.plans.window_queries import SQL as WINDOW_SQL
from voxloom.sources.scratch import Scratch
from voxloom.sources.tables import once, table

CARD = ["volume_id", "display_name", "aliases", "titles", "speech_markers", "first_seen_scene_id", "latest_seen_scene_id", "confidence"]


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "character_cards"), ["entity_id"], CARD)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "dialogues"), ["dialogue_id"], [*DIALOGUE, "text", "paragraph_text", "char_start", "char_end", "prev_context", "next_context"])
    return W.dialogue_windows(t)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    return C.score_characters(R.lines(w).join(w.select("dialogue_id", "scene_id"), "dialogue_id").select("window_id", "volume_id", "scene_id", F.col("context").alias("text")), _cards(spark, d))


_BARE = "length({0}) between 2 and 4 and not {0} rlike '[。！？…；：、「」『』 ]'"


def called_names(lines: DataFrame) -> DataFrame:
    """Options that the texts themselves give: a short part between two commas is a name that is called, the part before it the marker of who calls."""
    parts = lines.select("window_id", F.split("text", "，").alias("p")).where("size(p) > 2")
    each = parts.select("window_id", F.explode(F.expr("transform(sequence(1, size(p) - 2), i -> struct(p[i] as name, p[i - 1] as before))")).alias("x"))
    each = each.select("window_id", "x.name", "x.before").where(_BARE.format("name"))
    owned = each.groupBy("window_id", "name").agg(F.array_sort(F.collect_set(F.when(F.expr(_BARE.format("before")), F.col("before")))).alias("markers"))
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy("name")) + 100
    return owned.select("window_id", rank.alias("rank"), F.concat(F.lit("called:"), "name").alias("entity_id"), F.col("name").alias("display"), F.array("name").alias("names"), "markers")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, options and segments. Options are the best characters of a window and the names that its lines call; they are written once, as every rule reads them."""
    w = _windows(spark, d)
    scratch = Scratch(spark)
    lines = scratch.save(R.lines(w), "lines")
    text = lines.join(w.select("dialogue_id", "scene_id"), "dialogue_id").select("window_id", "volume_id", "scene_id", F.col("context").alias("text"))
    ranked = C.score_characters(text, _cards(spark, d))
    known = ranked.join(C.speaker_options(_cards(spark, d)), "entity_id").select("window_id", "rank", "entity_id", "display", "names", "markers")
    return lines, scratch.save(known.unionByName(called_names(lines)), "options"), W.alternation_segments(w)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("dialogue_id", "s.entity_id", "s.display", "s.status", "s.confidence")


def c_mentions(spark: SparkSession, d: str) -> DataFrame:
    w = R.lines(_windows(spark, d)).select(F.col("dialogue_id").alias("key"), "volume_id", F.col("text"))
    return C.mentions(w, C.character_names(_cards(spark, d))).select(F.col("key").alias("dialogue_id"), "entity_id", "what", "name")


def c_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("window_id", "rank", "entity_id", "score")


def c_options(spark: SparkSession, d: str) -> DataFrame:
    return C.speaker_options(_cards(spark, d)).select("entity_id", "display", F.array_join("names", "|").alias("names"), F.array_join("markers", "|").alias("markers"))


def c_mysteries(spark: SparkSession, d: str) -> DataFrame:
    """Names that the lines of a volume call, taken as its mysteries: the lines that call one are its evidence, the first one's scene is its own."""
    w = _windows(spark, d)
    rows = Scratch(spark).save(R.lines(w).join(w.select("dialogue_id", "scene_id"), "dialogue_id"), "rows")
    parts = rows.select("volume_id", "dialogue_id", "scene_id", F.split("text", "，").alias("p")).where("size(p) > 2")
    each = parts.select("volume_id", "dialogue_id", "scene_id", F.explode(F.expr("slice(p, 2, size(p) - 2)")).alias("name")).where(_BARE.format("name"))
    m = each.groupBy("volume_id", "name").agg(F.min(F.struct("dialogue_id", "scene_id"))["scene_id"].alias("scene_id"), F.collect_set("dialogue_id").alias("evidence"))
    m = m.select(F.concat_ws(":", F.lit("m"), "volume_id", "name").alias("mystery_id"), "volume_id", "name", "scene_id", "evidence", F.lit(0.5).alias("confidence"))
    m = Scratch(spark).save(m, "mysteries")
    return C.score_mysteries(rows.select("window_id", "volume_id", "scene_id", F.col("context").alias("text"), F.array("dialogue_id").alias("ids")), m)


def r_self_intro(spark: SparkSession, d: str) -> DataFrame:
    """No line of the tables introduces its speaker, so here every line does: 我是 stands after its first comma."""
    rows, options, _ = _tables(spark, d)
    rows = rows.withColumn("text", F.expr("overlay(text placing '，我是' from instr(text, '，') for 1)")).where("contains(text, '我是')")
    return _flat(R.self_introductions(rows, options))


def r_marker(spark: SparkSession, d: str) -> DataFrame:
    rows, options, _ = _tables(spark, d)
    return _flat(R.by_marker(rows, options))


def r_attribution(spark: SparkSession, d: str) -> DataFrame:
    rows, options, _ = _tables(spark, d)
    return _flat(R.by_attribution(rows, options))


def r_addressed(spark: SparkSession, d: str) -> DataFrame:
    rows, options, _ = _tables(spark, d)
    return R.addressed(rows, options).select("dialogue_id", "entity_id", "order.rank", "order.name_pos")


def r_counterpart(spark: SparkSession, d: str) -> DataFrame:
    rows, options, _ = _tables(spark, d)
    return _flat(R.counterparts(rows, options, R.addressed(rows, options), "addressed"))


def r_listener(spark: SparkSession, d: str) -> DataFrame:
    """No narration of the tables reacts to a question, so here all of it does: 被问 stands before the text after a line."""
    rows, options, _ = _tables(spark, d)
    return _flat(R.counterparts(rows, options, R.asked(rows.withColumn("after", F.concat(F.lit("被问的"), "after")), options), "listener"))


def r_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows, options, _ = _tables(spark, d)
    return R.anchors(rows, options).select("dialogue_id", "s.entity_id", "s.display", "s.status", "s.confidence", "s.rule")


def r_votes(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_votes(*_tables(spark, d))


_CARDS = ONCE("character_cards", "entity_id, " + ", ".join(CARD))
_DTEXT = ONCE("dialogues", "dialogue_id, text, paragraph_text, char_start, char_end, prev_context, next_context")
_OUT = clean("left(paragraph_text, greatest(char_start, 0)) || substring(paragraph_text, greatest(char_end, char_start, 0) + 1)")
_LIST = lambda c: f"array_to_string(list_filter(list_transform(coalesce({c}, []), lambda x: {clean('x.text')}), lambda x: x <> ''), chr(10))"
_NEXT = f"list_filter(list_transform(coalesce(next_context, []), lambda x: {clean('x.text')}), lambda x: x <> '')"
_QUOTE = f"list_position(list_transform({_NEXT}, lambda x: contains(x, '「') OR contains(x, '」')), true)"
_LINES = f"""tx AS (SELECT dialogue_id, {clean("text")} AS said, {_OUT} AS outside, {_NEXT} AS nxt, coalesce({_QUOTE}, 0) AS quote_at, concat_ws(chr(10), {clean("text")}, {clean("paragraph_text")}, {_OUT}, {_LIST("prev_context")}, {_LIST("next_context")}) AS context FROM {_DTEXT}),
        ln AS (SELECT win.dialogue_id, window_id, volume_id, scene_id, coalesce(dialogue_kind, 'standalone') AS kind, said, context, array_to_string(nxt[1:2], chr(10)) AS after,
          list_filter(list_concat([outside], nxt[1:CASE WHEN quote_at > 0 THEN least(quote_at - 1, 2) ELSE 2 END]), lambda x: x <> '') AS narration FROM win JOIN tx USING (dialogue_id))"""
_UNIQUE = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
_CLEANED = lambda c: f"list_filter(list_transform({c}, lambda x: {clean('x')}), lambda x: x <> '')"
_NAMES = f"""cd AS (SELECT *, {clean("display_name")} AS dn, {_CLEANED("coalesce(aliases, [])")} AS al, {_CLEANED("coalesce(titles, [])")} AS ti, {_CLEANED("coalesce(speech_markers, [])")} AS sm FROM {_CARDS}),
        nm AS (SELECT volume_id, entity_id, 'name' AS what, dn AS name FROM cd UNION SELECT volume_id, entity_id, 'alias', unnest(al) FROM cd UNION SELECT * FROM (SELECT volume_id, entity_id, 'title', unnest(ti) AS name FROM cd) WHERE name NOT IN {in_list(X.LOW_SIGNAL_TITLES)}),
        nu AS (SELECT * FROM nm WHERE length(name) > 1 AND name NOT IN {in_list(X.LOW_SIGNAL_NAMES)})"""
_SCORED = f"""hit AS (SELECT DISTINCT window_id, entity_id, what, name FROM ln JOIN nu USING (volume_id) WHERE contains(context, name)),
        pt AS (SELECT window_id, entity_id, sum(CASE what WHEN 'name' THEN 8.0 WHEN 'alias' THEN 6.0 ELSE 2.0 END) AS p FROM hit GROUP BY ALL UNION ALL SELECT DISTINCT window_id, entity_id, 1.0 FROM ln JOIN cd ON ln.volume_id = cd.volume_id AND ln.scene_id = first_seen_scene_id
          UNION ALL SELECT DISTINCT window_id, entity_id, 1.5 FROM ln JOIN cd ON ln.volume_id = cd.volume_id AND ln.scene_id = latest_seen_scene_id),
        sc AS (SELECT window_id, entity_id, round(sum(p) + any_value(coalesce(confidence, 0.5)) * 0.1, 9) AS score FROM pt JOIN cd USING (entity_id) GROUP BY ALL),
        rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_id ORDER BY score DESC, entity_id) - 1 AS INTEGER) AS rank FROM sc WHERE score > 0.5 QUALIFY rank < 12)"""
_OPTIONS = f"""op AS (SELECT entity_id, dn AS display, list_filter({_UNIQUE("list_concat([dn], al)")}[1:10], lambda x: length(x) > 1 AND x NOT IN {in_list(X.LOW_SIGNAL_NAMES)}) AS usable,
          {_UNIQUE(f"list_concat(sm, list_filter(list_concat(al, ti), lambda y: y IN {in_list(X.SELF_PRONOUNS)}))")} AS mk FROM cd WHERE dn <> ''),
        os AS (SELECT entity_id, display, CASE WHEN len(usable) > 0 THEN usable ELSE [display] END AS names, list_filter(mk, lambda x: x IN {in_list(X.SELF_PRONOUNS)} OR (length(x) BETWEEN 2 AND 4 AND x NOT IN {in_list(X.LOW_SIGNAL_MARKERS)}
          AND NOT regexp_matches(x, '[。！？!?；;：:，、,.…「」『』“”"'']') AND regexp_matches(x, '[A-Za-z0-9一-鿿]')))[1:12] AS markers FROM op)"""
_OK = lambda c: f"length({c}) BETWEEN 2 AND 4 AND NOT regexp_matches({c}, '[。！？…；：、「」『』 ]')"
_CALLS = f"""cs AS (SELECT window_id, sg[i] AS name, sg[i - 1] AS before FROM (SELECT window_id, sg, unnest(range(2, len(sg))) AS i FROM (SELECT window_id, string_split(said, '，') AS sg FROM ln))),
        cl AS (SELECT window_id, name, coalesce(list_sort(list(DISTINCT before) FILTER ({_OK("before")})), []) AS markers FROM cs WHERE {_OK("name")} GROUP BY ALL)"""
_ALL = f"""WITH {WINDOWS}, {_LINES}, {_NAMES}, {_SCORED}, {_OPTIONS}, {_CALLS},
        wo AS (SELECT window_id, rank, os.* FROM rk JOIN os USING (entity_id) UNION ALL SELECT window_id, CAST(100 + row_number() OVER (PARTITION BY window_id ORDER BY name) AS INTEGER), 'called:' || name, name, [name], markers FROM cl),
        wn AS (SELECT *, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS name_pos FROM wo)"""
_PICK = "entity_id, display, 'known' AS status"
_BOTH = "FROM ln JOIN wn USING (window_id) WHERE kind = 'standalone'"
_INTRODUCED = lambda said: f"SELECT dialogue_id, {_PICK}, CAST(0.98 AS DOUBLE) AS confidence {_BOTH} AND contains({said}, name) AND regexp_matches(left({said}, instr({said}, name) + length(name) - 1), '我是|我叫|在下是|本人是|我的名字是') QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY rank, name_pos) = 1"
_MARKED = """mo AS (SELECT window_id, marker, any_value(entity_id) AS entity_id, any_value(display) AS display FROM (SELECT window_id, entity_id, display, unnest(markers) AS marker FROM wo) GROUP BY ALL HAVING count(DISTINCT entity_id) = 1),
        hm AS (SELECT DISTINCT dialogue_id, entity_id, display FROM ln JOIN mo USING (window_id) WHERE kind = 'standalone' AND contains(CASE WHEN length(marker) = 1 THEN replace(said, marker || '们', '') ELSE said END, marker))"""
_MARKER = f"SELECT dialogue_id, {_PICK}, CAST(0.86 AS DOUBLE) AS confidence FROM hm QUALIFY count(*) OVER (PARTITION BY dialogue_id) = 1"
_CALLED = f"ad AS (SELECT dialogue_id, entity_id, rank, CAST(name_pos AS INTEGER) AS name_pos {_BOTH} AND contains(said, name) AND regexp_matches(said, '\\Q' || name || '\\E(?:(?:{R.ADDRESS})|[，、。！？!\\s]*[你您])'))"
#: Every verb within 30 characters after an occurrence of a name; the farthest one of a kind decides, the first occurrence with a hit counts.
_TOLD = f"""nr AS (SELECT dialogue_id, ctx, said, entity_id, display, rank, name FROM (SELECT dialogue_id, window_id, unnest(narration) AS said, generate_subscripts(narration, 1) AS ctx FROM ln WHERE kind = 'standalone') JOIN wn USING (window_id) WHERE contains(said, name)),
        vb(verb) AS (VALUES {", ".join(f"({quoted(v)})" for v in (*VERBS, "念着", "打招呼"))}),
        oc AS (SELECT *, unnest(range(1, length(said) + 1)) AS occ FROM nr JOIN vb ON contains(said, verb)),
        fr AS (SELECT *, unnest(range(0, 31)) AS k FROM oc WHERE substring(said, occ, length(name)) = name),
        ve AS (SELECT *, occ + length(name) + k AS v FROM fr WHERE substring(said, occ + length(name) + k, length(verb)) = verb AND NOT contains(substring(said, occ + length(name), k), chr(10))),
        la AS (SELECT * FROM ve QUALIFY row_number() OVER (PARTITION BY dialogue_id, ctx, entity_id, name, verb, occ ORDER BY k DESC) = 1),
        ok AS (SELECT * FROM la WHERE substring(said, v - 1, 1) NOT IN ('被', '询') AND (verb NOT IN ('说', '问') OR NOT regexp_matches(substring(said, v + length(verb)), '^(?:{"|".join(INDIRECT)})'))
          QUALIFY row_number() OVER (PARTITION BY dialogue_id, ctx, entity_id, name, verb ORDER BY occ) = 1)"""
_ATTRIBUTED = f"SELECT dialogue_id, {_PICK}, CAST(0.98 AS DOUBLE) AS confidence FROM ok QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY ctx, instr(said, substring(said, occ, v + length(verb) - occ)), instr(said, substring(said, occ, v + length(verb) - occ)) + v + length(verb) - occ, -length(name), rank) = 1"
_HERE = "hs AS (SELECT dialogue_id, entity_id, display, bool_or(contains(context, name) AND length(name) > 1) AS here FROM ln JOIN wn USING (window_id) GROUP BY ALL)"


def _opposite(named: str) -> str:
    """The counterpart of `dialogue_id, entity_id, o` (order)."""
    other = "h.entity_id <> a.entity_id"
    return f"""SELECT dialogue_id, w.entity_id, w.display, w.status, CAST(0.98 AS DOUBLE) AS confidence FROM (SELECT dialogue_id, o, CASE
          WHEN count(*) FILTER ({other} AND here) = 1 THEN struct_pack(entity_id := any_value(h.entity_id) FILTER ({other} AND here), display := any_value(h.display) FILTER ({other} AND here), status := 'known')
          WHEN count(*) FILTER ({other}) = 1 THEN struct_pack(entity_id := any_value(h.entity_id) FILTER ({other}), display := any_value(h.display) FILTER ({other}), status := 'known')
          WHEN {any_of("any_value(context)", R.VILLAGE)} THEN struct_pack(entity_id := 'npc:{R.VILLAGER}', display := '{R.VILLAGER}', status := 'npc') END AS w
          FROM {named} a JOIN hs h USING (dialogue_id) JOIN ln USING (dialogue_id) GROUP BY dialogue_id, o) WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY o) = 1"""


_ADDRESSED = _opposite("(SELECT dialogue_id, entity_id, [rank, name_pos] AS o FROM ad)")


def _asked(after: str) -> str:
    spots = "[" + ", ".join(f"instr({after}, '{m}')" for m in R.REACTIONS) + "]"
    cost = f"list_min(list_transform(list_filter({spots}, lambda p: p > 0), lambda p: abs(p - instr({after}, name)) + CASE WHEN instr({after}, name) > p THEN 20 ELSE 0 END))"
    return f"(SELECT dialogue_id, entity_id, 0 AS o {_BOTH} AND (contains(said, '？') OR contains(said, '?')) AND {any_of(after, R.REACTIONS)} AND contains({after}, name) QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY {cost}, -length(name), rank) = 1)"


SQL = {
    "c_mentions": f"WITH {WINDOWS}, {_LINES}, {_NAMES} SELECT dialogue_id, entity_id, what, name FROM ln JOIN nu USING (volume_id) WHERE contains(said, name)",
    "c_candidates": f"WITH {WINDOWS}, {_LINES}, {_NAMES}, {_SCORED} SELECT window_id, rank, entity_id, score FROM rk",
    "c_options": f"WITH {_NAMES}, {_OPTIONS} SELECT entity_id, display, array_to_string(names, '|') AS names, array_to_string(markers, '|') AS markers FROM os",
    "c_mysteries": f"""WITH {WINDOWS}, {_LINES}, md AS (SELECT volume_id, dialogue_id, scene_id, sg[i] AS name FROM (SELECT volume_id, dialogue_id, scene_id, sg, unnest(range(2, len(sg))) AS i FROM (SELECT *, string_split(said, '，') AS sg FROM ln))),
        ok AS (SELECT * FROM md WHERE {_OK("name")} AND name NOT IN {in_list(X.LOW_SIGNAL_TITLES)}),
        my AS (SELECT volume_id, name, 'm:' || volume_id || ':' || name AS mystery_id, regexp_replace(first(scene_id ORDER BY dialogue_id), '-r[0-9]+$', '') AS at_ FROM ok GROUP BY volume_id, name),
        hits AS (SELECT window_id, mystery_id, 'name' AS what FROM ln JOIN my USING (volume_id) WHERE contains(context, name) AND name NOT IN {in_list(X.LOW_SIGNAL_NAMES)} UNION SELECT window_id, 'm:' || ok.volume_id || ':' || name, 'evidence' FROM ok JOIN ln USING (dialogue_id)),
        h AS (SELECT window_id, mystery_id, bool_or(what = 'name') AS n, bool_or(what = 'evidence') AS e FROM hits GROUP BY ALL), z AS (SELECT window_id, min(scene_id) AS here FROM ln GROUP BY 1),
        sc AS (SELECT window_id, mystery_id, e, coalesce(here = at_, false) AS same, round(0.05 + CASE WHEN coalesce(here = at_, false) THEN 2.0 ELSE 0.0 END + CASE WHEN e THEN 8.0 ELSE 0.0 END + CASE WHEN n THEN 4.0 ELSE 0.0 END, 9) AS score FROM h JOIN z USING (window_id) JOIN my USING (mystery_id))
        SELECT window_id, CAST(row_number() OVER (PARTITION BY window_id ORDER BY score DESC, mystery_id) - 1 AS INTEGER) AS rank, mystery_id, CAST(score AS DOUBLE) AS score FROM sc WHERE e OR same QUALIFY rank < 8""",
    "r_self_intro": f"{_ALL} " + _INTRODUCED("(CASE WHEN contains(said, '，') THEN left(said, instr(said, '，') - 1) || '，我是' || substring(said, instr(said, '，') + 1) ELSE '' END)"),
    "r_marker": f"{_ALL}, {_MARKED} {_MARKER}",
    "r_addressed": f"{_ALL}, {_CALLED} SELECT * FROM ad",
    "r_attribution": f"{_ALL}, {_TOLD} {_ATTRIBUTED}",
    "r_counterpart": f"{_ALL}, {_CALLED}, {_HERE} {_ADDRESSED}",
    "r_listener": f"{_ALL}, {_HERE} " + _opposite(_asked("('被问的' || after)")),
    "r_anchors": f"""{_ALL}, {_MARKED}, {_CALLED}, {_TOLD}, {_HERE}, wy AS (SELECT *, 0 AS way, 'self_intro' AS rule FROM ({_INTRODUCED("said")}) UNION ALL SELECT *, 1, 'marker' FROM ({_MARKER}) UNION ALL SELECT *, 2, 'attribution' FROM ({_ATTRIBUTED})
          UNION ALL SELECT *, 3, 'listener' FROM ({_opposite(_asked("after"))}) UNION ALL SELECT *, 4, 'addressed' FROM ({_ADDRESSED}))
        SELECT dialogue_id, entity_id, display, status, confidence, rule FROM wy QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY way) = 1""",
}
_TURNS = f"""sg AS ({WINDOW_SQL["w_segments"]}),
        se AS (SELECT sg.*, sg.window_id || '#' || segment AS id, context, a.entity_id AS ae, a.display AS ad_, a.status AS ast FROM sg JOIN ln USING (dialogue_id) LEFT JOIN ({SQL["r_anchors"]}) a USING (dialogue_id)),
        pr AS (SELECT id, window_id, count(*) AS size, count(ae) AS n, first(struct_pack(e := ae, d := ad_, s := ast) ORDER BY segment_pos) FILTER (ae IS NOT NULL) AS ref, min(segment_pos) FILTER (ae IS NOT NULL) AS ref_pos, count(DISTINCT ae) AS who, string_agg(context, chr(10) ORDER BY segment_pos) AS all_text FROM se GROUP BY ALL),
        pk AS (SELECT * FROM pr WHERE n > 0 AND who <= 2 AND (size <= 6 OR n >= 2)),
        nr AS (SELECT id, any_value(entity_id) AS e, any_value(display) AS d FROM (SELECT DISTINCT id, entity_id, display FROM pk JOIN wn USING (window_id) WHERE entity_id <> ref.e AND contains(all_text, name) AND length(name) > 1) GROUP BY id HAVING count(*) = 1),
        s2 AS (SELECT id, first(struct_pack(e := ae, d := ad_, s := ast) ORDER BY segment_pos) AS x FROM se JOIN pk USING (id) WHERE ae IS NOT NULL AND ae <> ref.e GROUP BY id),
        ot AS (SELECT pk.*, CASE WHEN x IS NOT NULL THEN x WHEN nr.e IS NOT NULL THEN struct_pack(e := nr.e, d := nr.d, s := 'known') WHEN {any_of("all_text", R.VILLAGE)} AND ref.e <> 'npc:{R.VILLAGER}' THEN struct_pack(e := 'npc:{R.VILLAGER}', d := '{R.VILLAGER}', s := 'npc') END AS other FROM pk LEFT JOIN nr USING (id) LEFT JOIN s2 USING (id)),
        du AS (SELECT se.*, CASE WHEN (segment_pos - ref_pos) % 2 = 0 THEN ref ELSE other END AS due FROM se JOIN ot USING (id) WHERE other IS NOT NULL),
        tu AS (SELECT * FROM (SELECT *, bool_and(coalesce(ae = due.e, true)) OVER (PARTITION BY id) AS steady FROM du) WHERE steady AND ae IS NULL)"""
SQL["r_votes"] = f"""{_ALL}, {_TURNS} SELECT dialogue_id, 'rule:context' AS model, CAST(1.0 AS DOUBLE) AS weight, e AS speaker_entity_id, d AS speaker_display, s AS speaker_status, confidence, rule
        FROM (SELECT dialogue_id, entity_id AS e, display AS d, status AS s, confidence, rule FROM ({SQL["r_anchors"]}) UNION ALL SELECT dialogue_id, due.e, due.d, due.s, CAST({R.BY_TURN} AS DOUBLE), 'turns' FROM tu)"""
