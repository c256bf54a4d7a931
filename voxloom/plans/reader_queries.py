"""Queries and SQL of the second reader's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import reader as R
from voxloom.operators import responses as J
from voxloom.operators import votes as V
from voxloom.operators import windows as W
from voxloom.plans import reading as G
from voxloom.plans import structured as S
from voxloom.plans.entity_queries import CARD
from voxloom.plans.sql import ONCE, clean
from voxloom.plans.vote_queries import SQL as VOTE_SQL
from voxloom.plans.vote_queries import dialogues_of, votes_of
from voxloom.plans.window_queries import DIALOGUE, WINDOWS, w_chunks
from voxloom.plans.window_queries import SQL as WINDOW_SQL
from voxloom.sources.tables import once, table


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "entity_cards"), ["entity_id"], [*CARD, "summary"])


def e_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Cards as answers that name an entity of their volume by type: what one entity per volume and type would gather."""
    c = _cards(spark, d)
    key = F.concat_ws(":", "volume_id", "entity_type")
    found = c.select("volume_id", key.alias("entity_id"), X.chunk_number(F.col("first_seen_chunk_id")).alias("chunk"), F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("int").alias("pos"), "entity_type", "display_name", "aliases", "importance", "summary", F.array("entity_id").alias("evidence"), F.col("dialogue_count").alias("delta"))
    r = R.entity_cards(found)
    return r.select("entity_id", "entity_type", "display_name", F.array_join("aliases", "|").alias("aliases"), F.array_join("evidence_refs", "|").alias("evidence_refs"), "importance", "summary", "dialogue_count", "first_seen_chunk", "latest_seen_chunk")


def e_ensure(spark: SparkSession, d: str) -> DataFrame:
    v = once(table(spark, d, "votes"), ["dialogue_id", "model"], ["speaker_entity_id", "speaker_display", "speaker_status", "pos"]).withColumn("chunk", F.coalesce("pos", F.lit(0)))
    return R.ensure_entities(_cards(spark, d), v)


def e_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return R.snapshot(_cards(spark, d).select("volume_id", "entity_id", "display_name"), 30)


def w_memories(spark: SparkSession, d: str) -> DataFrame:
    """Memory documents of a volume, as the memories of its one long scene, for every dialogue window."""
    w = W.dialogue_windows(once(table(spark, d, "dialogues"), ["dialogue_id"], DIALOGUE))
    size = w.groupBy("volume_id").agg(F.max("dialogue_index").alias("_max"))
    at = w.join(size, "volume_id").select("window_id", F.col("volume_id").alias("scene_id"), F.col("dialogue_index").alias("offset"), (F.col("_max") + 1).alias("length"))
    m = table(spark, d, "documents").where("doc_kind = 'memory' and volume_id is not null and doc_id is not null")
    m = m.select(F.col("volume_id").alias("scene_id"), F.col("doc_id").alias("memory_id")).withColumn("chunk", F.row_number().over(Window.partitionBy("scene_id").orderBy("memory_id")))
    return R.memories(at, m, 1, 2)


def j_paragraph_cards(spark: SparkSession, d: str) -> DataFrame:
    p = once(table(spark, d, "paragraphs"), ["paragraph_id"], ["text"])
    q = once(table(spark, d, "dialogues"), ["dialogue_id"], ["paragraph_id"])
    return R.paragraph_cards(p, q).withColumn("dialogue_ids", F.array_join("dialogue_ids", "|"))


def _answers(spark: SparkSession, d: str, item: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Votes written as the answers of a role, one object per vote under a key, and the dialogues they were asked for."""
    v = once(table(spark, d, "votes"), ["dialogue_id", "model"], ["speaker_display", "speaker_status", "confidence", "needs_review", "evidence"])
    request = F.concat_ws("--", F.lit(key), "dialogue_id", "model").alias("request_id")
    raw = F.to_json(F.struct(F.array(item).alias(key)))
    return v.select(request, J.parse_json(raw).alias("v")), v.select(request, "dialogue_id")


def j_evidence(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("dialogue_id", F.col("evidence").alias("positive_evidence"), F.array("speaker_display").alias("addressed_to"), F.col("speaker_status").alias("turn_relation"), F.col("needs_review").alias("same_speaker_allowed"))
    e = R.evidence(J.by_dialogue(*_answers(spark, d, item, "evidence"), ("evidence",)))
    return e.select("request_id", "dialogue_id", F.array_join("positive_evidence", "|").alias("positive_evidence"), F.array_join("addressed_to", "|").alias("addressed_to"), "turn_relation", "same_speaker_allowed")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("confidence") < 0.3, "strong").when(F.col("confidence") < 0.6, "weak").when(F.col("confidence") <= 1, "none")
    item = F.struct("dialogue_id", F.col("needs_review").alias("has_contradiction"), severity.alias("severity"), F.col("speaker_display").alias("reason"), F.col("evidence").alias("counter_evidence"))
    return R.contradictions(J.by_dialogue(*_answers(spark, d, item, "checks"), ("checks",)))


def j_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d).withColumn("counter", F.array_join("counter", "|"))


def j_missing(spark: SparkSession, d: str) -> DataFrame:
    """Each dialogue asked of a model that has answered for another one: the votes that fill the gap."""
    v = once(table(spark, d, "votes"), ["dialogue_id", "model"], ["pos"]).where("pos is not null")
    asked = v.select(F.concat_ws("--", "dialogue_id", "model").alias("request_id"), "model", "dialogue_id")
    parsed = asked.select("request_id", "model", J.parse_json(F.lit('{"annotations": [{"dialogue_id": "nobody"}]}')).alias("v"))
    found = J.votes(parsed, asked.select("request_id", "dialogue_id"), asked.select("model").distinct().withColumn("weight", F.lit(0.5)))
    return found.withColumn("evidence", F.array_join("evidence", "|"))


def v_checked(spark: SparkSession, d: str) -> DataFrame:
    """The aggregate of all votes after strong checks; those of models whose name begins with h count as resolved."""
    a = V.aggregate_votes(dialogues_of(spark, d), votes_of(spark, d))
    c = _checks(spark, d).withColumn("pos", F.dense_rank().over(Window.partitionBy("dialogue_id").orderBy("request_id"))).withColumn("resolved", F.contains("request_id", F.lit("--h")))
    return V.apply_checks(a, c).select("dialogue_id", "speaker_entity_id", "speaker_status", "needs_review", "review_reason")


def v_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Targeted repair of dialogues with a strong check: the vote with the last position is the repair, the first one what stood before."""
    v = once(table(spark, d, "votes"), ["dialogue_id", "model"], ["speaker_entity_id", "needs_review", "pos"]).where("speaker_entity_id is not null")
    order = F.struct("pos", "model")
    before = v.groupBy("dialogue_id").agg(F.min_by("speaker_entity_id", order).alias("speaker_entity_id"))
    after = v.groupBy("dialogue_id").agg(F.max_by("speaker_entity_id", order).alias("speaker_entity_id"), F.max_by(F.coalesce("needs_review", F.lit(False)), order).alias("needs_review"), F.count("*").alias("n")).where("n > 1")
    strong = _checks(spark, d).where("severity = 'strong'").groupBy("dialogue_id").agg(F.min("reason").alias("trigger_reason")).withColumn("request_id", F.concat(F.lit("repair--"), "dialogue_id")).withColumn("model", F.lit("m"))
    last = F.substring("dialogue_id", -1, 1)
    state = strong.where(last != "0").select("request_id", F.when(last == "1", "failed").otherwise("read").alias("state"))
    return S.repaired(strong, before, after, state).drop("model")


def e_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Pending mysteries of the entity cards along all chunks of their volume: added, expired, and added anew when seen again."""
    c = _cards(spark, d).select("volume_id", "entity_id", "entity_type", X.importance_level(F.col("importance")).alias("level"), X.chunk_number(F.col("first_seen_chunk_id")).alias("lo"), X.chunk_number(F.col("latest_seen_chunk_id")).alias("hi"))
    none = F.lit(None).cast("string").alias("reason")
    seen = c.where("entity_type = 'mystery'").select("volume_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("chunk"), F.lit(0).alias("pos"), "entity_id", F.lit("seen").alias("sign"), "level", none)
    ends = c.groupBy("volume_id").agg(F.max("hi").alias("hi")).select("volume_id", F.explode(F.sequence(F.lit(0), "hi")).alias("chunk"), F.lit(0).alias("pos"), F.lit("").alias("entity_id"), F.lit("end").alias("sign"), F.lit(0).alias("level"), none)
    return G.pending_timeline(seen.unionByName(ends), limit=0).select("volume_id", "chunk", "entity_id", "event")


def w_pick(spark: SparkSession, d: str) -> DataFrame:
    return W.select_chunks(w_chunks(spark, d), 2, 3).select("chunk_id", "paragraph_id")


def c_evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the evidence of every vote and of the line it is about, as text and as an object."""
    v = once(table(spark, d, "votes"), ["dialogue_id", "model"], ["evidence", "paragraph_id"])
    items = v.select("dialogue_id", "model", F.posexplode(F.coalesce("evidence", F.array().cast("array<string>"))).alias("pos", "e"), "paragraph_id")
    as_text, as_object = F.parse_json(F.to_json(F.array("e"))), F.parse_json(F.to_json(F.struct(F.lit(" ").alias("text"), "paragraph_id", "dialogue_id")))
    return items.select("dialogue_id", "model", "pos", X.evidence_id(F.try_variant_get(as_text, "$[0]", "variant")).alias("said"), X.evidence_id(as_object).alias("at"))


def v_weights(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "votes").where("model is not null").select("model").distinct().withColumn("role", F.explode(F.array(F.lit("judge"), F.lit("evidence"))))
    given = table(spark, d, "votes").where("model is not null").groupBy("model").agg(F.max("weight").alias("weight")).where("weight > 0.9").withColumn("role", F.when(F.col("weight") > 1.1, "judge"))
    return R.weights(models, given.select("role", "model", "weight"))


_C = ONCE("entity_cards", "entity_id, summary, " + ", ".join(CARD))
_CHUNK = "coalesce(try_cast(nullif(regexp_extract(first_seen_chunk_id, '-r([0-9]+)$', 1), '') AS INTEGER), 0)"
_V = "(SELECT DISTINCT dialogue_id, model, speaker_entity_id, speaker_display, speaker_status, confidence, needs_review, evidence, pos, paragraph_id FROM votes WHERE dialogue_id IS NOT NULL AND model IS NOT NULL)"
_LIST = lambda c, n, cut: f"(SELECT coalesce(array_to_string(list_transform(list_filter(u, lambda x, i: list_position(u, x) = i)[1:{n}], lambda x: CASE WHEN length(x) > {cut} THEN left(x, {cut - 1}) || '…' ELSE x END), '|'), '') FROM (SELECT list_filter(list_transform({c}, lambda x: {clean('x')}), lambda x: x <> '') AS u))"
_CHECKS = f"""ck AS (SELECT 'checks--' || dialogue_id || '--' || model AS request_id, dialogue_id, sev AS severity, sev IN ('weak', 'strong') AS has_contradiction, {clean("speaker_display")} AS reason, evidence, sev = 'strong' AS needs_review
          FROM (SELECT *, CASE WHEN confidence < 0.3 THEN 'strong' WHEN confidence < 0.6 THEN 'weak' WHEN confidence <= 1 THEN 'none' WHEN needs_review THEN 'strong' ELSE 'weak' END AS sev FROM {_V}))"""
SQL = {
    "j_evidence": f"""SELECT 'evidence--' || dialogue_id || '--' || model AS request_id, dialogue_id, {_LIST("evidence", 8, 180)} AS positive_evidence, {_LIST("[speaker_display]", 8, 120)} AS addressed_to, {clean("speaker_status")} AS turn_relation, coalesce(needs_review, false) AS same_speaker_allowed FROM {_V}""",
    "j_checks": f"WITH {_CHECKS} SELECT * EXCLUDE (evidence), {_LIST('evidence', 8, 1000000)} AS counter FROM ck",
    "j_missing": f"SELECT dialogue_id, model, CAST(0.5 AS DOUBLE) AS weight, 'review:待复核' AS speaker_entity_id, '待复核' AS speaker_display, 'review' AS speaker_status, CAST(0 AS DOUBLE) AS confidence, true AS needs_review, '' AS evidence FROM {_V} WHERE pos IS NOT NULL",
    "v_checked": f"""WITH a AS ({VOTE_SQL["v_aggregate"]}), {_CHECKS}, st AS (SELECT dialogue_id, list(reason ORDER BY request_id) FILTER (reason <> '') AS rs FROM ck WHERE severity = 'strong' AND NOT contains(request_id, '--h') GROUP BY 1)
        SELECT a.dialogue_id, speaker_entity_id, CASE WHEN st.dialogue_id IS NOT NULL THEN 'review' ELSE speaker_status END AS speaker_status, st.dialogue_id IS NOT NULL OR needs_review AS needs_review,
          CASE WHEN st.dialogue_id IS NOT NULL THEN 'strong_contradiction:' || coalesce(array_to_string(list_filter(rs, lambda x, i: list_position(rs, x) = i)[1:3], '; '), '') ELSE review_reason END AS review_reason FROM a LEFT JOIN st ON st.dialogue_id = a.dialogue_id""",
    "v_repairs": f"""WITH {_CHECKS}, v AS (SELECT * FROM {_V} WHERE speaker_entity_id IS NOT NULL), st AS (SELECT dialogue_id, min(reason) AS trigger_reason FROM ck WHERE severity = 'strong' GROUP BY 1),
        b AS (SELECT dialogue_id, first(speaker_entity_id ORDER BY pos, model) AS initial, last(speaker_entity_id ORDER BY pos, model) AS fixed, last(coalesce(needs_review, false) ORDER BY pos, model) AS rv, count(*) AS n FROM v GROUP BY 1),
        m AS (SELECT 'repair--' || dialogue_id AS request_id, dialogue_id, trigger_reason, initial, CASE WHEN n > 1 THEN fixed END AS repaired, CASE WHEN right(dialogue_id, 1) = '0' THEN 'repair_cache_missing' WHEN right(dialogue_id, 1) = '1' THEN 'request_failed' WHEN n < 2 THEN 'missing_response'
          WHEN rv THEN 'needs_review' WHEN fixed = initial THEN 'unchanged' ELSE 'resolved' END AS stop_reason FROM st JOIN b USING (dialogue_id))
        SELECT *, stop_reason = 'resolved' AS resolved FROM m""",
    "e_timeline": f"""WITH c AS (SELECT DISTINCT volume_id, entity_id, entity_type, importance, {_CHUNK} AS lo, {_CHUNK.replace("first_seen", "latest_seen")} AS hi FROM entity_cards), n AS (SELECT volume_id, max(hi) AS top FROM c GROUP BY 1),
        m AS (SELECT volume_id, entity_id, least(lo, hi) AS lo, greatest(lo, hi) AS hi, top FROM c JOIN n USING (volume_id) WHERE entity_type = 'mystery' AND importance IN ('medium', 'major'))
        SELECT volume_id, lo AS chunk, entity_id, 'added' AS event FROM m UNION ALL SELECT volume_id, lo + 12, entity_id, 'expired' FROM m WHERE lo + 12 <= top
        UNION ALL SELECT volume_id, hi, entity_id, 'added' FROM m WHERE hi > lo + 12 UNION ALL SELECT volume_id, hi + 12, entity_id, 'expired' FROM m WHERE hi > lo + 12 AND hi + 12 <= top""",
    "w_pick": f"""SELECT chunk_id, paragraph_id FROM ({WINDOW_SQL["w_chunks"]}) WHERE chunk_index BETWEEN 2 AND 4""",
    "c_evidence_ids": f"""SELECT dialogue_id, model, CAST(i - 1 AS INTEGER) AS pos, {clean("e")} AS said, coalesce(nullif({clean("paragraph_id")}, ''), dialogue_id) AS at FROM (SELECT dialogue_id, model, paragraph_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS i FROM {_V})""",
    "e_discovered": f"""WITH c AS (SELECT concat_ws(':', volume_id, entity_type) AS e, CASE entity_type WHEN 'known' THEN 'character' WHEN 'npc' THEN 'npc_group' ELSE entity_type END AS t, {_CHUNK} AS chunk, CAST(regexp_extract(entity_id, '([0-9]+)$', 1) AS INTEGER) AS pos, *, {clean("display_name")} AS dn, {clean("summary")} AS sm
          FROM {_C} WHERE entity_type IN ('known', 'character', 'npc', 'npc_group', 'mystery')),
        a AS (SELECT e, list(x ORDER BY chunk, pos, i) AS l FROM (SELECT e, chunk, pos, {clean("y")} AS x, i FROM (SELECT e, chunk, pos, unnest(aliases) AS y, generate_subscripts(aliases, 1) AS i FROM c)) WHERE x <> '' GROUP BY e)
        SELECT c.e AS entity_id, any_value(t) AS entity_type, first(dn ORDER BY chunk, pos) FILTER (dn <> '') AS display_name, coalesce(any_value(array_to_string(list_filter(a.l, lambda x, i: list_position(a.l, x) = i)[1:12], '|')), '') AS aliases, array_to_string(list(c.entity_id ORDER BY chunk, pos)[1:24], '|') AS evidence_refs,
          list_extract(['minor', 'medium', 'major'], max(CASE importance WHEN 'major' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) + 1) AS importance,
          coalesce((CASE WHEN any_value(t) = 'npc_group' THEN CASE WHEN length(last(sm ORDER BY chunk, pos) FILTER (sm <> '')) > 120 THEN left(last(sm ORDER BY chunk, pos) FILTER (sm <> ''), 119) || '…' ELSE last(sm ORDER BY chunk, pos) FILTER (sm <> '') END
            ELSE CASE WHEN length(last(sm ORDER BY chunk, pos) FILTER (sm <> '')) > 180 THEN left(last(sm ORDER BY chunk, pos) FILTER (sm <> ''), 179) || '…' ELSE last(sm ORDER BY chunk, pos) FILTER (sm <> '') END END), '') AS summary,
          CAST(sum(greatest(0, coalesce(dialogue_count, 0))) AS BIGINT) AS dialogue_count, min(chunk) AS first_seen_chunk, max(chunk) AS latest_seen_chunk FROM c LEFT JOIN a ON a.e = c.e GROUP BY c.e""",
    "e_ensure": f"""WITH v AS (SELECT DISTINCT dialogue_id, model, speaker_entity_id, speaker_display, speaker_status, coalesce(pos, 0) AS chunk FROM votes WHERE dialogue_id IS NOT NULL AND model IS NOT NULL)
        SELECT speaker_entity_id AS entity_id, first(CASE speaker_status WHEN 'known' THEN 'character' ELSE speaker_status END ORDER BY chunk, speaker_display, CASE speaker_status WHEN 'known' THEN 'character' ELSE speaker_status END) AS entity_type, first(speaker_display ORDER BY chunk, speaker_display) AS display_name, min(chunk) AS first_chunk FROM v
        WHERE speaker_entity_id IS NOT NULL AND speaker_status IN ('known', 'mystery', 'npc_group') AND {clean("speaker_display")} <> '' AND speaker_entity_id NOT IN (SELECT entity_id FROM entity_cards) GROUP BY 1""",
    "e_snapshot": f"SELECT volume_id, entity_id, display_name FROM {_C} QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY entity_id DESC) <= 30",
    "w_memories": f"""WITH {WINDOWS}, s AS (SELECT DISTINCT window_id, volume_id, dialogue_index AS o FROM win), z AS (SELECT volume_id, max(dialogue_index) + 1 AS n FROM win GROUP BY 1),
        m AS (SELECT volume_id, doc_id, row_number() OVER (PARTITION BY volume_id ORDER BY doc_id) AS chunk, count(*) OVER (PARTITION BY volume_id) AS c FROM documents WHERE doc_kind = 'memory' AND volume_id IS NOT NULL),
        f AS (SELECT window_id, doc_id, chunk, CASE WHEN c > 1 THEN min(abs(chunk - least(o * c // n + 1, c))) END AS far FROM s JOIN z USING (volume_id) JOIN m USING (volume_id) GROUP BY window_id, doc_id, chunk, c),
        g AS (SELECT *, coalesce(far <= 1, true) AS near, bool_or(coalesce(far <= 1, true)) OVER (PARTITION BY window_id) AS has FROM f)
        SELECT window_id, doc_id AS memory_id, CAST(chunk AS INTEGER) AS chunk FROM g WHERE near OR NOT has QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN has THEN far END NULLS FIRST, chunk, doc_id) <= 2""",
    "j_paragraph_cards": f"""WITH q AS (SELECT paragraph_id, array_to_string(list_sort(list(DISTINCT dialogue_id)), '|') AS d FROM dialogues GROUP BY 1)
        SELECT p.paragraph_id, CASE WHEN length({clean("text")}) > 360 THEN left({clean("text")}, 359) || '…' ELSE {clean("text")} END AS text, coalesce(d, '') AS dialogue_ids FROM {ONCE("paragraphs", "paragraph_id, text")} p LEFT JOIN q ON q.paragraph_id = p.paragraph_id""",
    "v_weights": """WITH g AS (SELECT model, max(weight) AS w FROM votes WHERE model IS NOT NULL GROUP BY 1) SELECT role, model, CASE WHEN w > 1.1 AND role = 'judge' THEN w WHEN w > 0.9 AND w <= 1.1 THEN w ELSE 1.0 END AS weight FROM g CROSS JOIN (VALUES ('judge'), ('evidence')) r(role)""",
}
