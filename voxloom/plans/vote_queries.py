"""Queries and SQL of vote aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import votes as V
from voxloom.plans.sql import ONCE, clean, in_list
from voxloom.sources.tables import once, table

VOTE = ["weight", "confidence", "speaker_entity_id", "speaker_display", "speaker_status", "needs_review", "pos", "evidence"]


def votes_of(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "votes"), ["dialogue_id", "model"], VOTE)


def dialogues_of(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "dialogues"), ["dialogue_id"], ["text", "dialogue_kind", "paragraph_text", "char_start", "char_end", "next_context"])
    narration = F.transform("next_context", lambda x: X.clean_text(x["text"]))
    quote = F.expr("array_position(transform(_n, x -> contains(x, '「') or contains(x, '」')), true)")
    t = t.withColumn("_n", F.filter(narration, lambda x: x != ""))
    after = F.slice("_n", F.lit(1), F.when(quote > 0, F.least(quote.cast("int") - 1, F.lit(2))).otherwise(2))
    around = F.concat(F.array(X.outside_quote(F.col("paragraph_text"), F.col("char_start"), F.col("char_end"))), F.coalesce(after, F.array().cast("array<string>")))
    return t.select("dialogue_id", "text", "dialogue_kind", around.alias("context"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("dialogue_id", "speaker_entity_id", "speaker_display", "speaker_status", "confidence", "needs_review", "rule_applied", "review_reason", "vote_count", F.array_join("models", "|").alias("models"), F.array_join("evidence", "|").alias("evidence"), F.coalesce(F.size("candidate_speakers"), F.lit(0)).alias("candidates"))


def v_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _flat(V.aggregate_votes(dialogues_of(spark, d), votes_of(spark, d)))


def v_anchored(spark: SparkSession, d: str) -> DataFrame:
    return _flat(V.aggregate_votes(dialogues_of(spark, d), votes_of(spark, d), anchored=True))


def v_override(spark: SparkSession, d: str) -> DataFrame:
    return V.rank_speakers(votes_of(spark, d)).where("over is not null").select("dialogue_id", F.col("over").alias("override_key"))


def v_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = V.aggregate_votes(dialogues_of(spark, d), votes_of(spark, d)).select("dialogue_id", F.posexplode("candidate_speakers").alias("rank", "c"))
    return found.select("dialogue_id", "rank", F.col("c.entity_id").alias("entity_id"), F.col("c.score").alias("score"), F.array_join("c.models", "|").alias("models"))


_STATUS = f"CASE WHEN {clean('speaker_status')} IN {in_list(X.STATUSES)} THEN {clean('speaker_status')} ELSE 'review' END"
GROUPS = f"""v AS (SELECT dialogue_id, model, pos, evidence, {_STATUS} AS status, coalesce(needs_review, false) AS review, greatest(0.0, coalesce(weight, 1.0)) AS w, least(1.0, greatest(0.0, coalesce(confidence, 0.0))) AS c,
          starts_with({clean("model")}, 'rule:') AS is_rule, {clean("speaker_display")} AS display, {clean("speaker_entity_id")} AS entity
          FROM {ONCE("votes", "dialogue_id, model, pos, evidence, speaker_status, needs_review, weight, confidence, speaker_display, speaker_entity_id")} WHERE dialogue_id IS NOT NULL AND model IS NOT NULL),
        k AS (SELECT *, CASE WHEN entity <> '' THEN entity ELSE status || ':' || CASE WHEN display = '' THEN 'unknown' ELSE display END END AS key FROM v),
        g AS (SELECT dialogue_id, key, round(sum(w * c), 9) AS score, sum(w) AS w, count(*) AS n, coalesce(max(c) FILTER (is_rule), 0.0) AS rule_c, bool_or(review) AS review, list_sort(list(DISTINCT model)) AS models, min(pos) AS pos,
          min_by(entity, pos) AS entity, min_by(display, pos) AS display, min_by(status, pos) AS status, bool_or(is_rule AND NOT review AND status IN ('known', 'npc') AND c >= 0.92) AS overrides, flatten(list(evidence ORDER BY pos)) AS evidence FROM k GROUP BY dialogue_id, key),
        o AS (SELECT dialogue_id, CASE WHEN count(*) FILTER (overrides) = 1 THEN max(key) FILTER (overrides) END AS ov, sum(w) AS total, CAST(sum(n) AS INTEGER) AS vote_count FROM g GROUP BY dialogue_id),
        m AS (SELECT dialogue_id, list_sort(list(DISTINCT model)) AS models, count(DISTINCT model) FILTER (NOT is_rule) AS human FROM v GROUP BY dialogue_id),
        r AS (SELECT g.*, o.ov, CASE WHEN total > 0 THEN total ELSE 1.0 END AS total, vote_count, row_number() OVER (PARTITION BY g.dialogue_id ORDER BY coalesce(key = ov, false) DESC, score DESC, pos) AS rn FROM g JOIN o USING (dialogue_id))"""

_NEXT = f"list_filter(list_transform(coalesce(next_context, []), lambda x: {clean('x.text')}), lambda x: x <> '')"
_OUTSIDE = clean("left(paragraph_text, greatest(char_start, 0)) || substring(paragraph_text, greatest(char_end, char_start, 0) + 1)")
_QUOTE = f"coalesce(list_position(list_transform({_NEXT}, lambda x: contains(x, '「') OR contains(x, '」')), true), 0)"
#: Texts in which the display name stands before a verb of speech: what the evidence and the narration around a line may anchor.
_ANCHORS = f"""tx AS (SELECT DISTINCT dialogue_id, {clean("text")} AS said, list_concat([{_OUTSIDE}], ({_NEXT})[1:CASE WHEN {_QUOTE} > 0 THEN least({_QUOTE} - 1, 2) ELSE 2 END]) AS context FROM dialogues),
        tp AS (SELECT r.dialogue_id, display, status, said, context, list_filter(list_transform(evidence, lambda x: {clean("x")}), lambda x: x <> '') AS ev FROM r JOIN tx USING (dialogue_id) WHERE rn = 1 AND display <> ''),
        ts AS (SELECT dialogue_id, display, unnest(list_concat(list_filter(ev, lambda x, i: list_position(ev, x) = i)[1:8], context)) AS txt FROM tp),
        vb(verb) AS (VALUES {", ".join(f"('{v}')" for v in V.VERBS)}),
        oc AS (SELECT *, unnest(range(1, length(txt) + 1)) AS occ FROM ts JOIN vb ON contains(txt, verb) AND contains(txt, display)),
        fr AS (SELECT *, occ + length(display) + k AS v FROM (SELECT *, unnest(range(0, 31)) AS k FROM oc WHERE substring(txt, occ, length(display)) = display)),
        la AS (SELECT * FROM fr WHERE substring(txt, v, length(verb)) = verb AND NOT contains(substring(txt, occ + length(display), k), chr(10)) QUALIFY row_number() OVER (PARTITION BY dialogue_id, txt, verb, occ ORDER BY k DESC) = 1),
        an AS (SELECT DISTINCT dialogue_id FROM la WHERE substring(txt, v - 1, 1) NOT IN ('被', '询') AND (verb NOT IN ('说', '问') OR NOT regexp_matches(substring(txt, v + length(verb)), '^(?:{"|".join(V.INDIRECT)})'))
          UNION SELECT dialogue_id FROM tp WHERE contains(said, display) AND regexp_matches(left(said, instr(said, display) + length(display) - 1), '{"|".join(V.INTRO)}')),
        ag AS (SELECT dialogue_id FROM tp WHERE status = 'known' AND contains(said, display) AND (regexp_matches(said, '[他她它](?:的)?名字是\\Q' || display || '\\E') OR regexp_matches(said, '[他她它](?:应该|一定|会|是|的|叫).{{0,20}}\\Q' || display || '\\E'))),"""


def _aggregate(anchored: bool) -> str:
    forced = "CASE WHEN by_rule THEN '' WHEN coalesce(dialogue_kind, 'standalone') <> 'standalone' THEN 'non_standalone_quote' WHEN part > 1 THEN '' WHEN status = 'mystery' THEN 'single_model_mystery_candidate' ELSE '' END"
    if anchored:
        forced = "CASE WHEN coalesce(dialogue_kind, 'standalone') = 'standalone' AND ag.dialogue_id IS NOT NULL THEN 'speaker_contradiction:third_person_name_reference' WHEN " + forced[len("CASE WHEN ") : -len("ELSE '' END")] + "WHEN status = 'known' AND an.dialogue_id IS NULL THEN 'single_model_without_anchor' ELSE '' END"
    more = _ANCHORS if anchored else ""
    joined = " LEFT JOIN (SELECT DISTINCT dialogue_id FROM an) an ON an.dialogue_id = t.dialogue_id LEFT JOIN (SELECT DISTINCT dialogue_id FROM ag) ag ON ag.dialogue_id = t.dialogue_id" if anchored else ""
    return f"""WITH {GROUPS}, {more}
        t AS (SELECT a.*, (a.score - coalesce(b.score, 0.0)) / a.total AS margin, a.score / a.total AS agreement, len(a.models) AS support, m.models AS all_models, CASE WHEN m.human > 0 THEN m.human ELSE len(m.models) END AS part, a.ov IS NOT NULL AS by_rule,
            (SELECT count(*) FROM r x WHERE x.dialogue_id = a.dialogue_id) AS n_c
          FROM r a LEFT JOIN r b ON b.dialogue_id = a.dialogue_id AND b.rn = 2 JOIN m ON m.dialogue_id = a.dialogue_id WHERE a.rn = 1),
        f AS (SELECT d.dialogue_id AS did, coalesce(dialogue_kind, 'standalone') AS kind, t.*, {forced} AS forced
          FROM {ONCE("dialogues", "dialogue_id, dialogue_kind")} d LEFT JOIN t ON t.dialogue_id = d.dialogue_id{joined}),
        a AS (SELECT *, CASE WHEN vote_count IS NULL THEN false WHEN by_rule THEN NOT review AND status IN ('known', 'npc') AND rule_c >= 0.92 WHEN forced <> '' THEN false
          WHEN part <= 1 THEN NOT review AND status IN ('known', 'mystery', 'npc') AND agreement >= 0.75
          ELSE NOT review AND status IN ('known', 'mystery', 'npc') AND agreement >= 0.65 AND margin >= 0.2 AND support >= least(2, greatest(1, part)) END AS ok,
          list_filter(list_transform(evidence, lambda x: {clean("x")}), lambda x: x <> '') AS ev FROM f)
        SELECT did AS dialogue_id, CASE WHEN vote_count IS NULL THEN 'review:no_vote' ELSE entity END AS speaker_entity_id, coalesce(nullif(display, ''), '待复核') AS speaker_display, CASE WHEN ok THEN status ELSE 'review' END AS speaker_status,
          coalesce(round(CASE WHEN by_rule THEN greatest(agreement, rule_c) ELSE agreement END, 4), 0.0) AS confidence, NOT ok AS needs_review, coalesce(by_rule AND ok, false) AS rule_applied,
          CASE WHEN vote_count IS NULL THEN 'no_valid_votes' WHEN ok THEN '' WHEN forced <> '' THEN forced WHEN review THEN 'model_requested_review' WHEN status NOT IN ('known', 'mystery', 'npc') THEN 'non_final_status:' || status
            WHEN agreement <= 0 THEN 'zero_confidence' ELSE printf('low_agreement:%.2f;margin:%.2f;support:%d', agreement, margin, support) END AS review_reason,
          coalesce(vote_count, 0) AS vote_count, coalesce(array_to_string(all_models, '|'), '') AS models, coalesce(array_to_string(list_filter(ev, lambda x, i: list_position(ev, x) = i)[1:8], '|'), '') AS evidence, CAST(coalesce(n_c, 0) AS INTEGER) AS candidates FROM a"""


SQL = {
    "v_override": f"WITH {GROUPS} SELECT dialogue_id, ov AS override_key FROM o WHERE ov IS NOT NULL",
    "v_candidates": f"""WITH {GROUPS} SELECT r.dialogue_id, CAST(rn - 1 AS INTEGER) AS rank, entity AS entity_id, round(score / total, 4) AS score, array_to_string(models, '|') AS models FROM r
        JOIN {ONCE("dialogues", "dialogue_id")} USING (dialogue_id)""",
    "v_aggregate": _aggregate(False),
    "v_anchored": _aggregate(True),
}
