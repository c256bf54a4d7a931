"""Weighted votes to one speaker per dialogue: override by rules, acceptance, reasons for review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as X

RULE_PREFIX = "rule:"
RULE_FLOOR = 0.92
REVIEW_LABEL = "待复核"
FINAL = ("known", "mystery", "npc")
# Verbs of speech, and what follows 说 or 问 when the speech is only reported.
VERBS = ("说", "说道", "问", "询问", "回答", "答道", "喊", "大喊", "叫", "嚷", "喃喃", "发出声音")
INDIRECT = ("的话", "的任何", "的事", "的内容", "的说法", "话", "法")
INTRO = ("我是", "我叫", "在下是", "本人是", "我的名字是")


@dataclass(frozen=True)
class Thresholds:
    confidence: float = 0.75
    agreement: float = 0.65
    margin: float = 0.20
    support: int = 2


def quoted(name: Column) -> Column:
    """A pattern that matches the text of a column."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(name, r"\\E", ""), F.lit("\\E"))


def attribution_pattern(name: Column, verb: str) -> Column:
    """name, up to 30 characters, verb; the farthest verb decides, and reported or passive speech is no match."""
    indirect = f"(?!{'|'.join(INDIRECT)})" if verb in ("说", "问") else ""
    return F.concat(F.lit("(?>"), quoted(name), F.lit(f".{{0,30}}{verb})(?<![被询]{verb}){indirect}"))


def speech_near_name(text: Column, name: Column) -> Column:
    out = F.lit(False)
    for v in VERBS:
        out = out | (F.contains(text, F.lit(v)) & F.rlike(text, attribution_pattern(name, v)))
    return F.contains(text, name) & out


def refers_to(text: Column, name: Column) -> Column:
    """Speaks of the name in the third person."""
    return F.rlike(text, F.concat(F.lit("[他她它](?:的)?名字是"), quoted(name))) | F.rlike(text, F.concat(F.lit("[他她它](?:应该|一定|会|是|的|叫).{0,20}"), quoted(name)))


def rank_speakers(votes: DataFrame) -> DataFrame:
    """One row per dialogue: totals, the override key, and `ranked`, the candidates from best to worst.

    votes: `dialogue_id, model, weight, confidence, speaker_entity_id, speaker_display,
    speaker_status, needs_review, pos, evidence`.  Both aggregates combine before they
    shuffle; a dialogue has at most one candidate per vote.
    """
    status = X.clean_status(F.col("speaker_status"))
    v = votes.select(
        "dialogue_id", "model", "pos", "evidence", status.alias("status"), F.coalesce("needs_review", F.lit(False)).alias("review"),
        F.greatest(F.lit(0.0), X.safe_double(F.col("weight"), 1.0)).alias("w"), X.clamp(X.safe_double(F.col("confidence"), 0.0), 0.0, 1.0).alias("c"),
        X.clean_text(F.col("model")).startswith(RULE_PREFIX).alias("rule"), X.clean_text(F.col("speaker_display")).alias("display"), X.clean_text(F.col("speaker_entity_id")).alias("entity"),
    )
    v = v.withColumn("key", X.vote_key(F.col("entity"), F.col("status"), F.col("display")))
    by_key = v.groupBy("dialogue_id", "key").agg(
        F.round(F.sum(F.col("w") * F.col("c")), 9).alias("score"), F.sum("w").alias("w"), F.count("*").alias("n"),
        F.coalesce(F.max(F.when(F.col("rule"), F.col("c"))), F.lit(0.0)).alias("rule_c"), F.bool_or("review").alias("review"), F.collect_set("model").alias("models"),
        F.min(F.struct("pos", "model", "entity", "display", "status")).alias("first"), F.collect_list(F.struct("pos", "model", "evidence")).alias("evidence"),
        F.collect_set(F.when(~F.col("rule"), F.col("model"))).alias("human"),
        F.bool_or(F.col("rule") & ~F.col("review") & F.col("status").isin("known", "npc") & (F.col("c") >= RULE_FLOOR)).alias("overrides"),
    )
    row = F.struct((-F.col("score")).alias("minus"), F.col("first.pos").alias("pos"), F.col("first.model").alias("by"), "key", "score", "rule_c", "review", "models", "first", "evidence")
    found = by_key.groupBy("dialogue_id").agg(
        F.array_sort(F.collect_list(row)).alias("ranked"), F.sum("w").alias("total"), F.sum("n").cast("int").alias("vote_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"), F.size(F.array_distinct(F.flatten(F.collect_list("human")))).alias("n_human"),
        F.collect_set(F.when(F.col("overrides"), F.col("key"))).alias("over"),
    )
    found = found.withColumn("over", F.when(F.size("over") == 1, F.col("over")[0]))
    mine = F.filter("ranked", lambda x: x["key"] == F.col("over"))
    rest = F.filter("ranked", lambda x: x["key"] != F.col("over"))
    return found.withColumn("ranked", F.when(F.col("over").isNotNull(), F.concat(mine, rest)).otherwise(F.col("ranked")))


def aggregate_votes(dialogues: DataFrame, votes: DataFrame, anchored: bool = False, limits: Thresholds = Thresholds(), checked: bool = False, markers: DataFrame | None = None) -> DataFrame:
    """The speaker of every dialogue, or why it needs review.

    dialogues: `dialogue_id, text, dialogue_kind, context ARRAY<STRING>`. With `anchored`
    a single model's known speaker needs an anchor in text, evidence or narration. With
    `anchored` or `checked` a third-person reference contradicts a known speaker, and so
    does a marker that another option of the window owns (markers: `dialogue_id, owners,
    listed`, see the rules). A dialogue without votes needs review.
    """
    d = dialogues.withColumn("kind", F.coalesce("dialogue_kind", F.lit("standalone"))).join(rank_speakers(votes), "dialogue_id", "left")
    top, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    d = d.withColumn("agreement", top["score"] / total).withColumn("margin", (top["score"] - F.coalesce(second["score"], F.lit(0.0))) / total)
    d = d.withColumn("support", F.size(top["models"])).withColumn("taking_part", F.when(F.col("n_human") > 0, F.col("n_human")).otherwise(F.size("models")))
    d = d.withColumn("by_rule", F.col("over").isNotNull()).withColumn("status", top["first"]["status"]).withColumn("display", top["first"]["display"])
    d = d.withColumn("evidence", X.unique_strings(F.flatten(F.transform(F.array_sort(top["evidence"]), lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>")))), 8))
    forced = F.when(F.col("by_rule"), "").when(F.col("kind") != "standalone", "non_standalone_quote").when(F.col("taking_part") > 1, "").when(F.col("status") == "mystery", "single_model_mystery_candidate")
    if anchored or checked:
        name = F.col("display")
        d = d.withColumn("_said", X.clean_text(F.col("text")))
    if anchored:
        by_evidence = F.exists("evidence", lambda e: speech_near_name(e, name))
        by_context = F.exists(F.coalesce("context", F.array().cast("array<string>")), lambda e: speech_near_name(X.clean_text(e), name))
        intro = F.expr("exists(array(" + ", ".join(f"'{m}'" for m in INTRO) + "), m -> contains(left(_said, instr(_said, display) + length(display) - 1), m))")
        anchor = (name != "") & ((F.contains(F.col("_said"), name) & intro) | by_evidence | by_context)
        forced = forced.when((F.col("status") == "known") & ~anchor, "single_model_without_anchor")
    forced = forced.otherwise("")
    if anchored or checked:
        known = (F.col("kind") == "standalone") & (F.col("status") == "known") & (name != "") & (F.col("_said") != "")
        if markers is not None:
            d = d.join(markers, "dialogue_id", "left")
            other = F.get(F.filter("owners", lambda o: o["entity_id"] != top["key"]), F.lit(0))
            marked = known & F.array_contains("listed", top["key"]) & other.isNotNull()
            forced = F.when(marked, F.concat(F.lit("speaker_contradiction:speech_marker:"), other["display"])).otherwise(forced)
        told = known & F.contains(F.col("_said"), name) & refers_to(F.col("_said"), name)
        forced = F.when(told, "speaker_contradiction:third_person_name_reference").otherwise(forced)
    d = d.withColumn("forced", F.coalesce(forced, F.lit("")))
    final, calm = F.col("status").isin(*FINAL), ~top["review"]
    accepted = (
        F.when(F.col("vote_count").isNull(), False)
        .when(F.col("by_rule"), calm & F.col("status").isin("known", "npc") & (top["rule_c"] >= RULE_FLOOR))
        .when(F.col("forced") != "", False)
        .when(F.col("taking_part") <= 1, calm & final & (F.col("agreement") >= limits.confidence))
        .otherwise(calm & final & (F.col("agreement") >= limits.agreement) & (F.col("margin") >= limits.margin) & (F.col("support") >= F.least(F.lit(limits.support), F.greatest(F.lit(1), F.col("taking_part")))))
    )
    d = d.withColumn("accepted", accepted)
    two = lambda c: F.format_number(F.col(c), 2)
    reason = (
        F.when(F.col("vote_count").isNull(), "no_valid_votes")
        .when(F.col("accepted"), "")
        .when(F.col("forced") != "", F.col("forced"))
        .when(top["review"], "model_requested_review")
        .when(~final, F.concat(F.lit("non_final_status:"), F.col("status")))
        .when(F.col("agreement") <= 0, "zero_confidence")
        .otherwise(F.concat(F.lit("low_agreement:"), two("agreement"), F.lit(";margin:"), two("margin"), F.lit(";support:"), F.col("support").cast("string")))
    )
    voted = F.col("vote_count").isNotNull()
    return d.select(
        "dialogue_id",
        F.when(voted, top["first"]["entity"]).otherwise("review:no_vote").alias("speaker_entity_id"),
        F.when(voted & (F.col("display") != ""), F.col("display")).otherwise(REVIEW_LABEL).alias("speaker_display"),
        F.when(F.col("accepted"), F.col("status")).otherwise("review").alias("speaker_status"),
        F.when(voted, F.round(F.when(F.col("by_rule"), F.greatest(F.col("agreement"), top["rule_c"])).otherwise(F.col("agreement")), 4)).otherwise(0.0).alias("confidence"),
        F.transform("ranked", lambda x: F.struct(x["first"]["entity"].alias("entity_id"), x["first"]["display"].alias("display"), x["first"]["status"].alias("status"), F.round(x["score"] / total, 4).alias("score"), F.array_sort(x["models"]).alias("models"))).alias("candidate_speakers"),
        "evidence",
        (~F.col("accepted")).alias("needs_review"),
        (F.col("by_rule") & F.col("accepted")).alias("rule_applied"),
        reason.alias("review_reason"),
        F.coalesce("vote_count", F.lit(0)).alias("vote_count"),
        F.coalesce("models", F.array().cast("array<string>")).alias("models"),
    )


def apply_checks(annotations: DataFrame, checks: DataFrame) -> DataFrame:
    """Annotations that a strong, unresolved contradiction check sends back to review.

    checks: `dialogue_id, severity, reason, counter ARRAY<STRING>, pos, resolved BOOLEAN`.
    """
    strong = checks.where("severity = 'strong' and not coalesce(resolved, false)").groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("pos", "reason", "counter"))).alias("_c"))
    met = annotations.join(strong, "dialogue_id", "left")
    why = F.array_join(F.slice(X.unique_strings(F.transform("_c", lambda x: x["reason"])), 1, 3), "; ")
    hit = F.col("_c").isNotNull()
    more = F.flatten(F.transform("_c", lambda x: F.coalesce(x["counter"], F.array().cast("array<string>"))))
    met = met.withColumn("evidence", F.when(hit, X.unique_strings(F.concat("evidence", more), 8)).otherwise(F.col("evidence")))
    met = met.withColumn("review_reason", F.when(hit, F.concat(F.lit("strong_contradiction:"), why)).otherwise(F.col("review_reason")))
    return met.withColumn("speaker_status", F.when(hit, "review").otherwise(F.col("speaker_status"))).withColumn("needs_review", hit | F.col("needs_review")).drop("_c")


def apply_repairs(annotations: DataFrame, repairs: DataFrame) -> DataFrame:
    """The last resolved or updated repair of a dialogue replaces its speaker.

    repairs: `dialogue_id, pos, stop_reason, speaker_entity_id, speaker_display, speaker_status, confidence`.
    """
    last = repairs.groupBy("dialogue_id").agg(F.max_by(F.struct("stop_reason", "speaker_entity_id", "speaker_display", "speaker_status", "confidence"), "pos").alias("_r")).where("_r.stop_reason in ('resolved', 'updated')")
    met = annotations.join(last, "dialogue_id", "left")
    for c in ("speaker_entity_id", "speaker_display", "speaker_status", "confidence"):
        met = met.withColumn(c, F.coalesce(F.col(f"_r.{c}"), F.col(c)))
    review = F.col("speaker_status").isin("unknown", "review")
    return met.withColumn("needs_review", F.when(F.col("_r").isNotNull(), review).otherwise(F.col("needs_review"))).withColumn("repaired", F.col("_r").isNotNull()).drop("_r")
