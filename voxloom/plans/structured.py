"""The structured window: evidence, judgement, rules, check, one targeted repair, over stored answers.

Every role is a stage over all windows at once: its prompts are the payload with what the
stages before found, its answers are replayed from a table, and a missing or unreadable
answer is a failure row that the later stages do without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import reader as N
from voxloom.operators import render as O
from voxloom.operators import responses as J
from voxloom.operators import rules as R
from voxloom.operators import votes as V
from voxloom.operators import windows as W
from voxloom.plans import pipeline as P
from voxloom.sources.scratch import Scratch

ROLES = ("evidence", "judge", "contradiction", "repair")
INSTRUCTIONS = {
    "evidence": "只找证据，不下结论。为每一句对白列出支持与反对的文本依据、说话对象和口癖，按 evidence 列表回答 JSON，每句一项：dialogue_id、positive_evidence、negative_evidence、addressed_to、speech_markers、turn_relation、same_speaker_allowed、notes。",
    "judge": "根据对白、候选人和 evidence 判断每一句由谁说出，按 annotations 列表回答 JSON，每句一项：dialogue_id、speaker_entity_id、speaker_display、speaker_status、confidence、evidence、needs_review。",
    "contradiction": "检查每一句的判断是否与原文矛盾，按 checks 列表回答 JSON，每句一项：dialogue_id、has_contradiction、severity（none、weak、strong）、reason、counter_evidence。",
    "repair": "下列判断与原文有强烈矛盾。只重新判断这些句子，按 annotations 列表回答 JSON，各项与之前相同。",
}
LISTS = {"evidence": ("evidence", "evidence_by_dialogue", "items", "results"), "contradiction": ("checks", "contradiction_checks", "items", "results")}


def replayed(asked: DataFrame, responses: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """`request_id, window_id, model, v` of the stored answers, and `request_id, role, error_type, error` of the others."""
    hit, missing = J.replay(asked.select("request_id", "window_id", "model"), responses)
    parsed = hit.select("request_id", "window_id", "model", J.parse_json(F.col("raw")).alias("v"))
    unread = parsed.where("v is null").select("request_id", F.lit("JSONDecodeError").alias("error_type"), F.lit("the answer holds no JSON").alias("error"))
    failed = missing.unionByName(unread).select("request_id", F.lit(role).alias("role"), "error_type", "error")
    return parsed.where("v is not null"), failed


def speaker_votes(parsed: DataFrame, asked: DataFrame, weights: DataFrame, prefix: str) -> DataFrame:
    """Votes in normal form of a role's answers; the model is named with the role."""
    return J.votes(parsed, asked, weights).withColumn("model", F.concat(F.lit(prefix), "model"))


def repaired(strong: DataFrame, before: DataFrame, after: DataFrame, answered: DataFrame) -> DataFrame:
    """`request_id, model, dialogue_id, trigger_reason, initial, repaired, stop_reason, resolved` of strongly contradicted dialogues.

    strong: `dialogue_id, request_id, model, trigger_reason`; after: the aggregate of the
    repair votes; answered: `request_id, state` of the repair requests, `read`, `failed`,
    or missing altogether.
    """
    first = before.select("dialogue_id", F.col("speaker_entity_id").alias("initial"))
    then = after.select("dialogue_id", F.col("speaker_entity_id").alias("repaired"), F.col("needs_review").alias("_review"))
    met = strong.join(first, "dialogue_id").join(then, "dialogue_id", "left").join(answered, "request_id", "left")
    stop = (
        F.when(F.col("state").isNull(), "repair_cache_missing")
        .when(F.col("state") == "failed", "request_failed")
        .when(F.col("repaired").isNull(), "missing_response")
        .when(F.col("_review"), "needs_review")
        .when(F.col("repaired") == F.col("initial"), "unchanged")
        .otherwise("resolved")
    )
    return met.select("request_id", "model", "dialogue_id", "trigger_reason", "initial", "repaired", stop.alias("stop_reason"), (stop == "resolved").alias("resolved"))


def annotate(dialogues: DataFrame, paragraphs: DataFrame, cards: DataFrame, models: DataFrame, responses: DataFrame, memories: DataFrame | None = None, mysteries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stored answers of all roles to one speaker per dialogue, with evidence, checks, repairs and failures.

    models: `role, model, weight` for the roles evidence, judge and contradiction; the
    first judge by name repairs. responses: `request_id, raw, pos`; request ids are
    `role--window--model`, of a repair `repair--window--iter1--model`.
    """
    scratch = Scratch(dialogues.sparkSession)
    payload, windows, lines, options = P.payloads(dialogues, cards, paragraphs, memories, mysteries)
    payload = scratch.save(payload, "payload")
    of_window = lines.select("window_id", "dialogue_id")
    failures: list[DataFrame] = []

    def role(name: str, payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Requests, read answers and `request_id, dialogue_id` of a role."""
        asked = scratch.save(P.asked_of(payload, models.where(F.col("role") == name), "window_id", name, INSTRUCTIONS[name], first=False), f"{name}-requests")
        read, failed = replayed(asked, responses, name)
        failures.append(failed)
        return asked, read, asked.select("request_id", "window_id").join(of_window, "window_id").select("request_id", "dialogue_id")

    def shown(rows: DataFrame, name: str) -> DataFrame:
        """Rows of dialogues as one list per window."""
        columns = [c for c in rows.columns if c != "window_id"]
        return rows.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    asked_e, read, of = role("evidence", payload)
    evidence = scratch.save(N.evidence(J.by_dialogue(read, of, LISTS["evidence"])), "evidence")
    told = shown(evidence.join(of_window, "dialogue_id").select("window_id", "dialogue_id", "positive_evidence", "negative_evidence", "addressed_to", "turn_relation", "notes"), "structured_evidence")
    with_evidence = payload.join(told, "window_id", "left")

    weights = models.where("role = 'judge'").select("model", "weight")
    asked_j, read, of = role("judge", with_evidence)
    judged = speaker_votes(read, of, weights, "judge:")
    ruled = R.rule_votes(lines, options, W.alternation_segments(windows))
    ruled = ruled.withColumn("evidence", F.array(F.concat(F.lit("规则："), F.col("rule")))).drop("rule").withColumn("needs_review", F.lit(False))
    votes = judged.withColumn("pos", F.lit(0)).unionByName(ruled.withColumn("pos", F.lit(1)))
    votes = scratch.save(votes.withColumn("pos", F.row_number().over(Window.partitionBy("dialogue_id").orderBy("pos", "model"))), "votes")
    context = lines.select("dialogue_id", "text", F.col("kind").alias("dialogue_kind"), F.col("narration").alias("context"))
    markers = scratch.save(R.marker_owners(lines, options), "markers")
    first = scratch.save(V.aggregate_votes(context, votes, checked=True, markers=markers), "first")

    cards_of = first.join(of_window, "dialogue_id").select("window_id", "dialogue_id", "speaker_entity_id", "speaker_display", "speaker_status", "confidence", "needs_review", "review_reason")
    now = scratch.save(with_evidence.join(shown(cards_of, "judgements"), "window_id", "left"), "judged")
    asked_c, read, of = role("contradiction", now)
    checks = scratch.save(N.contradictions(J.by_dialogue(read, of, LISTS["contradiction"])), "checks")

    # one repair of each window with a strong check, of its strongly contradicted lines only
    judge = models.where("role = 'judge'").select("model").orderBy("model").limit(1)
    strong = checks.where("severity = 'strong'").groupBy("dialogue_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("reason")), 1, 3), "; ").alias("trigger_reason"), F.array_sort(F.flatten(F.collect_list("counter"))).alias("counter"))
    strong = scratch.save(strong.join(of_window, "dialogue_id"), "strong")
    targets = shown(strong.select("window_id", "dialogue_id", "trigger_reason", "counter"), "strong_contradictions")
    asked_r = P.asked_of(now.join(targets, "window_id"), judge, "window_id", "repair", INSTRUCTIONS["repair"], first=False)
    asked_r = scratch.save(_numbered(asked_r), "repair-requests")
    read, failed = replayed(asked_r, responses, "repair")
    failures.append(failed.where("error_type <> 'CacheMiss'"))
    goal = asked_r.select("request_id", "window_id", "model").join(strong, "window_id").select("request_id", "model", "dialogue_id", "trigger_reason")
    held = J.by_dialogue(read.select("request_id", "v"), goal.select("request_id", "dialogue_id"), J.LISTS).where(F.to_json("r") != "{}")
    again = speaker_votes(read, held.select("request_id", "dialogue_id"), weights, "repair:").withColumn("pos", F.lit(1))
    after = V.aggregate_votes(context.join(held.select("dialogue_id"), "dialogue_id", "left_semi"), again, checked=True, markers=markers)
    after = scratch.save(after, "after")
    state = read.select("request_id", F.lit("read").alias("state")).unionByName(failed.where("error_type <> 'CacheMiss'").select("request_id", F.lit("failed").alias("state")))
    repairs = scratch.save(repaired(goal, first, after, state), "repairs")

    solved = repairs.where("resolved").select("dialogue_id")
    fixed = first.join(solved, "dialogue_id", "left_anti").unionByName(after.join(solved, "dialogue_id", "left_semi"))
    judged_checks = checks.join(solved.withColumn("resolved", F.lit(True)), "dialogue_id", "left").withColumn("pos", F.row_number().over(Window.partitionBy("dialogue_id").orderBy("request_id")))
    found = scratch.save(V.apply_checks(fixed, judged_checks.select("dialogue_id", "severity", "reason", "counter", "pos", "resolved")), "annotations")

    at = dialogues.select("dialogue_id", "paragraph_id", "char_start", "dialogue_kind")
    labels = found.join(at, "dialogue_id").select("paragraph_id", "char_start", O.label(F.col("dialogue_kind"), F.col("needs_review"), F.col("speaker_status"), F.col("speaker_display")).alias("label"))
    requests, failed = asked_e, failures[0]
    for more in (asked_j, asked_c, asked_r):
        requests = requests.unionByName(more)
    for more in failures[1:]:
        failed = failed.unionByName(more)
    return {
        "requests": requests, "evidence": evidence, "votes": votes.unionByName(again), "checks": checks, "repairs": repairs, "annotations": found,
        "review_queue": found.where("needs_review"), "labeled": O.labeled_text(paragraphs, labels), "failures": failed, "summary": O.run_summary(found),
    }


def _numbered(asked: DataFrame) -> DataFrame:
    """The first and only iteration stands in the id of a repair request."""
    return asked.withColumn("request_id", F.concat(F.lit("repair--"), "window_id", F.lit("--iter1--"), F.substring_index("request_id", "--", -1)))
