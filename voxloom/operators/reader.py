"""The second reader's tables: normal forms of its answers, entity cards from them, memories, facts and events.

An answer names its entities, so a card is an aggregate over the rows of its entity in
order of chunk and position: first display name, union of lists in that order, highest
importance, summed counts. Only the pending set needs state (see `streaming`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X

EMPTY = "array<string>"


def texts(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(EMPTY))


def first_values(rows: DataFrame, keys: list[str], values: str, order: list[str], limit: int) -> DataFrame:
    """keys and `values`: the first `limit` distinct cleaned strings of many lists, in order.

    A value is reduced to its first place before the lists of a key meet, and only `limit`
    of them are collected, so an entity in a third of all rows is gathered nowhere.
    """
    each = rows.select(*keys, *order, F.posexplode(texts(values)).alias("_i", "_v")).withColumn("_v", X.clean_text(F.col("_v"))).where("_v <> ''")
    first = each.groupBy(*keys, "_v").agg(F.min(F.struct(*order, "_i")).alias("_o"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "_v"))).where(F.col("_n") <= limit)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias(values))


def entity_type(c: Column) -> Column:
    t = F.lower(X.clean_text(c))
    return F.when(t.isin("known", "character"), "character").when(t.isin("npc", "npc_group"), "npc_group").when(t == "mystery", "mystery").otherwise("")


def v2_status(c: Column) -> Column:
    t = F.lower(X.clean_text(c))
    return F.when(t == "npc", "npc_group").when(t.isin("known", "mystery", "npc_group", "unknown", "review"), t).otherwise("review")


def entity_cards(found: DataFrame) -> DataFrame:
    """Cards of `volume_id, entity_id, chunk, pos, entity_type, display_name, aliases, importance, summary, evidence, delta`.

    Rows without an id or a type are left out; a negative delta counts as none.
    """
    f = found.withColumn("t", entity_type(F.col("entity_type"))).where("t <> '' and entity_id is not null")
    at = F.struct("chunk", "pos")
    seen = f.groupBy("volume_id", "entity_id").agg(
        F.min_by("t", at).alias("entity_type"), F.min_by(X.clean_text(F.col("display_name")), F.when(X.clean_text(F.col("display_name")) != "", at)).alias("display_name"),
        F.max(X.importance_level(F.col("importance"))).alias("_l"),
        F.max_by(X.clean_text(F.col("summary")), F.when(X.clean_text(F.col("summary")) != "", at)).alias("_s"), F.sum(F.greatest(F.lit(0), F.coalesce("delta", F.lit(0)))).alias("dialogue_count"),
        F.min("chunk").alias("first_seen_chunk"), F.max("chunk").alias("latest_seen_chunk"),
    )
    keys = ["volume_id", "entity_id"]
    for column, most in (("aliases", 12), ("evidence", 24)):
        listed = first_values(f, keys, column, ["chunk", "pos"], most).select(F.col("volume_id").alias("_volume"), F.col("entity_id").alias("_entity"), F.col(column).alias(f"_{column}"))
        seen = seen.join(listed, F.col("volume_id").eqNullSafe(F.col("_volume")) & (F.col("entity_id") == F.col("_entity")), "left").drop("_volume", "_entity")
    seen = seen.withColumn("aliases", texts("_aliases")).withColumn("evidence_refs", texts("_evidence")).drop("_aliases", "_evidence")
    most = F.when(F.col("entity_type") == "npc_group", X.truncate(F.col("_s"), 120)).otherwise(X.truncate(F.col("_s"), 180))
    return seen.withColumn("importance", F.element_at(F.array(*map(F.lit, X.IMPORTANCE)), F.col("_l") + 1)).withColumn("summary", most).drop("_l", "_s")


def ensure_entities(cards: DataFrame, annotations: DataFrame) -> DataFrame:
    """Minimal cards of speakers that have none: `entity_id, entity_type, display_name, first_chunk`."""
    kind = F.when(F.col("speaker_status") == "known", "character").when(F.col("speaker_status").isin("mystery", "npc_group"), F.col("speaker_status"))
    named = annotations.withColumn("entity_type", kind).where("entity_type is not null and speaker_entity_id is not null").where(X.clean_text(F.col("speaker_display")) != "")
    new = named.join(cards.select(F.col("entity_id").alias("speaker_entity_id")), "speaker_entity_id", "left_anti")
    return new.groupBy(F.col("speaker_entity_id").alias("entity_id")).agg(F.min_by("entity_type", F.struct("chunk", "speaker_display", "entity_type")).alias("entity_type"), F.min_by("speaker_display", F.struct("chunk", "speaker_display")).alias("display_name"), F.min("chunk").alias("first_chunk"))


def snapshot(cards: DataFrame, limit: int = 30) -> DataFrame:
    """The last cards created per volume; a limit of 0 keeps all."""
    newest = Window.partitionBy("volume_id").orderBy(F.desc("entity_id"))
    return cards if limit == 0 else cards.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def memories(windows: DataFrame, stored: DataFrame, radius: int = 0, most: int = 6) -> DataFrame:
    """`window_id, memory_id, chunk`: the memories of a scene nearest to where any dialogue of the window stands in it.

    windows: `window_id, scene_id, offset, length` (of the scene), one row per dialogue.
    stored: `scene_id, memory_id, chunk` from 1 on, and `chunks` if not all of a scene's
    chunks are there. A scene with one chunk, no estimate or no memory within the radius
    gives its first.
    """
    n = stored.groupBy("scene_id").agg((F.max("chunks") if "chunks" in stored.columns else F.count("*")).alias("chunks"))
    target = F.when(F.col("length") > 0, F.least(F.greatest(F.floor(F.col("offset") * F.col("chunks") / F.col("length")) + 1, F.lit(1)), F.col("chunks")))
    at = windows.join(n, "scene_id").groupBy("window_id", "scene_id", "chunks").agg(F.collect_set(target).alias("targets"))
    met = at.join(stored.select("scene_id", "memory_id", "chunk"), "scene_id")
    met = met.withColumn("far", F.when(F.col("chunks") > 1, F.array_min(F.transform("targets", lambda t: F.abs(F.col("chunk") - t)))))
    met = met.withColumn("near", F.col("far").isNull() | (F.col("far") <= radius))
    met = met.withColumn("some", F.bool_or("near").over(Window.partitionBy("window_id"))).where("near or not some")
    best = Window.partitionBy("window_id").orderBy(F.when(F.col("some"), F.col("far")), "chunk", "memory_id")
    return met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max(1, most)).select("window_id", "memory_id", "chunk")


def _dialogue_id(parsed: DataFrame) -> Column:
    """The id that `responses.by_dialogue` found, else the row's own."""
    return F.col("dialogue_id") if "dialogue_id" in parsed.columns else X.clean_text(F.try_variant_get("r", "$.dialogue_id", "string"))


def evidence(parsed: DataFrame) -> DataFrame:
    """Typed evidence of `request_id, r VARIANT`: markers and references as structs, lists cut and texts truncated."""
    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    cut = lambda k, n: F.transform(X.unique_strings(get(k, EMPTY), 8), lambda x: X.truncate(x, n))
    markers = F.slice(F.transform(F.coalesce(get("speech_markers", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.marker", "string"), F.try_variant_get(v, "$", "string")).alias("marker"), F.coalesce(F.try_variant_get(v, "$.owner_display", "string"), F.lit("")).alias("owner_display"))), 1, 8)
    return parsed.select("request_id", _dialogue_id(parsed).alias("dialogue_id"), cut("positive_evidence", 180).alias("positive_evidence"), cut("negative_evidence", 180).alias("negative_evidence"), cut("addressed_to", 120).alias("addressed_to"), markers.alias("speech_markers"),
                         F.coalesce(get("same_speaker_allowed", "boolean"), F.lit(False)).alias("same_speaker_allowed"), X.clean_text(get("turn_relation")).alias("turn_relation"), X.truncate(get("notes"), 180).alias("notes"))


def contradictions(parsed: DataFrame) -> DataFrame:
    """Checks of `request_id, r VARIANT`: severity none, weak or strong; only a strong one asks for review."""
    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    said = F.coalesce(get("has_contradiction", "boolean"), F.lit(False))
    named = F.lower(X.clean_text(get("severity")))
    severity = F.when(named.isin("none", "weak", "strong"), named).when(said, "strong").otherwise("weak")
    return parsed.select("request_id", _dialogue_id(parsed).alias("dialogue_id"), severity.alias("severity"), severity.isin("weak", "strong").alias("has_contradiction"), X.clean_text(get("reason")).alias("reason"), X.unique_strings(get("counter_evidence", EMPTY), 8).alias("counter"), (severity == "strong").alias("needs_review"))


def annotations(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per asked dialogue of the second reader, `unknown` where the answer has none.

    parsed: `request_id, pos, r VARIANT`; asked: `request_id, dialogue_id`.
    """
    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    rows = parsed.select("request_id", "pos", X.clean_text(get("dialogue_id")).alias("dialogue_id"), v2_status(F.coalesce(get("speaker_status"), get("status"))).alias("status"), X.clean_text(F.coalesce(get("speaker_entity_id"), get("entity_id"))).alias("entity"), X.clean_text(F.coalesce(get("speaker_display"), get("display_name"))).alias("display"),
                         X.clamp(F.coalesce(get("confidence", "double"), F.lit(0.0)), 0.0, 1.0).alias("confidence"), X.unique_strings(get("evidence", EMPTY), 6).alias("evidence"), X.unique_strings(get("negative_evidence", EMPTY), 4).alias("negative_evidence"), F.coalesce(get("is_backfillable", "boolean"), F.lit(False)).alias("is_backfillable"))
    last = rows.groupBy("request_id", "dialogue_id").agg(F.max_by(F.struct("status", "entity", "display", "confidence", "evidence", "negative_evidence", "is_backfillable"), "pos").alias("x"))
    met = asked.join(last, ["request_id", "dialogue_id"], "left")
    status = F.coalesce("x.status", F.lit("unknown"))
    display = F.coalesce(F.nullif("x.display", F.lit("")), F.when(status == "unknown", "未知").when(status == "review", "待复核").otherwise(status))
    entity = F.coalesce(F.nullif("x.entity", F.lit("")), F.when(status.isin("unknown", "review"), status).when(F.coalesce("x.display", F.lit("")) == "", status).otherwise(F.concat(status, F.lit(":"), X.slug(display))))
    return met.select("request_id", "dialogue_id", entity.alias("speaker_entity_id"), display.alias("speaker_display"), status.alias("speaker_status"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), texts("x.evidence").alias("evidence"), texts("x.negative_evidence").alias("negative_evidence"), F.coalesce("x.is_backfillable", status == "unknown").alias("is_backfillable"), status.isin("unknown", "review").alias("needs_review"))


def repairs(parsed: DataFrame, current: DataFrame) -> DataFrame:
    """Repairs of dialogues that have an annotation: `dialogue_id, pos, stop_reason, speaker_*, confidence`."""
    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    rows = parsed.select("pos", X.clean_text(get("dialogue_id")).alias("dialogue_id"), F.coalesce(F.nullif(X.clean_text(get("stop_reason")), F.lit("")), F.lit("unchanged")).alias("stop_reason"), X.clean_text(F.coalesce(get("new_speaker_entity_id"), get("speaker_entity_id"))).alias("speaker_entity_id"), X.clean_text(get("speaker_display")).alias("speaker_display"), v2_status(get("speaker_status")).alias("speaker_status"), X.clamp(F.coalesce(get("confidence", "double"), F.lit(0.0)), 0.0, 1.0).alias("confidence"))
    return rows.join(current.select("dialogue_id"), "dialogue_id", "left_semi")


def repair_trace(before: DataFrame, after: DataFrame, checks: DataFrame) -> DataFrame:
    """`dialogue_id, trigger_reason, counter, initial, repaired, resolved, stop_reason` of strongly contradicted dialogues.

    before, after: `dialogue_id, speaker_entity_id, needs_review` (after may lack rows).
    """
    strong = checks.where("severity = 'strong'").groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("reason", "counter"))).alias("c"))
    met = strong.join(before.select("dialogue_id", F.col("speaker_entity_id").alias("initial")), "dialogue_id").join(after.select("dialogue_id", F.col("speaker_entity_id").alias("repaired"), F.col("needs_review").alias("r")), "dialogue_id", "left")
    stop = F.when(F.col("repaired").isNull(), "missing_response").when(F.col("r"), "needs_review").when(F.col("repaired") == F.col("initial"), "unchanged").otherwise("resolved")
    return met.select("dialogue_id", F.array_join(X.unique_strings(F.transform("c", lambda x: x["reason"]), 3), "; ").alias("trigger_reason"), X.unique_strings(F.flatten(F.transform("c", lambda x: texts(x["counter"]))), 4).alias("counter"), "initial", "repaired", (stop == "resolved").alias("resolved"), stop.alias("stop_reason"))


def facts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last summary per volume, and all facts, appended: `volume_id, chunk, fact_type, text` for `volume_id, chunk, v VARIANT`."""
    said = X.truncate(F.try_variant_get("v", "$.summary", "string"), 900)
    last = answers.withColumn("_s", said).where("_s <> ''").groupBy("volume_id").agg(F.max_by("_s", "chunk").alias("summary"))
    rows = None
    for kind in ("new_facts", "retained_facts"):
        part = answers.select("volume_id", "chunk", F.lit(kind).alias("fact_type"), F.explode(X.unique_strings(F.try_variant_get("v", f"$.{kind}", EMPTY))).alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    return last, rows


def chunk_summaries(answers: DataFrame) -> DataFrame:
    """`chunk_id, summary, active_entities, open_questions, evidence_refs` for `chunk_id, v VARIANT`."""
    items = lambda k, n: X.unique_strings(F.try_variant_get("v", f"$.{k}", EMPTY), n)
    return answers.select("chunk_id", X.truncate(F.try_variant_get("v", "$.summary", "string"), 700).alias("summary"), items("active_entities", 24).alias("active_entities"), items("open_questions", 12).alias("open_questions"), items("evidence_refs", 24).alias("evidence_refs"))


def resolutions(answers: DataFrame, pending: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pending rows after a model's resolution: `entity_id, last_checked, expired, reason` for `chunk, v VARIANT`."""
    keep = answers.select("chunk", F.explode(X.unique_strings(F.try_variant_get("v", "$.keep_pending", EMPTY))).alias("id"), F.lit(None).cast("string").alias("reason"))
    drop = answers.select("chunk", F.explode(F.coalesce(F.try_variant_get("v", "$.expire_pending", "array<variant>"), F.try_variant_get("v", "$.expired_pending", "array<variant>"))).alias("r"))
    drop = drop.select("chunk", X.clean_text(F.try_variant_get("r", "$.entity_id", "string")).alias("id"), F.coalesce(F.nullif(X.clean_text(F.try_variant_get("r", "$.reason", "string")), F.lit("")), F.lit("expired_by_model")).alias("reason"))
    both = keep.unionByName(drop).join(resolved.select(F.col("node").alias("id"), "resolved"), "id", "left").withColumn("entity_id", F.coalesce("resolved", "id"))
    said = both.groupBy("entity_id").agg(F.max(F.when(F.col("reason").isNull(), F.col("chunk"))).alias("last_checked"), F.min(F.when(F.col("reason").isNotNull(), F.struct("chunk", "reason"))).alias("e"))
    return pending.select("entity_id").join(said, "entity_id", "left").select("entity_id", "last_checked", F.col("e").isNotNull().alias("expired"), F.col("e.reason").alias("reason"))


def events(*parts: DataFrame) -> DataFrame:
    """The event log: typed rows of any columns, appended; order by chunk and type."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def weights(models: DataFrame, given: DataFrame) -> DataFrame:
    """`role, model, weight`: the weight given for role and model, else for the model, else 1.

    models: `role, model`; given: `role, model, weight` with a null role for a model in general.
    """
    own = given.where("role is not null").select("role", "model", F.col("weight").alias("w1"))
    general = given.where("role is null").select("model", F.col("weight").alias("w2"))
    return models.join(own, ["role", "model"], "left").join(general, "model", "left").select("role", "model", F.coalesce("w1", "w2", F.lit(1.0)).alias("weight"))


def paragraph_cards(paragraphs: DataFrame, dialogues: DataFrame, most: int = 360) -> DataFrame:
    """`paragraph_id, text, dialogue_ids`: what a prompt shows of a paragraph; no quotes give an empty list."""
    ids = dialogues.groupBy("paragraph_id").agg(F.array_sort(F.collect_set("dialogue_id")).alias("d"))
    return paragraphs.join(ids, "paragraph_id", "left").select("paragraph_id", X.truncate(F.col("text"), most).alias("text"), texts("d").alias("dialogue_ids"))
