"""The pipelines end to end: raw text to tables, stored answers to annotations, cards to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import candidates as C
from voxloom.operators import entities as E
from voxloom.operators import reader as N
from voxloom.operators import render as O
from voxloom.operators import responses as J
from voxloom.operators import rules as R
from voxloom.operators import segmentation as S
from voxloom.operators import votes as V
from voxloom.operators import windows as W
from voxloom.operators.running import running_total
from voxloom.sources.scratch import Scratch

INSTRUCTION = "判断每一句对白由谁说出。只用给出的候选人，按 annotations 列表回答 JSON，每句一项：dialogue_id、speaker_entity_id、speaker_display、speaker_status、confidence、evidence、needs_review。"


def preprocess(volumes: DataFrame, context: int = 3, cap: int = 80) -> dict[str, DataFrame]:
    """`paragraphs, chapters, scenes, dialogues, volumes` of `volume_id, text`."""
    scratch = Scratch(volumes.sparkSession)
    paragraphs = scratch.save(S.chapters_and_scenes(S.lines(volumes, "volume_id"), cap), "paragraphs")
    near = S.neighbours(paragraphs, "volume_id", "paragraph_index", "text", context, context)
    q = S.dialogues(paragraphs).join(paragraphs.drop("text", "is_structural").join(paragraphs.select("paragraph_id", F.col("text").alias("paragraph_text")), "paragraph_id"), "paragraph_id").join(near, ["volume_id", "paragraph_index"])
    q = running_total(q.withColumn("_o", F.col("paragraph_index") * 4096 + F.col("local_dialogue_index")).withColumn("_one", F.lit(1).cast("long")), ["volume_id"], "_o", "_one", "_n")
    struct = lambda c: F.transform(c, lambda x: F.struct(x.alias("text")))
    number = F.when(F.col("_n") > 999999, F.col("_n").cast("string")).otherwise(F.lpad(F.col("_n").cast("string"), 6, "0"))
    dialogues = q.select(
        F.concat("volume_id", F.lit("-d"), number).alias("dialogue_id"), (F.col("_n") - 1).cast("int").alias("dialogue_index"), "volume_id", "chapter_id", "chapter_index", "chapter_title", "scene_id", "scene_index", "paragraph_id", "paragraph_index",
        "local_dialogue_index", F.col("quote").alias("text"), "quote_text", "paragraph_text", "dialogue_kind", "char_start", "char_end", struct(F.col("prev")).alias("prev_context"), struct(F.col("next")).alias("next_context"),
    )
    dialogues = scratch.save(dialogues, "dialogues")
    return {"paragraphs": paragraphs, "dialogues": dialogues, "chapters": S.chapter_ranges(paragraphs), "scenes": S.scenes(paragraphs, dialogues), "volumes": S.volumes(paragraphs, dialogues)}


def requests(dialogues: DataFrame, cards: DataFrame, models: DataFrame, paragraphs: DataFrame | None = None, memories: DataFrame | None = None, mysteries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Requests with their prompts (one per window and model), windows, lines and options.

    models: `model, weight`, the few models of a run. The other tables as for `payloads`.
    """
    payload, windows, lines, options = payloads(dialogues, cards, paragraphs, memories, mysteries)
    return asked_of(payload, models, "window_id", "annotation", INSTRUCTION), windows, lines, options


def asked_of(payload: DataFrame, models: DataFrame, unit: str, task: str, instruction: str, first: bool = True) -> DataFrame:
    """`request_id, unit, model, prompt, tokens`: one request per row of the payload and model; all columns but the unit go into the prompt.

    first: the unit stands before the task in the id.
    """
    parts = [c for c in payload.columns if c != unit]
    body = payload.select(unit, F.concat(F.lit(instruction + "\n"), F.to_json(F.struct(*parts), {"pretty": "true"})).alias("prompt"))
    every = body.withColumn("model", F.explode(F.array(*[F.lit(r.model) for r in models.orderBy("model").collect()])))  # a row per model of the run
    name = (unit, F.lit(task)) if first else (F.lit(task), unit)
    return every.select(F.concat_ws("--", *name, X.safe_model(F.col("model"))).alias("request_id"), unit, "model", "prompt", X.estimate_tokens(F.col("prompt")).alias("tokens"))


def payloads(dialogues: DataFrame, cards: DataFrame, paragraphs: DataFrame | None = None, memories: DataFrame | None = None, mysteries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a prompt shows of every window, one list per column; windows, lines and options.

    paragraphs give the context of a window. memories: `scene_id, parent_scene_id,
    chunk_index, chunk_count, scene_summary, active_characters, relationships, notes`.
    mysteries: `mystery_id, volume_id, name, scene_id, description, evidence, confidence`.
    What isn't given is left out.
    """
    scratch = Scratch(dialogues.sparkSession)
    windows = W.dialogue_windows(dialogues)
    lines = scratch.save(R.lines(windows), "lines")
    place = windows.select("window_id", "volume_id", "scene_id").distinct()
    context = lines.join(windows.select("dialogue_id", "scene_id"), "dialogue_id").select("window_id", "volume_id", "scene_id", F.col("context").alias("text"), F.array("dialogue_id").alias("ids"))
    parts, active = {}, None
    if paragraphs is not None:
        near = W.window_context(windows, paragraphs).join(paragraphs.select("paragraph_id", "paragraph_index", "text"), "paragraph_id")
        context = context.unionByName(near.join(place, "window_id").select("window_id", "volume_id", "scene_id", "text", F.array("paragraph_id").alias("ids")))
        own = windows.groupBy("window_id", "paragraph_id").agg(F.array_sort(F.collect_list("dialogue_id")).alias("own"))
        shown = near.join(own, ["window_id", "paragraph_id"], "left").select("window_id", "paragraph_index", "paragraph_id", X.truncate(F.col("text"), 360).alias("text"), N.texts("own").alias("target_dialogue_ids"))
        parts["paragraphs"] = _listed(shown, ["paragraph_index", "paragraph_id", "text", "target_dialogue_ids"], "paragraphs")
    if memories is not None:
        m = scratch.save(memories.withColumn("_s", F.coalesce("parent_scene_id", "scene_id")).withColumn("_c", F.coalesce(F.col("chunk_index").cast("int"), F.lit(0))).where("_s is not null"), "memories")
        if paragraphs is not None:
            size = paragraphs.groupBy("scene_id").agg(F.min("paragraph_index").alias("lo"), (F.max("paragraph_index") - F.min("paragraph_index") + 1).alias("length"))
        else:
            size = place.select("scene_id", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("length")).distinct()
        at = windows.join(size, "scene_id", "left").select("window_id", "scene_id", F.least(F.greatest(F.col("paragraph_index") - F.col("lo"), F.lit(0)), F.col("length") - 1).alias("offset"), "length")
        stored = m.select(F.col("_s").alias("scene_id"), F.col("scene_id").alias("memory_id"), F.col("_c").alias("chunk"), F.coalesce(F.col("chunk_count").cast("long"), F.lit(0)).alias("chunks"))
        picked = N.memories(at, stored).select("window_id", F.col("memory_id").alias("scene_id"), F.col("chunk").alias("_c"))
        chosen = scratch.save(picked.join(m, ["scene_id", "_c"]).select("window_id", F.col("_c").alias("chunk_index"), "scene_id", "parent_scene_id", "chunk_count", X.truncate(F.col("scene_summary"), 260).alias("scene_summary"), N.texts("active_characters").alias("_a"), X.unique_strings(N.texts("active_characters"), 12).alias("active_characters"), X.unique_strings(N.texts("relationships"), 6).alias("relationships"), X.truncate(F.col("notes"), 160).alias("notes")), "chosen")
        active = chosen.select("window_id", F.explode("_a").alias("name")).select("window_id", X.clean_text(F.col("name")).alias("name")).where("name <> ''")
        parts["scene_memory"] = _listed(chosen, ["chunk_index", "scene_id", "parent_scene_id", "chunk_count", "scene_summary", "active_characters", "relationships", "notes"], "scene_memory")
    context = scratch.save(context, "context")
    options = scratch.save(C.score_characters(context, cards, active).join(C.speaker_options(cards), "entity_id").select("window_id", "rank", "entity_id", "display", "names", "markers"), "options")
    parts["dialogues"] = lines.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("window_pos", "dialogue_id", "text", F.array_join("narration", "\n").alias("around")))).alias("dialogues"))
    parts["candidates"] = _listed(options, ["rank", "entity_id", "display", "names"], "candidates")
    if mysteries is not None:
        card = mysteries.select("mystery_id", "name", X.truncate(F.col("description"), 240).alias("description"), X.unique_strings(N.texts("evidence"), 8).alias("evidence"), F.col("scene_id").alias("source_scene_id"), X.safe_double(F.col("confidence"), 0.5).alias("confidence"))
        found = C.score_mysteries(context, mysteries).join(card, "mystery_id")
        parts["mysteries"] = _listed(found, ["rank", "mystery_id", "name", "description", "evidence", "source_scene_id", "confidence"], "mysteries")
    payload = parts["dialogues"]
    for name in (given := [x for x in ("paragraphs", "scene_memory", "candidates", "mysteries") if x in parts]):
        payload = payload.join(parts[name], "window_id", "left")
    return payload.select("window_id", "dialogues", *given), windows, lines, options


def _listed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """`window_id` and the rows of each window as one list, ordered by the columns."""
    return rows.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def annotate(dialogues: DataFrame, paragraphs: DataFrame, cards: DataFrame, models: DataFrame, responses: DataFrame, anchored: bool = True, memories: DataFrame | None = None, mysteries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stored answers and rules to one speaker per dialogue, the review queue, labeled text and failures.

    responses: `request_id, raw, pos`. A missing or unreadable answer is a failure row; its
    dialogues still get the votes of the rules.
    """
    scratch = Scratch(dialogues.sparkSession)
    asked, windows, lines, options = requests(dialogues, cards, models, paragraphs, memories, mysteries)
    asked = scratch.save(asked, "requests")
    hit, missing = J.replay(asked.select("request_id", "model"), responses)
    parsed = hit.select("request_id", "model", J.parse_json(F.col("raw")).alias("v"))
    unread = parsed.where("v is null").select("request_id", F.lit("JSONDecodeError").alias("error_type"), F.lit("the answer holds no JSON").alias("error"))
    of = asked.select("request_id", "window_id").join(lines.select("window_id", "dialogue_id"), "window_id").select("request_id", "dialogue_id")
    given = J.votes(parsed.where("v is not null"), of, models.select("model", "weight"))
    ruled = R.rule_votes(lines, options, W.alternation_segments(windows))
    votes = given.withColumn("pos", F.lit(0)).unionByName(ruled.withColumn("evidence", F.array(F.concat(F.lit("规则："), F.col("rule")))).drop("rule").withColumn("needs_review", F.lit(False)).withColumn("pos", F.lit(1)))
    order = F.row_number().over(Window.partitionBy("dialogue_id").orderBy("pos", "model"))
    votes = scratch.save(votes.withColumn("pos", order), "votes")
    context = lines.select("dialogue_id", "text", F.col("kind").alias("dialogue_kind"), F.col("narration").alias("context"))
    found = scratch.save(V.aggregate_votes(context, votes, anchored), "annotations")
    at = dialogues.select("dialogue_id", "paragraph_id", "char_start", "dialogue_kind")
    labels = found.join(at, "dialogue_id").select("paragraph_id", "char_start", O.label(F.col("dialogue_kind"), F.col("needs_review"), F.col("speaker_status"), F.col("speaker_display")).alias("label"))
    return {"requests": asked, "votes": votes, "annotations": found, "review_queue": found.where("needs_review"), "labeled": O.labeled_text(paragraphs, labels), "failures": missing.unionByName(unread), "summary": O.run_summary(found)}


DISCOVERY = "列出这一场景里新出现的人物（characters）、身份成谜者（mysteries）和场景概要（scene_memory），回答 JSON。"
KNOWN_NAMES = 30


def discovery(paragraphs: DataFrame, dialogues: DataFrame, responses: DataFrame, model: str) -> dict[str, DataFrame]:
    """Discovery over stored answers: requests with the names known before, the character store, mysteries, scene memories and failures.

    Scenes are packed into jobs in order; responses: `request_id, raw, pos` with ids
    `job--discovery--model`. A missing or unreadable answer is a failure, the rest goes on.
    """
    spark = paragraphs.sparkSession
    scratch = Scratch(spark)
    spoken = dialogues.groupBy("paragraph_id").agg(F.count("*").cast("int").alias("n_dialogues"))
    jobs = W.pack_requests(paragraphs.join(spoken, "paragraph_id", "left").fillna(0, ["n_dialogues"]))
    jobs = scratch.save(jobs.join(paragraphs.select("paragraph_id", "volume_id", "paragraph_index", "text"), "paragraph_id"), "jobs")
    one = jobs.groupBy(F.col("request_id").alias("job"), "scene_id", "volume_id").agg(
        F.min("paragraph_index").alias("seq"), F.array_sort(F.collect_list(F.struct("pos", "paragraph_id", "text"))).alias("paragraphs")
    )
    lines = jobs.select(F.col("request_id").alias("job"), "paragraph_id").join(dialogues.select("dialogue_id", "paragraph_id", F.col("text").alias("line")), "paragraph_id")
    lines = lines.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("dialogue_id", "paragraph_id", F.col("line").alias("text")))).alias("dialogues"))
    one = scratch.save(one.join(lines, "job", "left").withColumn("request_id", F.concat_ws("--", "job", F.lit("discovery"), X.safe_model(F.lit(model)))), "one")
    hit, missing = J.replay(one.select("request_id", "job", "scene_id", "volume_id", "seq"), responses)
    parsed = scratch.save(hit.withColumn("v", J.parse_json(F.col("raw"))), "parsed")
    unread = parsed.where("v is null").select("request_id", F.lit("JSONDecodeError").alias("error_type"), F.lit("the answer holds no JSON").alias("error"))
    read = parsed.where("v is not null")

    listed = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "array<variant>"), F.array().cast("array<variant>"))
    names = X.unique_strings(F.transform(listed("characters"), lambda c: F.coalesce(F.try_variant_get(c, "$.display_name", "string"), F.try_variant_get(c, "$.name", "string"))))
    before = Window.partitionBy("volume_id").orderBy("seq", "job").rowsBetween(-KNOWN_NAMES, -1)
    found = one.select("request_id", "job", "volume_id", "seq").join(read.select("request_id", names.alias("n")), "request_id", "left")
    known = found.select("request_id", F.array_distinct(F.flatten(F.collect_list("n").over(before))).alias("known_characters"))
    payload = one.select("request_id", "job", "scene_id", "paragraphs", "dialogues").join(known, "request_id").drop("request_id")
    asked = asked_of(payload, spark.createDataFrame([(model,)], "model string"), "job", "discovery", DISCOVERY)
    mysteries = J.discovered_mysteries(read.select("scene_id", F.explode(listed("mysteries")).alias("r")))
    memories = read.select(
        F.col("job").alias("scene_id"), F.col("scene_id").alias("parent_scene_id"), X.truncate(F.try_variant_get("v", "$.scene_memory.scene_summary", "string"), 900).alias("scene_summary"),
        X.unique_strings(F.try_variant_get("v", "$.scene_memory.active_characters", "array<string>")).alias("active_characters"),
        X.unique_strings(F.try_variant_get("v", "$.scene_memory.relationships", "array<string>")).alias("relationships"), X.clean_text(F.try_variant_get("v", "$.scene_memory.notes", "string")).alias("notes"),
    )
    store = discover(hit.select(F.col("job").alias("request_id"), "volume_id", "seq", "raw"))
    return {"requests": asked, "characters": store, "mysteries": mysteries, "scene_memories": memories, "failures": missing.unionByName(unread)}


def discover(answers: DataFrame) -> DataFrame:
    """The character store after the answers of all requests: `request_id, volume_id, seq, raw`."""
    parsed = answers.select("request_id", "volume_id", "seq", J.parse_json(F.col("raw")).alias("v")).where("v is not null")
    each = parsed.select("request_id", "volume_id", "seq", F.posexplode(J.first_list(F.col("v"), ("characters", "new_characters", "entities"))).alias("pos", "r"))
    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    cards = each.select(
        F.concat_ws("#", "request_id", F.lpad(F.col("pos").cast("string"), 4, "0")).alias("entity_id"), "volume_id", "seq", F.coalesce(get("display_name"), get("name")).alias("display_name"), get("aliases", "array<string>").alias("aliases"),
        get("titles", "array<string>").alias("titles"), get("speech_markers", "array<string>").alias("speech_markers"), get("confidence", "double").alias("confidence"), X.parent_scene(F.col("request_id")).alias("first_seen_scene_id"),
    )
    return E.upsert_characters(cards)
