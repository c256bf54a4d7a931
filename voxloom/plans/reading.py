"""The second reader over stored answers: chunks in order, seven tasks a chunk, an entity memory that grows.

The loop of a reader that asks a model is here a chain of stages over all chunks at once,
as the answers are there: what a chunk leaves to the next ones is an ordered aggregate
(cards, summaries), a fold over few ids (merges), or, for the set of pending mysteries,
state that runs along the chunks of a volume (`pending_timeline`). The prompts of every
task are written with the memory as it was before the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import entities as E
from voxloom.operators import reader as N
from voxloom.operators import responses as J
from voxloom.operators import votes as V
from voxloom.operators import windows as W
from voxloom.operators.graph import resolve_aliases
from voxloom.plans.pipeline import asked_of
from voxloom.sources.scratch import Scratch

TASKS = ("annotation", "chunk_summary", "entity_discovery", "entity_update", "global_summary", "mystery_resolution", "repair")
TARGET_TOKENS, HARD_TOKENS = 24_000, 30_000
INSTRUCTIONS = {
    "annotation": "判断本段每一句对白由谁说出，按 annotations 列表回答 JSON。",
    "chunk_summary": "概括本段，回答 JSON：summary、active_entities、open_questions、evidence_refs。",
    "entity_discovery": "列出本段新出现的人物、谜团和群体（entities）以及同一人物的合并（merges），回答 JSON。",
    "entity_update": "更新已知实体，按 updates 列表回答 JSON。",
    "global_summary": "更新全卷概要，回答 JSON：summary、new_facts、retained_facts。",
    "mystery_resolution": "判断待定的谜团：合并（merges）、保留（keep_pending）或放弃（expire_pending），回答 JSON。",
    "repair": "重新判断尚未确定的对白，按 repairs 列表回答 JSON。",
}
ROWS = {
    "annotation": ("annotations", "dialogues", "items"), "entity_discovery": ("new_entities", "entities", "items"), "entity_update": ("updates", "entities", "items"),
    "merges": ("merge_candidates", "merges"), "repair": ("repairs", "items"),
}


def listed(v: Column, keys: tuple[str, ...]) -> Column:
    """The first key that holds a list, else nothing."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys], F.array().cast("array<variant>"))


def with_ids(found: DataFrame) -> DataFrame:
    """Discovered rows with an id: the given one, else that of the first row of the volume and type with the same name, else a new number.

    found: `volume_id, chunk, pos, entity_id, entity_type, display_name, ...`. New ids are
    counted by type in order of their first row.
    """
    t = found.withColumn("entity_type", N.entity_type(F.col("entity_type"))).withColumn("display_name", X.clean_text(F.col("display_name"))).where("entity_type <> '' and display_name <> ''")
    t = t.withColumn("entity_id", F.nullif(X.clean_text(F.col("entity_id")), F.lit("")))
    key = ["volume_id", "entity_type", "display_name"]
    at = F.struct("chunk", "pos")
    names = t.groupBy(*key).agg(F.min_by("entity_id", F.when(F.col("entity_id").isNotNull(), at)).alias("_given"), F.min(at).alias("_first"))
    new = names.where("_given is null").withColumn("_n", F.row_number().over(Window.partitionBy("volume_id", "entity_type").orderBy("_first", "display_name")))
    prefix = F.when(F.col("entity_type") == "character", "char").otherwise(F.col("entity_type"))
    number = F.when(F.col("_n") > 999999, F.col("_n").cast("string")).otherwise(F.lpad(F.col("_n").cast("string"), 6, "0"))
    new = new.select(*key, F.concat("volume_id", F.lit(":"), prefix, F.lit("_v2_"), number).alias("_new"))
    met = t.join(names.select(*key, "_given"), key).join(new, key, "left")
    return met.withColumn("entity_id", F.coalesce("entity_id", "_given", "_new")).drop("_given", "_new")


def updates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Updates of entities that were discovered in the same or an earlier chunk; the rest change nothing.

    rows: `volume_id, chunk, pos, entity_id, ...`; known: `volume_id, entity_id, first_chunk, entity_type`.
    """
    return rows.join(known, ["volume_id", "entity_id"]).where("chunk >= first_chunk").drop("first_chunk")


PENDING = "volume_id string, chunk int, entity_id string, event string, reason string, rank int"


def pending_timeline(signs: DataFrame, limit: int = E.MAX_PENDING, ttl: int = E.TTL_CHUNKS) -> DataFrame:
    """Pending mysteries along the chunks: events `added`, `evicted`, `expired`, `merged`, and the ranked set (`pending`) after each chunk.

    signs: `volume_id, chunk, pos, entity_id, sign, level, reason`; sign is `seen` (level:
    importance from 0), `merged`, `dropped`, `kept` or, once per chunk, `end`. A mystery of
    importance 0 isn't pending; the best `limit` by importance and latest chunk are kept
    (0: all are kept, none is listed); one that is pending for ttl chunks expires (0:
    never), and so does one that a resolution drops; seen again, it is added anew.

    The rows of a volume come sorted to one task, which holds one small entry per pending
    mystery and never the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        volume, held = None, {}
        for rows in batches:
            out: list[tuple] = []
            for v, chunk, entity, sign, level, reason in zip(rows.volume_id, rows.chunk, rows.entity_id, rows.sign, rows.level, rows.reason):
                if v != volume:
                    volume, held = v, {}
                if sign == "seen":
                    if entity in held:
                        held[entity][:2] = [max(held[entity][0], level), chunk]
                    elif level > 0:
                        held[entity] = [level, chunk, chunk]
                        out.append((v, chunk, entity, "added", None, None))
                elif sign in ("merged", "dropped"):
                    if held.pop(entity, None):
                        out.append((v, chunk, entity, "merged" if sign == "merged" else "expired", reason, None))
                elif sign == "end":
                    best = sorted(held, key=lambda e: (-held[e][0], -held[e][1], e))
                    if limit:
                        out += [(v, chunk, e, "evicted", None, None) for e in best[limit:]]
                        for e in best[limit:]:
                            del held[e]
                    for e in [e for e in best[: limit or None] if ttl and chunk - held[e][2] >= ttl]:
                        out.append((v, chunk, e, "expired", "ttl", None))
                        del held[e]
                    left = [e for e in best if e in held][:limit]
                    out += [(v, chunk, e, "pending", None, k) for k, e in enumerate(left)]
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in PENDING.split(", ")])
            yield frame.astype({"chunk": "int32", "rank": "Int32"})

    step = F.when(F.col("sign") == "seen", 0).when(F.col("sign") == "merged", 1).when(F.col("sign") == "end", 3).otherwise(2)
    rows = signs.withColumn("_s", step).withColumn("level", F.coalesce("level", F.lit(0)))
    return rows.repartition("volume_id").sortWithinPartitions("volume_id", "chunk", "_s", "pos", "entity_id").mapInPandas(run, PENDING)


def memory_before(chunks: DataFrame, cards: DataFrame, summaries: DataFrame, globals_: DataFrame) -> DataFrame:
    """`chunk_id, previous_summary, global_summary, candidates`: what the reader knows when it comes to a chunk.

    chunks: `volume_id, chunk, chunk_id`; cards: `volume_id, entity_id, chunk, display_name,
    level`, a row per sighting. Candidates are the entities of the last chunks before,
    the most important first.
    """
    before = Window.partitionBy("volume_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = chunks.join(summaries.select("chunk_id", "summary"), "chunk_id", "left").join(globals_, ["volume_id", "chunk"], "left")
    known = known.withColumn("previous_summary", F.last("summary", True).over(before)).withColumn("global_summary", F.last("said", True).over(before))
    # the entities a chunk saw, as candidates of the twelve chunks after it
    after = cards.withColumn("for", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunk") + E.TTL_CHUNKS)))
    best = after.groupBy("volume_id", "for", "entity_id").agg(F.max("level").alias("level"), F.max("chunk").alias("latest"), F.max_by("display_name", "chunk").alias("display_name"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("volume_id", "for").orderBy(F.desc("level"), F.desc("latest"), "entity_id"))).where(F.col("rank") <= E.MAX_CANDIDATES)
    shown = ranked.groupBy("volume_id", F.col("for").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "display_name"))).alias("candidates"))
    return known.join(shown, ["volume_id", "chunk"], "left").select("chunk_id", "previous_summary", "global_summary", "candidates")


def annotate(paragraphs: DataFrame, dialogues: DataFrame, responses: DataFrame, model: str, start: int = 0, limit: int | None = None) -> dict[str, DataFrame]:
    """Stored answers of the seven tasks to annotations, the entity store, pending mysteries, facts, events, prompts and failures.

    responses: `request_id, raw, pos`; request ids are `chunk--task--model`. A prompt over
    HARD_TOKENS is a failure and its answer isn't read. A chunk without dialogues has no
    annotation and no repair, and none at all if it tells nothing.
    """
    spark = paragraphs.sparkSession
    scratch = Scratch(spark)
    spoken = dialogues.groupBy("paragraph_id").agg(F.count("*").cast("int").alias("n_dialogues"))
    counted = paragraphs.join(spoken, "paragraph_id", "left").fillna(0, ["n_dialogues"])
    placed = W.select_chunks(W.reading_chunks(counted), start, limit).join(counted.select("paragraph_id", "text", "chapter_index", "n_dialogues"), "paragraph_id")
    placed = scratch.save(placed, "placed")
    told = W.non_narrative(placed).where("not non_narrative").select("chunk_id")
    chunks = placed.groupBy("volume_id", "chunk_id", F.col("chunk_index").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "paragraph_id", X.truncate(F.col("text"), 360).alias("text")))).alias("paragraphs"), F.sum("n_dialogues").alias("spoken")
    )
    chunks = scratch.save(chunks.join(told, "chunk_id"), "chunks")
    of_chunk = dialogues.select("dialogue_id", "paragraph_id").join(placed.select("paragraph_id", "chunk_id"), "paragraph_id").select("chunk_id", "dialogue_id")
    one = spark.createDataFrame([(model,)], "model string")
    asked = None
    for task in TASKS:
        of = chunks.where("spoken > 0") if task in ("annotation", "repair") else chunks
        part = of.select(F.concat_ws("--", "chunk_id", F.lit(task), X.safe_model(F.lit(model))).alias("request_id"), "volume_id", "chunk_id", "chunk", F.lit(task).alias("task"))
        asked = part if asked is None else asked.unionByName(part)
    hit, missing = J.replay(asked, responses)
    answers = scratch.save(hit.select("request_id", "volume_id", "chunk_id", "chunk", "task", J.parse_json(F.col("raw")).alias("v")), "answers")

    def of_task(task: str) -> DataFrame:
        return answers.where((F.col("task") == task) & F.col("v").isNotNull())

    def rows_of(task: str, keys: tuple[str, ...]) -> DataFrame:
        return of_task(task).select("request_id", "volume_id", "chunk_id", "chunk", F.posexplode(listed(F.col("v"), keys)).alias("pos", "r"))

    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    delta = F.coalesce(get("dialogue_count_delta", "double"), F.lit(0.0)).cast("int").alias("delta")
    found = rows_of("entity_discovery", ROWS["entity_discovery"]).select(
        "volume_id", "chunk", "pos", get("entity_id").alias("entity_id"), get("entity_type").alias("entity_type"), F.coalesce(get("display_name"), get("speaker_display")).alias("display_name"),
        get("aliases", N.EMPTY).alias("aliases"), get("importance").alias("importance"), get("summary").alias("summary"), get("evidence_refs", N.EMPTY).alias("evidence"), delta,
    )
    found = scratch.save(with_ids(found), "found")
    asked_for = asked.where("task = 'annotation'").join(of_chunk, "chunk_id").select("request_id", "dialogue_id")
    read = N.annotations(rows_of("annotation", ROWS["annotation"]).select("request_id", "pos", "r"), asked_for)
    first = scratch.save(read.join(asked.select("request_id", "volume_id", "chunk"), "request_id"), "annotations-0")

    known = found.groupBy("volume_id", "entity_id").agg(F.min("chunk").alias("first_chunk"), F.min_by("entity_type", F.struct("chunk", "pos")).alias("entity_type"))
    new = updates(rows_of("entity_update", ROWS["entity_update"]).withColumn("entity_id", X.clean_text(get("entity_id"))), known)
    none = F.lit(None).cast("string")
    changed = new.select("volume_id", "entity_id", "chunk", (F.col("pos") + 100_000).alias("pos"), "entity_type", none.alias("display_name"), F.array().cast(N.EMPTY).alias("aliases"), get("importance").alias("importance"), get("summary").alias("summary"), get("evidence_refs", N.EMPTY).alias("evidence"), delta)
    named = N.ensure_entities(found.select("entity_id"), first).join(first.groupBy(F.col("speaker_entity_id").alias("entity_id")).agg(F.min("volume_id").alias("volume_id")), "entity_id")
    named = named.select("volume_id", "entity_id", F.col("first_chunk").alias("chunk"), F.lit(-1).alias("pos"), "entity_type", "display_name", F.array().cast(N.EMPTY).alias("aliases"), F.lit("minor").alias("importance"), none.alias("summary"), F.array().cast(N.EMPTY).alias("evidence"), F.lit(0).alias("delta"))
    sightings = scratch.save(found.select(changed.columns).unionByName(changed).unionByName(named), "sightings")
    cards = N.entity_cards(sightings)
    cards = scratch.save(cards.withColumn("latest_seen_chunk_id", F.concat("volume_id", F.lit("-r"), F.col("latest_seen_chunk").cast("string"))), "cards-0")
    said_of = new.select("volume_id", "entity_id", "chunk", "pos", get("relationship_updates", N.EMPTY).alias("relationships"))
    relations = N.first_values(said_of, ["volume_id", "entity_id"], "relationships", ["chunk", "pos"], 20)

    steps = rows_of("entity_discovery", ROWS["merges"]).withColumn("step", F.lit(0)).unionByName(rows_of("mystery_resolution", ROWS["merges"]).withColumn("step", F.lit(1)))
    both = cards.select("entity_id")
    edges = steps.select(F.struct("volume_id", "chunk", "step", "pos").alias("order"), X.clean_text(get("source_entity_id")).alias("source_entity_id"), X.clean_text(get("target_entity_id")).alias("target_entity_id"), get("confidence", "double").alias("confidence"))
    edges = edges.join(both.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(both.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    # an id that sorts like the order of chunks, steps and rows
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    edges = edges.withColumn("edge_id", F.concat_ws("-", "order.volume_id", pad("order.chunk", 10), pad("order.step", 1), pad("order.pos", 8)))
    edges = scratch.save(edges, "edges")
    merged = scratch.save(E.merges(edges.drop("order")), "merges")
    resolved = scratch.save(resolve_aliases(merged), "resolved")
    store = E.merge_cards(cards, resolved, merged).join(relations.drop("volume_id"), "entity_id", "left")

    fixes = N.repairs(rows_of("repair", ROWS["repair"]).select("pos", "r"), first)
    final = E.apply_merges(V.apply_repairs(E.apply_merges(first, resolved, cards), fixes), resolved, cards)
    final = scratch.save(final, "annotations")

    mysteries = cards.where("entity_type = 'mystery'").select("entity_id")
    of_resolution = of_task("mystery_resolution")
    drop = of_resolution.select("volume_id", "chunk", F.posexplode(listed(F.col("v"), ("expire_pending", "expired_pending"))).alias("pos", "r")).select("volume_id", "chunk", "pos", X.clean_text(get("entity_id")).alias("entity_id"), F.lit("dropped").alias("sign"), F.lit(0).alias("level"), F.coalesce(F.nullif(X.clean_text(get("reason")), F.lit("")), F.lit("expired_by_model")).alias("reason"))
    seen = sightings.join(mysteries, "entity_id", "left_semi").select("volume_id", "chunk", F.col("pos").alias("pos"), "entity_id", F.lit("seen").alias("sign"), X.importance_level(F.col("importance")).alias("level"), none.alias("reason"))
    gone = merged.join(edges.select("edge_id", "order"), "edge_id").select("order.volume_id", "order.chunk", F.lit(0).alias("pos"), F.col("source").alias("entity_id"), F.lit("merged").alias("sign"), F.lit(0).alias("level"), F.col("target").alias("reason"))
    ends = chunks.select("volume_id", "chunk", F.lit(0).alias("pos"), F.lit("").alias("entity_id"), F.lit("end").alias("sign"), F.lit(0).alias("level"), none.alias("reason"))
    pending = scratch.save(pending_timeline(seen.unionByName(gone).unionByName(drop).unionByName(ends)), "pending")

    summaries = scratch.save(N.chunk_summaries(of_task("chunk_summary").select("chunk_id", "v")), "summaries")
    of_global = of_task("global_summary").select("volume_id", "chunk", "v")
    last, facts = N.facts(of_global)
    said = of_global.select("volume_id", "chunk", F.nullif(X.truncate(F.try_variant_get("v", "$.summary", "string"), 900), F.lit("")).alias("said"))
    memory = memory_before(chunks, sightings.select("volume_id", "entity_id", "chunk", "display_name", X.importance_level(F.col("importance")).alias("level")), summaries, said)
    lines = dialogues.join(of_chunk, "dialogue_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("dialogue_index", "dialogue_id", "text"))).alias("dialogues"))
    waiting = pending.where("event = 'pending'").join(chunks.select("volume_id", "chunk", "chunk_id"), ["volume_id", "chunk"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("pending_mysteries"))
    payload = chunks.select("chunk_id", "chunk", "spoken", "paragraphs").join(lines, "chunk_id", "left").join(memory, "chunk_id", "left")
    prompts = None
    for task in TASKS:
        own = payload.where("spoken > 0") if task in ("annotation", "repair") else payload
        own = own.join(waiting, "chunk_id") if task == "mystery_resolution" else own
        part = asked_of(own.drop("spoken"), one, "chunk_id", task, INSTRUCTIONS[task]).withColumn("task", F.lit(task))
        prompts = part if prompts is None else prompts.unionByName(part)
    prompts = prompts.withColumn("budget_status", X.budget_status(F.col("tokens"), TARGET_TOKENS, HARD_TOKENS))
    prompts = scratch.save(prompts, "prompts")
    over = prompts.where("budget_status = 'over_limit'").select("request_id", F.lit("PromptTooLong").alias("error_type"), F.concat(F.lit("estimated tokens: "), F.col("tokens").cast("string")).alias("error"))
    unread = answers.where("v is null").select("request_id", F.lit("JSONDecodeError").alias("error_type"), F.lit("the answer holds no JSON").alias("error"))
    event = lambda df, kind: df.withColumn("event_type", F.lit(kind))
    events = N.events(
        event(found.select("volume_id", "chunk", "entity_id", "entity_type", "display_name"), "entity_discovery"), event(new.select("volume_id", "chunk", "entity_id", "entity_type"), "entity_update"),
        event(gone.select("volume_id", "chunk", "entity_id", F.col("reason").alias("target_entity_id")), "entity_merge"),
        pending.where("event <> 'pending'").select("volume_id", "chunk", "entity_id", F.concat(F.lit("pending_mystery_"), "event").alias("event_type"), "reason"),
    )
    return {
        "prompts": prompts, "annotations": final, "review_queue": final.where("needs_review"), "entities": store, "merges": merged, "pending": pending, "chunk_summaries": summaries,
        "global_summary": last, "facts": facts, "events": events, "failures": missing.unionByName(unread).unionByName(over), "repairs": fixes,
    }
