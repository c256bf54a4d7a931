"""Model answers: replay from a table, lenient parsing, and votes in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X

LISTS = ("annotations", "votes", "dialogues", "results")
DISPLAY = {"ambiguous": "ambiguous", "review": "待复核"}


def replay(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their stored `raw` answer, and failure rows for the others. A request stored twice keeps its last answer."""
    last = responses.groupBy("request_id").agg(F.max_by("raw", F.struct("pos", "raw")).alias("raw"))
    hit = requests.join(last, "request_id")
    miss = requests.join(last, "request_id", "left_anti").select("request_id", F.lit("CacheMiss").alias("error_type"), F.lit("no stored answer").alias("error"))
    return hit, miss


def join_stream(lines: DataFrame) -> DataFrame:
    """`request_id, raw, error`: the `response` parts of an NDJSON stream joined in order up to the first `done`; blank lines are skipped.

    lines: `request_id, pos, line`. An `error` object gives a row with the error.
    """
    parsed = lines.where(F.trim("line") != "").select("request_id", "pos", F.from_json("line", "response string, done boolean, error string").alias("j"))
    parsed = parsed.withColumn("_d", F.coalesce(F.max(F.coalesce("j.done", F.lit(False)).cast("int")).over(Window.partitionBy("request_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_d = 0")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("j.response", F.lit("")).alias("r"))))
    return parsed.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x["r"]), "").alias("raw"), F.min_by("j.error", F.when(F.col("j.error").isNotNull(), F.col("pos"))).alias("error"))


def parse_json(raw: Column) -> Column:
    """VARIANT of an answer: outer fence removed, else the text from the first { to the last }; null if neither parses."""
    bare = X.strip(raw)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(F.try_parse_json(inner), F.try_parse_json(F.regexp_extract(inner, r"(?s)\{.*\}", 0)))


def first_list(v: Column, keys: tuple[str, ...] = LISTS) -> Column:
    """The value itself if it is a list, else the first key that holds one, else the object as the only element."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys], F.array(v))


def by_dialogue(parsed: DataFrame, asked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`request_id, dialogue_id, r VARIANT`: the last row of each asked dialogue, an empty object where the answer has none.

    parsed: `request_id, v VARIANT`; asked: `request_id, dialogue_id`. The rows are the
    answer's list, or the first of the keys that holds one; an answer without ids belongs
    to the only dialogue of its request.
    """
    each = parsed.select("request_id", F.posexplode(first_list(F.col("v"), keys)).alias("pos", "r"))
    only = asked.groupBy("request_id").agg(F.count("*").alias("_n"), F.min("dialogue_id").alias("_only"))
    said = F.nullif(X.clean_text(F.try_variant_get("r", "$.dialogue_id", "string")), F.lit(""))
    each = each.join(only, "request_id").withColumn("dialogue_id", F.coalesce(said, F.when(F.col("_n") == 1, F.col("_only"))))
    # a variant has no order, so the position picks the row as text
    last = each.where("dialogue_id is not null").groupBy("request_id", "dialogue_id").agg(F.max_by(F.to_json("r"), "pos").alias("j"))
    met = asked.join(parsed.select("request_id").distinct(), "request_id", "left_semi").join(last, ["request_id", "dialogue_id"], "left")
    return met.select("request_id", "dialogue_id", F.parse_json(F.coalesce("j", F.lit("{}"))).alias("r"))


def votes(parsed: DataFrame, windows: DataFrame, weights: DataFrame) -> DataFrame:
    """Votes in normal form: one per dialogue of a request, a review vote where the answer has none.

    parsed: `request_id, model, v VARIANT`; windows: `request_id, dialogue_id`; weights:
    `model, weight`. The last row of a dialogue wins; a single row without id belongs to
    the only dialogue of its window.
    """
    each = parsed.select("request_id", "model", F.posexplode(first_list(F.col("v"))).alias("pos", "r"))
    get = lambda k, t="string": F.try_variant_get(F.col("r"), f"$.{k}", t)
    only = windows.groupBy("request_id").agg(F.count("*").alias("_n"), F.min("dialogue_id").alias("_only"))
    each = each.join(only, "request_id").withColumn("dialogue_id", F.coalesce(F.nullif(X.clean_text(get("dialogue_id")), F.lit("")), F.when(F.col("_n") == 1, F.col("_only"))))
    rows = each.select(
        "request_id", "model", "dialogue_id", "pos", X.clean_status(get("speaker_status")).alias("status"), X.clean_text(get("speaker_entity_id")).alias("entity"), X.clean_text(get("speaker_display")).alias("display"),
        X.clamp(F.coalesce(get("confidence", "double"), F.lit(0.0)), 0.0, 1.0).alias("confidence"), F.coalesce(get("needs_review", "boolean"), F.lit(False)).alias("review"), X.unique_strings(get("evidence", "array<string>"), 8).alias("evidence"),
    )
    last = rows.groupBy("request_id", "model", "dialogue_id").agg(F.max_by(F.struct("status", "entity", "display", "confidence", "review", "evidence"), "pos").alias("x"))
    asked = windows.join(parsed.select("request_id", "model").distinct(), "request_id")
    met = asked.join(last, ["request_id", "model", "dialogue_id"], "left").join(weights, "model", "left")
    group = X.is_group_npc(F.col("x.display")) & ~F.col("x.entity").startswith("char_")
    status = F.when(F.col("x").isNull(), "review").when(group, "npc").otherwise(F.col("x.status"))
    display = F.coalesce(F.nullif("x.display", F.lit("")), F.when(status == "review", "待复核").otherwise(status))
    entity = F.when(group, F.concat(F.lit("npc:"), X.slug(F.col("x.display")))).otherwise(F.coalesce(F.nullif("x.entity", F.lit("")), F.concat(status, F.lit(":"), X.slug(display))))
    return met.select(
        "dialogue_id", "model", F.coalesce("weight", F.lit(1.0)).alias("weight"), entity.alias("speaker_entity_id"), display.alias("speaker_display"), status.alias("speaker_status"),
        F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), (F.coalesce("x.review", F.lit(False)) | status.isin("ambiguous", "review")).alias("needs_review"), F.coalesce("x.evidence", F.array().cast("array<string>")).alias("evidence"),
    )


def discovered_mysteries(rows: DataFrame) -> DataFrame:
    """`mystery_id, name, description, evidence, source_scene_id, confidence` of `scene_id, r VARIANT`; appended as they come, none is merged."""
    get = lambda k, t="string": F.try_variant_get("r", f"$.{k}", t)
    name = F.coalesce(F.nullif(X.clean_name(get("temporary_name")), F.lit("")), F.lit("mystery_unknown"))
    proof = F.coalesce(get("evidence", "array<variant>"), F.when(get("evidence").isNotNull(), F.array(F.try_variant_get("r", "$.evidence", "variant"))), F.array().cast("array<variant>"))
    return rows.select(
        X.mystery_id(F.col("scene_id"), name).alias("mystery_id"), name.alias("name"), X.clean_text(get("description")).alias("description"),
        X.unique_strings(F.transform(proof, X.evidence_id)).alias("evidence"), F.col("scene_id").alias("source_scene_id"), X.safe_double(get("confidence", "double"), 0.5).alias("confidence"),
    )
