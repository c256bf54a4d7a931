"""Queries and SQL of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.plans.sql import ONCE, any_of, clean, in_list, quoted
from voxloom.sources.tables import once, table


def n_text(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "paragraphs"), ["paragraph_id"], ["text"])
    c = F.col("text")
    return t.select("paragraph_id", X.clean_text(c).alias("clean"), X.clean_name(c).alias("name"), X.slug(c).alias("slug"), X.truncate(c, 40).alias("short"))


def n_lists(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "entity_cards"), ["entity_id"], ["display_name", "aliases"])
    names = X.unique_strings(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), 10)
    keys = F.filter(X.unique_strings(F.col("aliases")), X.is_safe_key)
    return t.select("entity_id", F.array_join(names, "|").alias("names"), F.size(names).alias("n_names"), F.array_join(F.array_sort(keys), "|").alias("merge_keys"))


def n_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "votes"), ["dialogue_id", "model"], ["confidence", "speaker_entity_id", "speaker_status", "speaker_display", "weight"])
    return t.select(
        "dialogue_id",
        X.safe_model(F.col("model")).alias("model"),
        X.clamp(X.safe_double(F.col("confidence"), 0.0), 0.0, 1.0).alias("confidence"),
        F.greatest(F.lit(0.0), X.safe_double(F.col("weight"), 1.0)).alias("weight"),
        X.clean_status(F.col("speaker_status")).alias("status"),
        X.vote_key(F.col("speaker_entity_id"), F.col("speaker_status"), F.col("speaker_display")).alias("vote_key"),
        F.coalesce(X.is_group_npc(F.col("speaker_display")), F.lit(False)).alias("group_npc"),
    )


def n_markers(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "character_cards"), ["entity_id"], ["speech_markers", "aliases"])
    every = X.unique_strings(F.concat(F.coalesce("speech_markers", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>"))))
    return t.select("entity_id", F.array_join(F.slice(F.filter(every, X.is_useful_marker), 1, 20), "|").alias("useful"), F.array_join(F.slice(F.filter(every, X.is_usable_marker), 1, 12), "|").alias("usable"))


def n_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    c = F.col("text")
    n = X.character_counts(c)
    return t.select("doc_id", X.estimate_tokens(c).alias("tokens"), X.budget_status(X.estimate_tokens(c), 1000, 8000).alias("status"), *[n[k].alias(k) for k in ("han", "ascii", "signs", "other")])


def n_ids(spark: SparkSession, d: str) -> DataFrame:
    t = once(table(spark, d, "entity_cards"), ["entity_id"], ["importance", "latest_seen_chunk_id", "entity_type"])
    return t.select(
        "entity_id",
        X.chunk_number(F.col("latest_seen_chunk_id")).alias("chunk"),
        X.merge_importance(F.col("importance"), F.lit("medium")).alias("importance"),
        X.parent_scene(F.col("latest_seen_chunk_id")).alias("parent"),
        F.concat_ws("--", "latest_seen_chunk_id", F.lit("annotation"), X.safe_model(F.lit("qwen3:32b"))).alias("request_id"),
        X.mystery_id(F.col("latest_seen_chunk_id"), F.col("entity_type")).alias("mystery_id"),
    )


def n_related(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of related names of a volume: an equi-join on suffixes instead of all pairs."""
    t = once(table(spark, d, "character_cards"), ["entity_id"], ["volume_id", "display_name", "aliases"])
    every = F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    names = t.select("volume_id", every.alias("n")).select("volume_id", X.clean_name(F.col("n")).alias("name")).where(X.is_safe_key(F.col("name")) & (F.length("name") >= 3)).distinct()
    ends = names.select("volume_id", F.col("name").alias("longer"), F.explode(F.expr("transform(sequence(3, length(name) - 1), n -> right(name, n))")).alias("shorter")).where("length(longer) > 3")
    met = ends.join(names.withColumnRenamed("name", "shorter"), ["volume_id", "shorter"]).select("volume_id", "longer", "shorter")
    return met.where(X.is_related(F.col("longer"), F.col("shorter")))


_STATUS = f"CASE WHEN {clean('speaker_status')} IN {in_list(X.STATUSES)} THEN {clean('speaker_status')} ELSE 'review' END"
_SLUG = lambda c: f"coalesce(nullif(trim(regexp_replace({clean(c)}, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '_'), ''), 'unknown')"
_SAFE = f"(length(x) > 1 AND x NOT IN {in_list(X.GENERIC_NAMES)})"

SQL = {
    "n_text": f"""SELECT paragraph_id, {clean("text")} AS clean,
        trim(regexp_replace(coalesce(text, ''), '^{X.WS}+|{X.WS}+$', '', 'g'), {quoted(X.NAME_EDGE)}) AS name, {_SLUG("text")} AS slug,
        CASE WHEN length({clean("text")}) > 40 THEN left({clean("text")}, 39) || '…' ELSE {clean("text")} END AS short
        FROM {ONCE("paragraphs", "paragraph_id, text")}""",
    "n_lists": f"""WITH t AS (SELECT entity_id, list_filter(list_transform(list_concat([display_name], coalesce(aliases, [])), lambda x: {clean("x")}), lambda x: x <> '') AS a,
          list_filter(list_transform(coalesce(aliases, []), lambda x: {clean("x")}), lambda x: x <> '') AS b FROM {ONCE("entity_cards", "entity_id, display_name, aliases")}),
        u AS (SELECT entity_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a, list_sort(list_distinct(list_filter(b, lambda x: {_SAFE}))) AS b FROM t)
        SELECT entity_id, array_to_string(a[1:10], '|') AS names, CAST(len(a[1:10]) AS INTEGER) AS n_names, array_to_string(b, '|') AS merge_keys FROM u""",
    "n_numbers": f"""SELECT dialogue_id, {_SLUG("translate(model, ':/', '__')")} AS model, least(1.0, greatest(0.0, coalesce(confidence, 0.0))) AS confidence, greatest(0.0, coalesce(weight, 1.0)) AS weight,
        {_STATUS} AS status, coalesce(nullif({clean("speaker_entity_id")}, ''), ({_STATUS}) || ':' || coalesce(nullif({clean("speaker_display")}, ''), 'unknown')) AS vote_key,
        coalesce(speaker_display IN {in_list(X.GROUP_NPC)} OR {any_of("speaker_display", X.GROUP_NPC_WORDS)}, false) AS group_npc
        FROM {ONCE("votes", "dialogue_id, model, confidence, weight, speaker_entity_id, speaker_status, speaker_display")} WHERE dialogue_id IS NOT NULL AND model IS NOT NULL""",
    "n_markers": f"""WITH t AS (SELECT entity_id, list_filter(list_transform(list_concat(coalesce(speech_markers, []), coalesce(aliases, [])), lambda x: {clean("x")}), lambda x: x <> '') AS a
          FROM {ONCE("character_cards", "entity_id, speech_markers, aliases")}), u AS (SELECT entity_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM t)
        SELECT entity_id, array_to_string(list_filter(a, lambda x: x IN {in_list(X.SELF_PRONOUNS)} OR (length(x) <= 8 AND NOT regexp_matches(x, '[。！？!?；;：:“”"「」『』]') AND x NOT IN {in_list(X.GENERIC_NAMES)}
          AND NOT (regexp_matches(x, '[你您我他她它]') AND length(x) > 4)))[1:20], '|') AS useful,
          array_to_string(list_filter(a, lambda x: x IN {in_list(X.SELF_PRONOUNS)} OR (length(x) BETWEEN 2 AND 4 AND x NOT IN {in_list(X.LOW_SIGNAL_MARKERS)} AND NOT regexp_matches(x, '[。！？!?；;：:，、,.…「」『』“”"'']')
          AND regexp_matches(x, '[A-Za-z0-9一-鿿]')))[1:12], '|') AS usable FROM u""",
    "n_tokens": f"""WITH t AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS ascii,
          length(regexp_replace(text, '[^{X.WS[1:]}', '', 'g')) AS space, length(regexp_replace(text, '[^{{}}\\[\\]":,]', '', 'g')) AS signs FROM documents WHERE text IS NOT NULL),
        u AS (SELECT *, CAST(ceil((16 * han + 4 * ascii + 2 * space + 6 * (n - han - ascii - space)) / 10.0) AS INTEGER) AS tokens FROM t)
        SELECT doc_id, tokens, CASE WHEN tokens > 8000 THEN 'over_limit' WHEN tokens > 1000 THEN 'near_limit' ELSE 'ok' END AS status,
          CAST(han AS INTEGER) AS han, CAST(ascii AS INTEGER) AS ascii, CAST(signs AS INTEGER) AS signs, CAST(n - han - ascii - signs AS INTEGER) AS other FROM u""",
    "n_ids": f"""SELECT entity_id, coalesce(try_cast(nullif(regexp_extract(latest_seen_chunk_id, '-r([0-9]+)$', 1), '') AS INTEGER), 0) AS chunk, CASE WHEN importance = 'major' THEN 'major' ELSE 'medium' END AS importance,
        regexp_replace(latest_seen_chunk_id, '-r[0-9]+$', '') AS parent, latest_seen_chunk_id || '--annotation--qwen3_32b' AS request_id,
        left('mystery_' || {_SLUG("latest_seen_chunk_id")} || '_' || {_SLUG("entity_type")}, 160) AS mystery_id FROM {ONCE("entity_cards", "entity_id, importance, latest_seen_chunk_id, entity_type")}""",
    "n_related": f"""WITH n AS (SELECT DISTINCT volume_id, trim(regexp_replace(display_name, '^{X.WS}+|{X.WS}+$', '', 'g'), {quoted(X.NAME_EDGE)}) AS x FROM (SELECT volume_id, unnest(list_concat([display_name], coalesce(aliases, []))) AS display_name FROM character_cards) WHERE display_name IS NOT NULL)
        SELECT a.volume_id, a.x AS longer, b.x AS shorter FROM (SELECT * FROM n WHERE {_SAFE}) a JOIN (SELECT * FROM n WHERE {_SAFE}) b
        ON a.volume_id = b.volume_id AND length(b.x) >= 3 AND length(a.x) > length(b.x) AND suffix(a.x, b.x)""",
}
