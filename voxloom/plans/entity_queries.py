"""Queries and SQL of the entity store and of model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import entities as E
from voxloom.operators import responses as J
from voxloom.operators.graph import resolve_aliases
from voxloom.plans.sql import ONCE, any_of, clean, in_list, quoted
from voxloom.plans.vote_queries import votes_of
from voxloom.sources.scratch import Scratch
from voxloom.sources.tables import once, table

CARD = ["volume_id", "entity_type", "display_name", "aliases", "importance", "dialogue_count", "first_seen_chunk_id", "latest_seen_chunk_id"]


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "entity_cards"), ["entity_id"], CARD)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "alias_edges"), ["edge_id"], ["source_entity_id", "target_entity_id", "confidence"])


def e_aliases(spark: SparkSession, d: str) -> DataFrame:
    return E.alias_table(_cards(spark, d))


def e_upsert(spark: SparkSession, d: str) -> DataFrame:
    cards = once(table(spark, d, "character_cards"), ["entity_id"], ["volume_id", "display_name", "aliases", "titles", "speech_markers", "confidence", "first_seen_scene_id"])
    store = E.upsert_characters(cards.withColumn("seq", F.regexp_extract("entity_id", "([0-9]+)$", 1).try_cast("long")))
    return store.withColumns({c: F.array_join(c, "|") for c in ("record_ids", "aliases", "titles", "speech_markers")})


def e_merges(spark: SparkSession, d: str) -> DataFrame:
    return E.merges(_edges(spark, d)).select("source", "target")


def e_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolve_aliases(E.merges(_edges(spark, d)))


def e_merged(spark: SparkSession, d: str) -> DataFrame:
    merged = Scratch(spark).save(E.merges(_edges(spark, d)), "merges")
    cards = once(table(spark, d, "entity_cards"), ["entity_id"], [*CARD, "summary"])
    found = E.merge_cards(cards, resolve_aliases(merged), merged)
    return found.withColumn("names", F.array_join("names", "|"))


def e_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Every edge's source as an annotation, rewritten to the entity it was merged into."""
    a = _edges(spark, d).where("source_entity_id is not null").select(F.col("edge_id").cast("string").alias("dialogue_id"), F.col("source_entity_id").alias("speaker_entity_id"), F.lit("?").alias("speaker_display"), F.lit("mystery").alias("speaker_status"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("evidence"))
    found = E.apply_merges(a, resolve_aliases(E.merges(_edges(spark, d))), _cards(spark, d))
    return found.withColumn("evidence", F.array_join("evidence", "|"))


def e_top(spark: SparkSession, d: str) -> DataFrame:
    return E.top_entities(_cards(spark, d)).select("volume_id", "rank", "entity_id")


def e_pending(spark: SparkSession, d: str) -> DataFrame:
    return E.pending_mysteries(_cards(spark, d), E.merges(_edges(spark, d)))


def j_votes(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers of every model to every dialogue, written from the votes, fenced or with chatter around them, and read again."""
    v = votes_of(spark, d)
    body = F.to_json(F.struct(F.array(F.struct("dialogue_id", "speaker_entity_id", "speaker_display", "speaker_status", "confidence", "needs_review", "evidence")).alias("annotations")))
    n = F.pmod("pos", F.lit(3))
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 1, body).otherwise(F.concat(F.lit("好的。 "), body, F.lit(" 完")))
    request = F.concat_ws("--", "dialogue_id", F.lit("annotation"), "model")
    responses = v.select(request.alias("request_id"), "model", "pos", raw.alias("raw"))
    hit, _ = J.replay(responses.select("request_id", "model"), responses.select("request_id", "raw", "pos"))
    parsed = hit.select("request_id", "model", J.parse_json(F.col("raw")).alias("v"))
    found = J.votes(parsed, v.select(request.alias("request_id"), "dialogue_id"), v.select("model").distinct().withColumn("weight", F.lit(1.0)))
    return found.withColumn("evidence", F.array_join("evidence", "|")).drop("weight")


_C = ONCE("entity_cards", "entity_id, " + ", ".join(CARD))
_LEVEL = "CASE importance WHEN 'major' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_CHUNK = lambda c: f"coalesce(try_cast(nullif(regexp_extract({c}, '-r([0-9]+)$', 1), '') AS INTEGER), 0)"
_NAME = lambda c: f"trim(regexp_replace({c}, '^{X.WS}+|{X.WS}+$', '', 'g'), {quoted(X.NAME_EDGE)})"
_SURE = "sure AS (SELECT edge_id, source_entity_id AS source, target_entity_id AS target FROM (SELECT DISTINCT edge_id, source_entity_id, target_entity_id, confidence FROM alias_edges) WHERE coalesce(confidence, 0) >= 0.85 AND source_entity_id <> target_entity_id)"
#: One step per sure edge in order of the edges: `st` holds after step i where every node has gone and what is written on its card.
_STEPS = f"""{_SURE}, ed AS (SELECT *, row_number() OVER (ORDER BY edge_id) AS i FROM sure),
        st(i, node, root, said, many) AS (SELECT CAST(0 AS BIGINT), n, n, coalesce({clean("summary")}, ''), coalesce(entity_type IN ('npc', 'npc_group'), false)
            FROM (SELECT source AS n FROM sure UNION SELECT target FROM sure) LEFT JOIN (SELECT DISTINCT entity_id, entity_type, summary FROM entity_cards) ON entity_id = n
          UNION ALL SELECT i + 1, node, CASE WHEN root = s THEN t ELSE root END,
            CASE WHEN node <> t OR s = t OR more = '' OR contains(said, more) THEN said WHEN length(joined) > most THEN left(joined, most - 1) || '…' ELSE joined END, many
            FROM (SELECT *, trim(said || ' ' || more) AS joined, CASE WHEN many THEN 120 ELSE 180 END AS most FROM (SELECT *, max(CASE WHEN node = s THEN said END) OVER () AS more
              FROM (SELECT st.*, max(CASE WHEN node = source THEN root END) OVER () AS s, max(CASE WHEN node = target THEN root END) OVER () AS t FROM st JOIN ed ON ed.i = st.i + 1))))"""
_RESOLVE = f"""{_STEPS}, rs AS (SELECT node, root AS resolved, said FROM st WHERE i = (SELECT count(*) FROM ed)),
        mg AS (SELECT a.root AS source, b.root AS target FROM ed JOIN st a ON a.i = ed.i - 1 AND a.node = ed.source JOIN st b ON b.i = ed.i - 1 AND b.node = ed.target WHERE a.root <> b.root)"""
_STATUS = f"CASE WHEN {clean('speaker_status')} IN {in_list(X.STATUSES)} THEN {clean('speaker_status')} ELSE 'review' END"
_SLUG = lambda c: f"coalesce(nullif(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '_'), ''), 'unknown')"

_NAMES_OF = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {_NAME('x')}), lambda x: x <> '')"
_SAFE = lambda x: f"(length({x}) > 1 AND {x} NOT IN {in_list(X.GENERIC_NAMES)})"
#: One step per card of a volume: the owner of each key, and the aliases of every entity, after it.
_UPSERT = f"""cd AS (SELECT entity_id, volume_id, {_NAME("display_name")} AS name, list_sort(list_distinct({_NAMES_OF("aliases")})) AS raw, {_NAMES_OF("titles")} AS tl, list_filter(list_transform(coalesce(speech_markers, []), lambda x: {clean("x")}), lambda x: x <> '') AS sm,
          coalesce(confidence, 0.5) AS conf, first_seen_scene_id AS scene FROM (SELECT DISTINCT entity_id, volume_id, display_name, aliases, titles, speech_markers, confidence, first_seen_scene_id FROM character_cards) WHERE {_NAME("display_name")} <> ''),
        ca AS (SELECT *, list_filter(raw, lambda x: {_SAFE("x")}) AS al, row_number() OVER (PARTITION BY coalesce(volume_id, '') ORDER BY try_cast(regexp_extract(entity_id, '([0-9]+)$', 1) AS BIGINT) NULLS FIRST, entity_id) AS i, coalesce(volume_id, '') AS vol FROM cd),
        st(vol, i, entity_id, hit, owner, ents) AS (SELECT DISTINCT vol, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST([] AS STRUCT(k VARCHAR, o BIGINT)[]), CAST([] AS VARCHAR[][]) FROM ca
          UNION ALL SELECT vol, i, entity_id, hit, list_concat(list_filter(owner, lambda w: NOT list_contains(list_concat([name], ents2[hit + 1]), w.k)), list_transform(list_distinct(list_concat([name], ents2[hit + 1])), lambda x: {{'k': x, 'o': hit}})), ents2 FROM (
            SELECT *, CASE WHEN hit = len(ents) THEN list_append(ents, al[1:20]) ELSE list_transform(ents, lambda e, j: CASE WHEN j = hit + 1 THEN list_sort(list_distinct(list_concat(e, al)))[1:20] ELSE e END) END AS ents2 FROM (
              SELECT *, coalesce(list_min(list_transform(list_filter(owner, lambda w: list_contains(mine, w.k)), lambda w: w.o)),
                list_min(list_transform(list_filter(owner, lambda w: {_SAFE("w.k")} AND length(w.k) > 2 AND len(list_filter(mine, lambda m: {_SAFE("m")} AND length(m) > 2 AND (suffix(m, w.k) OR suffix(w.k, m)))) > 0), lambda w: w.o)), CAST(len(ents) AS BIGINT)) AS hit
              FROM (SELECT ca.vol, ca.i, ca.entity_id, ca.name, ca.al, list_concat([ca.name], ca.al) AS mine, owner, ents FROM st JOIN ca ON ca.vol = st.vol AND ca.i = st.i + 1))))"""
_USEFUL = f"(x IN {in_list(X.SELF_PRONOUNS)} OR (length(x) <= 8 AND NOT regexp_matches(x, '[。！？!?；;：:“”\"「」『』]') AND x NOT IN {in_list(X.GENERIC_NAMES)} AND NOT (regexp_matches(x, '[你您我他她它]') AND length(x) > 4)))"

SQL = {
    "e_upsert": f"""WITH RECURSIVE {_UPSERT}, j AS (SELECT st.vol, st.i, st.hit, ca.* EXCLUDE (vol, i) FROM st JOIN ca ON ca.vol = st.vol AND ca.i = st.i),
        g AS (SELECT vol, hit, first(volume_id ORDER BY i) AS volume_id, first(entity_id ORDER BY i) AS first_record, string_agg(entity_id, '|' ORDER BY i) AS record_ids, first(name ORDER BY i) AS display_name, list_sort(list_distinct(flatten(list(al))))[1:20] AS al,
          list_sort(list_distinct(flatten(list(list_concat(tl, list_filter(raw, lambda x: NOT {_SAFE("x")}))))))[1:20] AS ti, flatten(list(list_filter(list_filter(sm, lambda x, k: list_position(sm, x) = k), lambda x: {_USEFUL})[1:20] ORDER BY i)) AS mk, max(conf) AS confidence, first(scene ORDER BY i) AS first_seen_scene_id, last(scene ORDER BY i) AS latest_seen_scene_id FROM j GROUP BY vol, hit)
        SELECT volume_id, first_record, record_ids, display_name, array_to_string(al, '|') AS aliases, array_to_string(ti, '|') AS titles, array_to_string(list_filter(mk, lambda x, k: list_position(mk, x) = k)[1:20], '|') AS speech_markers, confidence, first_seen_scene_id, latest_seen_scene_id FROM g""",
    "e_aliases": f"SELECT entity_id, alias, CAST(min(pos) AS INTEGER) AS pos FROM (SELECT entity_id, {_NAME('a')} AS alias, pos FROM (SELECT entity_id, unnest(aliases) AS a, generate_subscripts(aliases, 1) - 1 AS pos FROM {_C})) WHERE alias <> '' GROUP BY ALL",
    "e_merges": f"WITH RECURSIVE {_RESOLVE} SELECT * FROM mg",
    "e_resolve": f"WITH RECURSIVE {_RESOLVE} SELECT node, resolved FROM rs",
    "e_merged": f"""WITH RECURSIVE {_RESOLVE}, m AS (SELECT coalesce(resolved, entity_id) AS into_id, c.* FROM {_C} c LEFT JOIN rs ON node = entity_id),
        n AS (SELECT into_id, array_to_string(list_sort(list(DISTINCT x)), '|') AS names FROM (SELECT into_id, {clean("y")} AS x FROM (SELECT into_id, unnest(list_concat([display_name], coalesce(aliases, []))) AS y FROM m)) WHERE x <> '' GROUP BY 1)
        SELECT m.into_id AS entity_id, count(*) AS merged, CAST(sum(coalesce(dialogue_count, 0)) AS BIGINT) AS dialogue_count, max({_CHUNK("latest_seen_chunk_id")}) AS latest_chunk, any_value(coalesce(names, '')) AS names, any_value(coalesce(w.said, (SELECT max({clean("o.summary")}) FROM entity_cards o WHERE o.entity_id = m.into_id), '')) AS summary, list_extract(['minor', 'medium', 'major'], max({_LEVEL}) + 1) AS importance
        FROM m LEFT JOIN n USING (into_id) LEFT JOIN rs w ON w.node = m.into_id GROUP BY m.into_id""",
    "e_backfill": f"""WITH RECURSIVE {_RESOLVE}, a AS (SELECT DISTINCT edge_id, source_entity_id AS s FROM alias_edges WHERE source_entity_id IS NOT NULL),
        b AS (SELECT a.*, resolved, c.entity_id AS cid, display_name, entity_type FROM a LEFT JOIN rs ON node = s AND node <> resolved LEFT JOIN {_C} c ON c.entity_id = resolved)
        SELECT CAST(edge_id AS VARCHAR) AS dialogue_id, coalesce(resolved, s) AS speaker_entity_id, CASE WHEN cid IS NOT NULL THEN coalesce(display_name, '') ELSE '?' END AS speaker_display,
          CASE WHEN cid IS NULL THEN 'mystery' WHEN entity_type IN ('character', 'known') THEN 'known' WHEN entity_type = 'mystery' THEN 'mystery' WHEN entity_type IN ('npc', 'npc_group') THEN 'npc_group' ELSE 'unknown' END AS speaker_status,
          CAST(CASE WHEN cid IS NOT NULL THEN 0.92 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN cid IS NOT NULL THEN '实体别名归一：' || s || ' -> ' || resolved ELSE '' END AS evidence FROM b""",
    "e_top": f"SELECT volume_id, CAST(rank AS INTEGER) AS rank, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY {_LEVEL} DESC, {_CHUNK('latest_seen_chunk_id')} DESC, entity_id) AS rank FROM {_C}) WHERE rank <= 12",
    "e_pending": f"""WITH RECURSIVE {_RESOLVE}, n AS (SELECT volume_id, max({_CHUNK("latest_seen_chunk_id")}) AS now_chunk FROM {_C} GROUP BY 1)
        SELECT entity_id, volume_id, {_CHUNK("first_seen_chunk_id")} AS first_chunk, now_chunk, first_chunk > 0 AND now_chunk - first_chunk >= 12 AS expired FROM {_C} JOIN n USING (volume_id)
        WHERE entity_type = 'mystery' AND {_LEVEL} > 0 AND entity_id NOT IN (SELECT source FROM mg)""",
    "j_votes": f"""WITH v AS (SELECT dialogue_id, model, {_STATUS} AS st, {clean("speaker_entity_id")} AS en, {clean("speaker_display")} AS di, least(1.0, greatest(0.0, coalesce(confidence, 0.0))) AS confidence, coalesce(needs_review, false) AS rv,
          list_filter(list_transform(coalesce(evidence, []), lambda x: {clean("x")}), lambda x: x <> '') AS ev FROM {ONCE("votes", "dialogue_id, model, speaker_status, speaker_entity_id, speaker_display, confidence, needs_review, evidence")} WHERE dialogue_id IS NOT NULL AND model IS NOT NULL),
        g AS (SELECT *, (di IN {in_list(X.GROUP_NPC)} OR {any_of("di", X.GROUP_NPC_WORDS)}) AND NOT starts_with(en, 'char_') AS gr FROM v),
        s AS (SELECT *, CASE WHEN gr THEN 'npc' ELSE st END AS status FROM g), t AS (SELECT *, coalesce(nullif(di, ''), CASE WHEN status = 'review' THEN '待复核' ELSE status END) AS display FROM s)
        SELECT dialogue_id, model, CASE WHEN gr THEN 'npc:' || {_SLUG("di")} WHEN en <> '' THEN en ELSE status || ':' || {_SLUG("display")} END AS speaker_entity_id, display AS speaker_display, status AS speaker_status, confidence,
          rv OR status IN ('ambiguous', 'review') AS needs_review, array_to_string(list_filter(ev, lambda x, i: list_position(ev, x) = i)[1:8], '|') AS evidence FROM t""",
}
