"""The queries of this package, named by problem, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import canon, components, consensus, mixture, packing, pieces, spans, tokens, unify, variants
from voxloom.llm.base import limits
from voxloom.sources.tables import once, table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "paragraphs"), ["paragraph_id"], ["scene_id", "paragraph_index", "text"])


def _pieces(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    lim = limits(spark, d)
    return pieces.oversized_pieces(_lines(spark, d), lim["paragraph_max_chars"], lim["scene_max_chars"], lim["overlap_chars"]), lim


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)[0].drop("longest_unbroken")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cut, lim = _pieces(spark, d)
    return pieces.oversized_items(cut, lim["paragraph_max_chars"])


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """`entry_id, field_name, value, ref_id, listed` of every value typed in the review queue."""
    entries = once(table(spark, d, "review_entries"), ["entry_id"], ["speaker_display", "speaker_status"])
    cast = table(spark, d, "cast_list").select("entity_id", "display_name", "aliases", "titles")
    status = table(spark, d, "status_list").select("status_id", "speaker_status", "gloss")
    person, state = canon.keys_of(cast, "person"), canon.keys_of(status, "status")

    def field(name: str, keys: DataFrame, how: str, listed: DataFrame) -> DataFrame:
        values = entries.where(F.col(name).isNotNull()).select("entry_id", F.lit(name).alias("field_name"), F.col(name).alias("value"))
        return canon.map_values(values, keys, how).join(listed.distinct().withColumn("listed", F.lit(True)), "value", "left")

    one = field("speaker_display", person, "person", cast.select(F.col("display_name").alias("value")))
    two = field("speaker_status", state, "status", status.select(F.col("speaker_status").alias("value")))
    return one.unionByName(two)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("listed is null").select("entry_id", "field_name", "ref_id")


def p2_mapped(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("entry_id", "field_name", "value", "ref_id", F.col("listed").isNotNull().alias("exact"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    cards = once(table(spark, d, "character_cards"), ["entity_id"], ["volume_id", "display_name", "aliases"])
    cards = cards.select(F.col("entity_id").alias("id"), F.col("volume_id").alias("volume"), F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    mentions = once(table(spark, d, "speaker_mentions"), ["mention_id"], ["volume_id", "speaker_display"])
    mentions = mentions.select(F.col("mention_id").alias("id"), F.col("volume_id").alias("volume"), F.array("speaker_display").alias("names"))
    return variants.link_names(cards.unionByName(mentions))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.linked_pairs(_people(spark, d))


def p3_people(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select(F.col("id").alias("record_id"), F.col("person").alias("person_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.connected_components(table(spark, d, "alias_edges"), "source_entity_id", "target_entity_id")
    return groups.select(F.col("node").alias("entity_id"), F.col("component").alias("group_id"))


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    votes = table(spark, d, "votes").select(F.col("dialogue_id").alias("item"), "model", F.col("speaker_entity_id").alias("label"), "confidence")
    return consensus.consensus(votes)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0].where("n_models >= 3").select(F.col("item").alias("dialogue_id"), F.col("label").alias("speaker_entity_id"))


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0].withColumnsRenamed({"item": "dialogue_id", "label": "speaker_entity_id"})


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = once(table(spark, d, "paragraphs"), ["paragraph_id"], ["text"]).select(F.lit("paragraph").alias("item_kind"), F.col("paragraph_id").alias("item_id"), "text")
    names = once(table(spark, d, "character_cards"), ["entity_id"], ["display_name"]).select(F.lit("character").alias("item_kind"), F.col("entity_id").alias("item_id"), F.col("display_name").alias("text"))
    return unify.same_reading_pairs(lines.unionByName(names))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    lines = once(table(spark, d, "paragraphs"), ["paragraph_id"], ["text"])
    canon = unify.canonical_column(F.col("text"))
    return lines.withColumn("canonical_text", canon).select("paragraph_id", "canonical_text", (~F.col("canonical_text").eqNullSafe(F.col("text"))).alias("changed"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(_sized(spark, d), limits(spark, d)["container_capacity_tokens"])


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d), limits(spark, d)["container_capacity_tokens"])


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.window_report(p7_pack(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_sized(spark, d), table(spark, d, "source_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_sized(spark, d), table(spark, d, "source_targets"))[1]


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents").select("doc_id", "text"), limits(spark, d)["shared_span_min_chars"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(_spans(spark, d))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    parts = spans.shared_parts(_spans(spark, d), table(spark, d, "documents").select("doc_id", "text"))
    text = F.array_join(F.transform("passages", lambda p: F.concat_ws("+", p["start"].cast("string"), p["length"].cast("string"))), "|")
    return parts.withColumn("passages", text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_LINES = "(SELECT DISTINCT paragraph_id, scene_id, text FROM paragraphs WHERE text IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""SELECT 'paragraph' AS item_kind, paragraph_id AS item_id FROM {_LINES} WHERE length(text) > 480
            UNION ALL SELECT 'unbroken', paragraph_id FROM {_LINES} WHERE list_max(list_transform(string_split_regex(text, '[。！？…；」』\n]'), lambda x: length(x))) > 480
            UNION ALL SELECT 'scene', scene_id FROM {_LINES} WHERE scene_id IS NOT NULL GROUP BY scene_id HAVING sum(length(text)) + count(*) - 1 > 2400""",
        "p4_found": """WITH RECURSIVE e AS (SELECT source_entity_id AS a, target_entity_id AS b FROM alias_edges WHERE source_entity_id <> target_entity_id UNION SELECT target_entity_id, source_entity_id FROM alias_edges WHERE source_entity_id <> target_entity_id),
            r(x, y) AS (SELECT a, b FROM e UNION SELECT x, b FROM r JOIN e ON y = a) SELECT x AS entity_id, least(x, min(y)) AS group_id FROM r GROUP BY x""",
        "p9_found": """WITH w AS (SELECT DISTINCT doc_id, substring(text, i, 64) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 62)) AS i FROM documents WHERE length(text) >= 64)),
            k AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1), h AS (SELECT doc_id, s FROM w SEMI JOIN k USING (s))
            SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id""",
        # passages: the shared windows of a document, overlapping and adjoining ones merged
        "p9_shared": """WITH w AS (SELECT doc_id, i - 1 AS p, substring(text, i, 64) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 62)) AS i FROM documents WHERE length(text) >= 64)),
            k AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), h AS (SELECT DISTINCT doc_id, p FROM w SEMI JOIN k USING (s)),
            n AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 64 THEN 0 ELSE 1 END AS nw FROM h), g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY p) AS part FROM n),
            q AS (SELECT doc_id, min(p) AS start, max(p) + 64 - min(p) AS len FROM g GROUP BY doc_id, part), r AS (SELECT doc_id, sum(len) AS shared, string_agg(start || '+' || len, '|' ORDER BY start) AS passages FROM q GROUP BY doc_id)
            SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN CAST(coalesce(shared, 0) AS BIGINT) END AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared, 0) / length(text) END AS shared_share, coalesce(passages, '') AS passages FROM documents LEFT JOIN r USING (doc_id)""",
    }
