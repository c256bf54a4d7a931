"""Queries and SQL of segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import segmentation as S
from voxloom.plans.sql import ONCE, clean, quoted
from voxloom.sources.tables import once, table


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "paragraphs"), ["paragraph_id"], ["volume_id", "paragraph_index", "line_index", "chapter_id", "chapter_index", "chapter_title", "scene_id", "text"])


def _dialogues(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "dialogues"), ["dialogue_id"], ["volume_id", "scene_id", "paragraph_id"])


def s_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return S.lines(table(spark, d, "documents").where("doc_id is not null"), "doc_id").select("doc_id", "line_index", "text", X.is_title(c).alias("is_title"), X.is_break(c).alias("is_break"), X.is_structural(c).alias("is_structural"))


def s_scenes(spark: SparkSession, d: str) -> DataFrame:
    return S.chapters_and_scenes(_paragraphs(spark, d).select("volume_id", "line_index", "text"))


def s_chapters(spark: SparkSession, d: str) -> DataFrame:
    return S.chapter_ranges(_paragraphs(spark, d))


def s_dialogues(spark: SparkSession, d: str) -> DataFrame:
    return S.dialogues(_paragraphs(spark, d))


def s_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d).select("volume_id", "paragraph_index", F.coalesce("text", F.lit("")).alias("text"))
    near = S.neighbours(rows, "volume_id", "paragraph_index", "text", 3, 3)
    return near.select("volume_id", "paragraph_index", F.array_join("prev", "|").alias("prev"), F.array_join("next", "|").alias("next"))


def s_scene_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.scenes(_paragraphs(spark, d), _dialogues(spark, d))


def s_volumes(spark: SparkSession, d: str) -> DataFrame:
    return S.volumes(_paragraphs(spark, d), _dialogues(spark, d))


_TITLE, _DECO = quoted(X.CHAPTER_TITLE), quoted(X.DECORATION)
_BREAK = f"(text = '插图' OR regexp_matches(text, {_DECO}))"
_STRUCTURAL = f"({_BREAK} OR regexp_matches(text, {_TITLE}) OR text IN ('序', '幕', '终', '第'))"
_P = ONCE("paragraphs", "paragraph_id, volume_id, paragraph_index, line_index, chapter_id, chapter_index, chapter_title, scene_id, text")
_D = ONCE("dialogues", "dialogue_id, volume_id, scene_id, paragraph_id")
_PAD = lambda c, n: f"CASE WHEN length(CAST({c} AS VARCHAR)) >= {n} THEN CAST({c} AS VARCHAR) ELSE lpad(CAST({c} AS VARCHAR), {n}, '0') END"

SQL = {
    "s_lines": f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{X.WS}+|{X.WS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
        b AS (SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_index FROM a)
        SELECT doc_id, line_index, replace(text, chr(12288), ' ') AS text, regexp_matches(replace(text, chr(12288), ' '), {_TITLE}) AS is_title, {_BREAK} AS is_break, {_STRUCTURAL} AS is_structural FROM b""",
    "s_scenes": f"""WITH RECURSIVE k AS (SELECT volume_id, line_index, {clean("text")} AS text FROM {_P} WHERE {clean("text")} <> ''),
        a AS (SELECT *, regexp_matches(text, {_TITLE}) AS title, {_BREAK} AS broken, {_STRUCTURAL} AS is_structural FROM k),
        b AS (SELECT *, sum(CAST(title AS INT)) OVER (PARTITION BY volume_id ORDER BY line_index) AS ch, row_number() OVER (PARTITION BY volume_id ORDER BY line_index) AS n FROM a),
        c AS (SELECT volume_id, n, 1 AS sc, 1 AS cnt, broken AS pb FROM b WHERE n = 1
          UNION ALL SELECT b.volume_id, b.n, CASE WHEN title THEN 1 WHEN NOT broken AND (pb OR (cnt >= 80 AND NOT is_structural)) THEN sc + 1 ELSE sc END,
            CASE WHEN title OR (NOT broken AND (pb OR (cnt >= 80 AND NOT is_structural))) THEN 1 ELSE cnt + 1 END, broken FROM c JOIN b ON b.volume_id = c.volume_id AND b.n = c.n + 1),
        e AS (SELECT b.*, sc, coalesce(max(CASE WHEN title THEN text END) OVER (PARTITION BY b.volume_id, ch), 'front_matter') AS tt FROM b JOIN c ON b.volume_id = c.volume_id AND b.n = c.n),
        f AS (SELECT *, volume_id || '-c' || {_PAD("ch", 3)} AS cid FROM e), g AS (SELECT *, cid || '-s' || {_PAD("sc", 3)} AS sid FROM f)
        SELECT sid || '-p' || {_PAD("n", 6)} AS paragraph_id, volume_id, CAST(n - 1 AS INTEGER) AS paragraph_index, line_index, cid AS chapter_id, CAST(ch AS INTEGER) AS chapter_index, tt AS chapter_title,
          sid AS scene_id, CAST(sc AS INTEGER) AS scene_index, text, is_structural FROM g""",
    "s_chapters": f"""WITH a AS (SELECT volume_id, chapter_index, min(paragraph_index) AS lo, max(paragraph_index) AS hi FROM {_P} GROUP BY ALL),
        k AS (SELECT volume_id, chapter_index FROM a UNION SELECT volume_id, 0 FROM a)
        SELECT volume_id, chapter_index, CASE WHEN chapter_index = 0 THEN 0 ELSE lo END AS start_paragraph_index, hi AS end_paragraph_index FROM k LEFT JOIN a USING (volume_id, chapter_index)""",
    "s_dialogues": f"""WITH a AS (SELECT paragraph_id, text, regexp_extract_all(text, '「[^」]*」') AS q, list_transform(string_split_regex(text, '「[^」]*」'), lambda x: length(x)) AS g FROM {_P} WHERE contains(text, '「')),
        b AS (SELECT *, unnest(range(len(q))) AS i FROM a),
        c AS (SELECT *, CAST(coalesce(list_sum(g[1:i + 1]), 0) + coalesce(list_sum(list_transform(q[1:i], lambda x: length(x))), 0) AS BIGINT) AS s FROM b),
        e AS (SELECT *, s + length(q[i + 1]) AS e, {clean("substring(text, 1, s) || substring(text, s + length(q[i + 1]) + 1)")} AS o FROM c)
        SELECT paragraph_id, CAST(i AS INTEGER) AS local_dialogue_index, regexp_replace(substring(q[i + 1], 2, length(q[i + 1]) - 2), '^{X.WS}+|{X.WS}+$', '', 'g') AS quote, q[i + 1] AS quote_text, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end,
          CASE WHEN o = '' THEN 'standalone' ELSE 'inline' END AS dialogue_kind, o AS outside FROM e""",
    "s_context": f"""WITH p AS (SELECT volume_id, paragraph_index, coalesce(text, '') AS text FROM {_P})
        SELECT volume_id, paragraph_index, coalesce(array_to_string(array_agg(text) OVER (PARTITION BY volume_id ORDER BY paragraph_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS prev,
          coalesce(array_to_string(array_agg(text) OVER (PARTITION BY volume_id ORDER BY paragraph_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '|'), '') AS next FROM p""",
    "s_scene_rollup": f"""WITH q AS (SELECT scene_id, count(*) AS n FROM {_D} GROUP BY scene_id)
        SELECT p.scene_id, min(paragraph_index) AS start_paragraph_index, max(paragraph_index) AS end_paragraph_index, count(*) AS n_paragraphs, min_by(paragraph_id, paragraph_index) AS first_paragraph_id,
          max_by(paragraph_id, paragraph_index) AS last_paragraph_id, coalesce(any_value(q.n), 0) AS n_dialogues FROM {_P} p LEFT JOIN q ON p.scene_id = q.scene_id WHERE p.scene_id IS NOT NULL GROUP BY p.scene_id""",
    "s_volumes": f"""SELECT volume_id, count(*) AS paragraphs, count(DISTINCT scene_id) AS scenes, count(DISTINCT chapter_id) AS chapters, coalesce(any_value(n), 0) AS dialogues
        FROM {_P} LEFT JOIN (SELECT volume_id, count(*) AS n FROM {_D} GROUP BY volume_id) USING (volume_id) GROUP BY volume_id""",
}
