"""Queries and SQL of windows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import windows as W
from voxloom.plans.sql import ONCE, clean
from voxloom.sources.tables import once, table

DIALOGUE = ["dialogue_index", "volume_id", "chapter_id", "scene_id", "paragraph_id", "paragraph_index", "dialogue_kind"]


def _dialogues(spark: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return once(table(spark, d, "dialogues"), ["dialogue_id"], [*DIALOGUE, *extra])


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = once(table(spark, d, "paragraphs"), ["paragraph_id"], ["volume_id", "chapter_id", "chapter_index", "scene_id", "paragraph_index", "text"])
    n = _dialogues(spark, d).groupBy("paragraph_id").agg(F.count("*").cast("int").alias("n_dialogues"))
    return p.join(n, "paragraph_id", "left").fillna(0, ["n_dialogues"])


def w_select(spark: SparkSession, d: str) -> DataFrame:
    return W.select_range(_dialogues(spark, d), 10, 40).select("dialogue_id", "volume_id", "dialogue_index")


def w_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.dialogue_windows(_dialogues(spark, d)).select("dialogue_id", "window_id", "window_pos")


def w_segments(spark: SparkSession, d: str) -> DataFrame:
    return W.alternation_segments(W.dialogue_windows(_dialogues(spark, d)))


def w_requests(spark: SparkSession, d: str) -> DataFrame:
    return W.pack_requests(_paragraphs(spark, d))


def w_chunks(spark: SparkSession, d: str) -> DataFrame:
    return W.reading_chunks(_paragraphs(spark, d))


def w_narrative(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d).where("scene_id is not null").withColumn("chunk_id", F.col("scene_id"))
    return W.non_narrative(rows)


def w_context(spark: SparkSession, d: str) -> DataFrame:
    return W.window_context(W.dialogue_windows(_dialogues(spark, d)), _paragraphs(spark, d))


_D = ONCE("dialogues", "dialogue_id, " + ", ".join(DIALOGUE))
_P = ONCE("paragraphs", "paragraph_id, volume_id, chapter_id, chapter_index, scene_id, paragraph_index, text")
WINDOWS = f"""a AS (SELECT *, CASE WHEN (row_number() OVER c > 1 AND lag(scene_id) OVER c IS NOT DISTINCT FROM scene_id) AND NOT coalesce(paragraph_index - lag(paragraph_index) OVER c > 4, false) THEN 0 ELSE 1 END AS nw
          FROM {_D} WINDOW c AS (PARTITION BY volume_id, chapter_id ORDER BY dialogue_index, dialogue_id)),
        b AS (SELECT *, sum(nw) OVER (PARTITION BY volume_id, chapter_id ORDER BY dialogue_index, dialogue_id) AS isl FROM a),
        c AS (SELECT *, row_number() OVER (PARTITION BY volume_id, chapter_id, isl ORDER BY dialogue_index, dialogue_id) - 1 AS k FROM b),
        e AS (SELECT *, first_value(dialogue_id) OVER w AS f, last_value(dialogue_id) OVER w AS l FROM c WINDOW w AS (PARTITION BY volume_id, chapter_id, isl, k // 8 ORDER BY dialogue_index, dialogue_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        win AS (SELECT *, CASE WHEN f = l THEN f ELSE f || '_to_' || l END AS window_id, CAST(k % 8 AS INTEGER) AS window_pos FROM e)"""

_N = f"n AS (SELECT paragraph_id, count(*) AS n FROM {_D} GROUP BY paragraph_id), p AS (SELECT q.*, coalesce(n.n, 0) AS n FROM {_P} q LEFT JOIN n ON n.paragraph_id = q.paragraph_id)"

SQL = {
    # one step per paragraph of a scene: a full request is closed before the paragraph that doesn't fit
    "w_requests": f"""WITH RECURSIVE {_N}, o AS (SELECT scene_id, paragraph_id, n, row_number() OVER (PARTITION BY scene_id ORDER BY paragraph_index, paragraph_id) AS i FROM p WHERE scene_id IS NOT NULL),
        f(scene_id, i, paragraph_id, job, pos, spoken) AS (SELECT scene_id, i, paragraph_id, 0, 0, n FROM o WHERE i = 1
          UNION ALL SELECT scene_id, i, paragraph_id, CASE WHEN full_ THEN job + 1 ELSE job END, CASE WHEN full_ THEN 0 ELSE pos + 1 END, CASE WHEN full_ THEN n ELSE spoken + n END
            FROM (SELECT o.scene_id, o.i, o.paragraph_id, o.n, job, pos, spoken, pos + 1 >= 30 OR (spoken > 0 AND spoken + o.n > 40) AS full_ FROM f JOIN o ON o.scene_id = f.scene_id AND o.i = f.i + 1)),
        g AS (SELECT *, max(spoken) OVER (PARTITION BY scene_id, job) AS said FROM f)
        SELECT scene_id, scene_id || '-r' || printf('%03d', dense_rank() OVER (PARTITION BY scene_id ORDER BY job)) AS request_id, paragraph_id, CAST(pos AS INTEGER) AS pos FROM g WHERE said > 0""",
    "w_chunks": f"""WITH RECURSIVE {_N}, o AS (SELECT *, dense_rank() OVER (ORDER BY volume_id, chapter_id) AS ch, row_number() OVER (PARTITION BY volume_id, chapter_id ORDER BY paragraph_index, paragraph_id) AS i, nullif(scene_id, '') AS sc FROM p),
        f(ch, i, paragraph_id, chunk, pos, spoken, scene) AS (SELECT ch, i, paragraph_id, 0, 0, n, sc FROM o WHERE i = 1
          UNION ALL SELECT ch, i, paragraph_id, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, CASE WHEN full_ THEN 0 ELSE pos + 1 END, CASE WHEN full_ THEN n ELSE spoken + n END, CASE WHEN full_ THEN sc ELSE coalesce(scene, sc) END
            FROM (SELECT o.ch, o.i, o.paragraph_id, o.n, o.sc, chunk, pos, spoken, scene, coalesce(scene <> o.sc, false) OR pos + 2 > 16 OR spoken + o.n > 32 AS full_ FROM f JOIN o ON o.ch = f.ch AND o.i = f.i + 1)),
        z AS (SELECT volume_id, ch, max(chunk) + 1 AS size, min(paragraph_index) AS first_, any_value(chapter_id) AS chapter FROM f JOIN o USING (ch, i, paragraph_id) GROUP BY volume_id, ch),
        h AS (SELECT ch, coalesce(sum(size) OVER (PARTITION BY volume_id ORDER BY first_, chapter NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM z)
        SELECT volume_id, volume_id || '-r' || lpad(CAST(chunk + ahead + 1 AS VARCHAR), 6, '0') AS chunk_id, CAST(chunk + ahead AS INTEGER) AS chunk_index, paragraph_id, paragraph_index, CAST(pos AS INTEGER) AS pos FROM f JOIN o USING (ch, i, paragraph_id) JOIN h USING (ch)""",
    "w_select": f"SELECT dialogue_id, volume_id, dialogue_index FROM {_D} WHERE dialogue_index >= 10 QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY dialogue_index) <= 40",
    "w_windows": f"WITH {WINDOWS} SELECT dialogue_id, window_id, window_pos FROM win",
    "w_segments": f"""WITH {WINDOWS},
        g AS (SELECT *, coalesce(dialogue_kind, 'standalone') AS kd FROM win),
        h AS (SELECT *, CASE WHEN coalesce(lag(kd) OVER p <> 'standalone', false) OR coalesce(paragraph_index - lag(paragraph_index) OVER p > 3, false) THEN 1 ELSE 0 END AS ns FROM g WINDOW p AS (PARTITION BY window_id ORDER BY window_pos)),
        i AS (SELECT *, sum(ns) OVER (PARTITION BY window_id ORDER BY window_pos) AS segment FROM h)
        SELECT dialogue_id, window_id, CAST(segment AS INTEGER) AS segment, CAST(row_number() OVER (PARTITION BY window_id, segment ORDER BY window_pos) - 1 AS INTEGER) AS segment_pos FROM i WHERE kd = 'standalone'""",
    "w_narrative": f"""WITH n AS (SELECT paragraph_id, count(*) AS n FROM {_D} GROUP BY paragraph_id), t AS (SELECT scene_id, coalesce(n.n, 0) AS d, coalesce(chapter_index, 0) AS c, length({clean("text")}) AS l FROM {_P} p LEFT JOIN n ON p.paragraph_id = n.paragraph_id WHERE scene_id IS NOT NULL)
        SELECT scene_id AS chunk_id, sum(d) = 0 AND max(c) <= 0 AND (sum(l) = 0 OR (sum(l) < 220 AND max(l) < 40)) AS non_narrative FROM t GROUP BY scene_id""",
    "w_context": f"""WITH {WINDOWS}, r AS (SELECT window_id, volume_id, greatest(min(paragraph_index) - 3, 0) AS lo, max(paragraph_index) + 3 AS hi, list(DISTINCT paragraph_index) AS own FROM win GROUP BY ALL),
        s AS (SELECT window_id, volume_id, unnest(CASE WHEN hi - lo + 1 <= 48 THEN range(lo, hi + 1) ELSE list_sort(list_distinct(flatten(list_transform(own, lambda i: range(greatest(i - 3, 0), i + 4)))))[1:48] END) AS paragraph_index FROM r)
        SELECT window_id, paragraph_id FROM s JOIN {_P} p USING (volume_id, paragraph_index)""",
}
