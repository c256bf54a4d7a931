"""Dialogue windows, alternation segments, packed requests and reading chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X


def select_range(dialogues: DataFrame, start: int, limit: int) -> DataFrame:
    """The first `limit` dialogues of every volume from index `start` on; a limit below 1 selects none."""
    first = Window.partitionBy("volume_id").orderBy("dialogue_index")
    return dialogues.where(F.col("dialogue_index") >= start).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(0, limit)).drop("_n")


def dialogue_windows(dialogues: DataFrame, size: int = 8, gap: int = 4) -> DataFrame:
    """Adds `window_id, window_pos`: windows end at scenes, at paragraph gaps over `gap` (off if 0), and when full.

    Scenes never span chapters, so windows are found chapter by chapter.
    """
    chapter = Window.partitionBy("volume_id", "chapter_id").orderBy("dialogue_index", "dialogue_id")
    wide = (F.col("paragraph_index") - F.lag("paragraph_index").over(chapter) > gap) if gap > 0 else F.lit(False)
    new = F.coalesce(wide, F.lit(False)) | ~F.lag("scene_id").over(chapter).eqNullSafe(F.col("scene_id"))
    islands = dialogues.withColumn("_new", new.cast("int"))
    islands = islands.withColumn("_i", F.sum("_new").over(chapter.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("volume_id", "chapter_id", "_i")
    islands = islands.withColumn("_k", F.row_number().over(island.orderBy("dialogue_index", "dialogue_id")) - 1).withColumn("_w", F.floor(F.col("_k") / size))
    one = Window.partitionBy("volume_id", "chapter_id", "_i", "_w")
    first = F.min_by("dialogue_id", F.struct("dialogue_index", "dialogue_id")).over(one)
    last = F.max_by("dialogue_id", F.struct("dialogue_index", "dialogue_id")).over(one)
    return islands.withColumn("window_id", F.when(first == last, first).otherwise(F.concat_ws("_to_", first, last))).withColumn("window_pos", (F.col("_k") % size).cast("int")).drop("_i", "_new", "_k", "_w")


def alternation_segments(dialogues: DataFrame, gap: int = 3) -> DataFrame:
    """`dialogue_id, window_id, segment, segment_pos` of standalone lines: an inline line or a wide gap ends a segment.

    dialogues carry `window_id, window_pos`; segments stay inside their window.
    """
    window = Window.partitionBy("window_id").orderBy("window_pos")
    kind = F.coalesce("dialogue_kind", F.lit("standalone"))
    wide = F.coalesce(F.col("paragraph_index") - F.lag("paragraph_index").over(window) > gap, F.lit(False))
    new = wide | F.coalesce(F.lag(kind).over(window) != "standalone", F.lit(False))
    runs = dialogues.withColumn("_k", kind).withColumn("_n", new.cast("int")).withColumn("segment", F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, 0))).where("_k = 'standalone'")
    return runs.withColumn("segment_pos", F.row_number().over(Window.partitionBy("window_id", "segment").orderBy("window_pos")) - 1).select("dialogue_id", "window_id", F.col("segment").cast("int").alias("segment"), "segment_pos")


def pack_requests(paragraphs: DataFrame, max_paragraphs: int = 30, max_dialogues: int = 40) -> DataFrame:
    """`scene_id, request_id, paragraph_id, pos` for `scene_id, paragraph_index, paragraph_id, n_dialogues`.

    Greedy in order; an oversized paragraph stays whole, a request without a quote is
    dropped. The fold sees one small row per paragraph of a scene, no text.
    """
    mp, md = max(1, max_paragraphs), max(1, max_dialogues)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["paragraph_index", "paragraph_id"])
        out, now, spoken, job = [], [], 0, 0

        def flush() -> None:
            nonlocal now, spoken, job
            if spoken:
                job += 1
                out.extend((p, job, i) for i, p in enumerate(now))
            now, spoken = [], 0

        for p, n in zip(g.paragraph_id, g.n_dialogues):
            if now and (len(now) >= mp or (spoken and spoken + n > md)):
                flush()
            now.append(p)
            spoken += n
        flush()
        scene = g.scene_id.iloc[0]
        return pd.DataFrame([(scene, f"{scene}-r{j:03d}", p, i) for p, j, i in out], columns=["scene_id", "request_id", "paragraph_id", "pos"])

    return paragraphs.where("scene_id is not null").select("scene_id", "paragraph_index", "paragraph_id", "n_dialogues").groupBy("scene_id").applyInPandas(fold, "scene_id string, request_id string, paragraph_id string, pos int")


def reading_chunks(paragraphs: DataFrame, max_paragraphs: int = 16, max_dialogues: int = 32) -> DataFrame:
    """`volume_id, chunk_id, chunk_index, paragraph_id, paragraph_index, pos`: all paragraphs, packed in order within scenes.

    paragraphs: `volume_id, chapter_id, scene_id, paragraph_index, paragraph_id,
    n_dialogues`. Chapters are folded on their own, a chapter always ends a chunk; chunk
    numbers are a running count over the chapters.
    """
    mp, md = max(1, max_paragraphs), max(1, max_dialogues)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["paragraph_index", "paragraph_id"])
        chunk, size, spoken, scene, out = 0, 0, 0, None, []
        for p, i, s, n in zip(g.paragraph_id, g.paragraph_index, g.scene_id, g.n_dialogues):
            s = s if isinstance(s, str) and s else None
            if size and ((scene and s and s != scene) or size + 1 > mp or spoken + n > md):
                chunk, size, spoken, scene = chunk + 1, 0, 0, None
            out.append((p, i, chunk, size))
            size, spoken, scene = size + 1, spoken + n, scene or s
        frame = pd.DataFrame(out, columns=["paragraph_id", "paragraph_index", "_c", "pos"])
        return frame.assign(volume_id=g.volume_id.iloc[0], chapter_id=g.chapter_id.iloc[0])[["volume_id", "chapter_id", "paragraph_id", "paragraph_index", "_c", "pos"]]

    folded = paragraphs.groupBy("volume_id", "chapter_id").applyInPandas(fold, "volume_id string, chapter_id string, paragraph_id string, paragraph_index int, _c int, pos int")
    sizes = folded.groupBy("volume_id", F.col("chapter_id").alias("_ch")).agg((F.max("_c") + 1).alias("_n"), F.min("paragraph_index").alias("_first"))
    ahead = F.sum("_n").over(Window.partitionBy("volume_id").orderBy("_first", "_ch").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("volume_id").alias("_v"), "_ch", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    met = folded.join(sizes, (F.col("volume_id") == F.col("_v")) & F.col("chapter_id").eqNullSafe(F.col("_ch")))
    number = (F.col("_c") + F.col("_ahead")).cast("int")
    return met.select("volume_id", F.concat("volume_id", F.lit("-r"), F.lpad((number + 1).cast("string"), 6, "0")).alias("chunk_id"), number.alias("chunk_index"), "paragraph_id", "paragraph_index", "pos")


def select_chunks(chunks: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of the first `limit` chunks of every volume from chunk `start` on; no limit takes all, one below 1 none."""
    kept = chunks.where(F.col("chunk_index") >= start)
    if limit is None:
        return kept
    order = F.dense_rank().over(Window.partitionBy("volume_id").orderBy("chunk_index"))
    return kept.withColumn("_n", order).where(F.col("_n") <= max(0, limit)).drop("_n")


def non_narrative(chunks: DataFrame) -> DataFrame:
    """`chunk_id, non_narrative` for `chunk_id, chapter_index, text, n_dialogues` rows: no quotes, front matter, and little text."""
    n = F.length(X.clean_text(F.col("text")))
    found = chunks.groupBy("chunk_id").agg(F.sum("n_dialogues").alias("d"), F.max(F.coalesce("chapter_index", F.lit(0))).alias("c"), F.sum(n).alias("n"), F.max(n).alias("longest"))
    return found.select("chunk_id", ((F.col("d") == 0) & (F.col("c") <= 0) & ((F.col("n") == 0) | ((F.col("n") < 220) & (F.col("longest") < 40)))).alias("non_narrative"))


def window_context(windows: DataFrame, paragraphs: DataFrame, radius: int = 3, cap: int = 48) -> DataFrame:
    """`window_id, paragraph_id`: the paragraphs around a window, as an equi-join on positions.

    windows: one row per dialogue with `window_id, volume_id, paragraph_index`. If the
    range is longer than `cap`, the paragraphs around each single dialogue are taken, the
    first `cap` of them by position.
    """
    span = windows.groupBy("window_id", "volume_id").agg(F.min("paragraph_index").alias("lo"), F.max("paragraph_index").alias("hi"), F.collect_set("paragraph_index").alias("own"))
    span = span.withColumn("lo", F.greatest(F.col("lo") - radius, F.lit(0))).withColumn("hi", F.col("hi") + radius)
    near = F.array_sort(F.array_distinct(F.flatten(F.transform("own", lambda i: F.sequence(F.greatest(i - radius, F.lit(0)), i + radius)))))
    positions = F.when(F.col("hi") - F.col("lo") + 1 <= cap, F.sequence("lo", "hi")).otherwise(F.slice(near, 1, cap))
    wanted = span.where("lo is not null").select("window_id", "volume_id", F.explode(positions).alias("paragraph_index"))
    return wanted.join(paragraphs.select("volume_id", "paragraph_index", "paragraph_id"), ["volume_id", "paragraph_index"]).select("window_id", "paragraph_id")
