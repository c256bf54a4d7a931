"""Raw text to lines, chapters, scenes, quotes and their context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators.running import running_total


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`key, line_index, text`: non-empty stripped lines, numbered among themselves."""
    each = F.filter(F.transform(F.split(F.regexp_replace(F.col(text), "\\r\\n?", "\n"), "\n"), lambda x: X.strip(F.translate(x, "　", " "))), lambda x: x != "")
    return docs.select(key, F.posexplode(each).alias("line_index", "text"))


def chapters_and_scenes(rows: DataFrame, cap: int = 80) -> DataFrame:
    """`volume_id, line_index, paragraph_index, chapter_index, chapter_title, scene_index, text, is_structural` and the ids.

    rows: `volume_id, line_index, text`, one per line.  A title opens a chapter and its
    first scene.  A break line ends the scene it stands in; the next other line opens one.
    A scene of `cap` lines ends before its next line that isn't structural; only runs over
    the cap need that ordered fold, and it sees positions and flags, not texts.
    """
    kept = rows.where("volume_id is not null and line_index is not null").withColumn("text", X.clean_text(F.col("text"))).where("text <> ''")
    kept = kept.withColumn("title", X.is_title(F.col("text"))).withColumn("broken", X.is_break(F.col("text"))).withColumn("is_structural", X.is_structural(F.col("text")))
    kept = running_total(kept.withColumn("_t", F.col("title").cast("long")).withColumn("_one", F.lit(1).cast("long")), ["volume_id"], "line_index", "_t", "chapter_index")
    kept = running_total(kept, ["volume_id"], "line_index", "_one", "_n")
    chapter = Window.partitionBy("volume_id", "chapter_index").orderBy("line_index")
    kept = kept.withColumn("opens", F.coalesce(F.lag("broken").over(chapter), F.lit(False)) & ~F.col("broken"))
    run = chapter.rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("part", F.sum(F.col("opens").cast("long")).over(run))
    over = kept.groupBy("volume_id", "chapter_index", "part").agg(F.count("*").alias("size")).where(F.col("size") > cap).drop("size")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("line_index")
        count, new = 0, []
        for structural in g.is_structural:
            opens = count >= cap and not structural
            count = 1 if opens else count + 1
            new.append(opens)
        return pd.DataFrame({"v": g.volume_id, "l": g.line_index, "full": new})

    long_rows = kept.join(over, ["volume_id", "chapter_index", "part"], "left_semi").select("volume_id", "chapter_index", "part", "line_index", "is_structural")
    full = long_rows.groupBy("volume_id", "chapter_index", "part").applyInPandas(fold, "v string, l int, full boolean").where("full")
    kept = kept.join(full, (F.col("volume_id") == F.col("v")) & (F.col("line_index") == F.col("l")), "left")
    kept = kept.withColumn("scene_index", F.sum((F.col("opens") | F.coalesce("full", F.lit(False))).cast("int")).over(run) + 1)
    title = F.first(F.when(F.col("title"), F.col("text"))).over(chapter.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    kept = kept.withColumn("chapter_title", F.coalesce(title, F.lit("front_matter")))
    kept = kept.withColumn("chapter_id", F.concat("volume_id", F.lit("-c"), number(F.col("chapter_index"), 3)))
    kept = kept.withColumn("scene_id", F.concat("chapter_id", F.lit("-s"), number(F.col("scene_index"), 3)))
    kept = kept.withColumn("paragraph_id", F.concat("scene_id", F.lit("-p"), number(F.col("_n"), 6)))
    return kept.select("paragraph_id", "volume_id", (F.col("_n") - 1).cast("int").alias("paragraph_index"), "line_index", "chapter_id", F.col("chapter_index").cast("int").alias("chapter_index"), "chapter_title", "scene_id", F.col("scene_index").cast("int").alias("scene_index"), "text", "is_structural")


def chapter_ranges(paragraphs: DataFrame) -> DataFrame:
    """First and last paragraph of every chapter; chapter 0 is listed even without one."""
    found = paragraphs.groupBy("volume_id", "chapter_index").agg(F.min("paragraph_index").alias("start_paragraph_index"), F.max("paragraph_index").alias("end_paragraph_index"))
    front = paragraphs.select("volume_id", F.lit(0).alias("chapter_index")).distinct()
    return front.unionByName(found.select("volume_id", "chapter_index")).distinct().join(found, ["volume_id", "chapter_index"], "left").select("volume_id", "chapter_index", F.when(F.col("chapter_index") == 0, 0).otherwise(F.col("start_paragraph_index")).alias("start_paragraph_index"), "end_paragraph_index")


def dialogues(paragraphs: DataFrame) -> DataFrame:
    """Every quote of `paragraph_id, text`: position in code points, kind, and the text around it."""
    quotes = F.regexp_extract_all(F.col("text"), F.lit(X.QUOTE), 0)
    gaps = F.transform(F.split(F.col("text"), X.QUOTE.replace("(", "").replace(")", "")), lambda x: F.length(x))
    rows = paragraphs.where(F.col("text").contains("「")).select("paragraph_id", "text", F.posexplode(quotes).alias("local_dialogue_index", "quote_text"), quotes.alias("_q"), gaps.alias("_g"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda z, x: z + x)
    n = F.col("local_dialogue_index")
    start = total(F.slice("_g", F.lit(1), n + 1)) + total(F.transform(F.slice("_q", F.lit(1), n), lambda x: F.length(x)))
    rows = rows.withColumn("char_start", start).withColumn("char_end", start + F.length("quote_text"))
    inner = X.strip(F.expr("substring(quote_text, 2, length(quote_text) - 2)"))
    return rows.select("paragraph_id", "local_dialogue_index", inner.alias("quote"), "quote_text", "char_start", "char_end", X.dialogue_kind(F.col("text"), F.col("char_start"), F.col("char_end")).alias("dialogue_kind"), X.outside_quote(F.col("text"), F.col("char_start"), F.col("char_end")).alias("outside"))


def neighbours(rows: DataFrame, group: str, index: str, value: str, before: int, after: int) -> DataFrame:
    """`group, index, prev ARRAY, next ARRAY`: the k values before and after, by equi-join on the position.

    The positions of a group are consecutive numbers, so no window has to sort the group.
    """
    offsets = [i for i in range(-before, after + 1) if i]
    sent = rows.select(group, F.col(index).alias("_i"), value, F.explode(F.array(*map(F.lit, offsets))).alias("_off")).withColumn(index, F.col("_i") - F.col("_off"))
    near = sent.groupBy(group, index).agg(F.array_sort(F.collect_list(F.struct("_off", value))).alias("_near"))
    pick = lambda low: F.transform(F.filter(F.coalesce("_near", F.array().cast(f"array<struct<_off:int,{value}:string>>")), lambda x: (x["_off"] < 0) if low else (x["_off"] > 0)), lambda x: x[value])
    return rows.select(group, index).join(near, [group, index], "left").select(group, index, pick(True).alias("prev"), pick(False).alias("next"))


def scenes(paragraphs: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per scene: range of paragraphs, their number, the number of quotes, first and last ids."""
    spoken = quotes.groupBy("scene_id").agg(F.count("*").alias("n_dialogues"))
    found = paragraphs.where("scene_id is not null").groupBy("scene_id").agg(
        F.min("paragraph_index").alias("start_paragraph_index"), F.max("paragraph_index").alias("end_paragraph_index"), F.count("*").alias("n_paragraphs"),
        F.min_by("paragraph_id", "paragraph_index").alias("first_paragraph_id"), F.max_by("paragraph_id", "paragraph_index").alias("last_paragraph_id"),
    )
    return found.join(spoken, "scene_id", "left").fillna(0, ["n_dialogues"])


def volumes(paragraphs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Counts per volume."""
    spoken = quotes.groupBy("volume_id").agg(F.count("*").alias("dialogues"))
    found = paragraphs.groupBy("volume_id").agg(F.count("*").alias("paragraphs"), F.count_distinct("scene_id").alias("scenes"), F.count_distinct("chapter_id").alias("chapters"))
    return found.join(spoken, "volume_id", "left").fillna(0, ["dialogues"])


