"""Who may be speaking: names found in context, scored and cut to the best few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.sources.scratch import Scratch


#: Largest written table of names, in bytes of Parquet, that is broadcast; beyond it grams and names meet by key.
BROADCAST_BYTES = 8 << 20


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """`key, volume_id` of texts with the `name` and the other columns of names that stand in them.

    A containment join without comparing all pairs: each name is looked up by its first
    three characters (two if it has only two) among the distinct grams of a text, as an
    equi-join with the volume, and verified. Names of one character or of low signal name
    nobody. texts: `key, volume_id, text`; names: `volume_id, name, ...`. A key may have several texts; a name
    is then given once for each that has it.
    """
    asked = names.where((F.length("name") > 1) & ~F.col("name").isin(*X.LOW_SIGNAL_NAMES)).withColumn("gram", F.left("name", F.lit(3)))
    scratch = Scratch(names.sparkSession)
    asked = scratch.save(asked, "names")
    if scratch.bytes("names") <= BROADCAST_BYTES:
        asked = F.broadcast(asked)  # the grams then stay where they are
    # one pass over the text for each length; substring would count characters from the start every time
    every = lambda n: F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    grams = F.array_distinct(F.concat(every(3), every(2)))
    # a text is cut to its grams once; they travel without it, and only names of over three characters need it again
    kept = texts.where("length(text) > 1").select("key", "volume_id", "text")
    looked = kept.select("key", "volume_id", F.explode(grams).alias("gram"))
    met = looked.join(asked, ["volume_id", "gram"])
    short = met.where(F.length("name") <= 3).drop("gram")
    long = met.where(F.length("name") > 3).drop("gram").join(kept.select("key", "text"), "key").where("contains(text, name)").select(*short.columns)
    return short.unionByName(long)


def context_lines(windows: DataFrame) -> DataFrame:
    """`key, volume_id, text` for `window_id, volume_id, text`: every line of a window's contexts once, as they overlap.

    The shuffle is spread over all its partitions, however few bytes they hold: cutting
    texts to grams is much work a byte.
    """
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = windows.select(F.col("window_id").alias("key"), "volume_id", F.explode(F.split("text", "\n")).alias("text"))
    return split.where("text <> ''").repartition(n, "key").distinct()


def character_names(cards: DataFrame) -> DataFrame:
    """`volume_id, entity_id, what, name`: display name, cleaned aliases and titles that carry signal."""
    one = lambda what, names: cards.select("volume_id", "entity_id", F.lit(what).alias("what"), F.explode(names).alias("name"))
    titles = F.filter(X.unique_strings(F.col("titles")), lambda x: ~x.isin(*X.LOW_SIGNAL_TITLES))
    return one("name", F.array(X.clean_text(F.col("display_name")))).unionByName(one("alias", X.unique_strings(F.col("aliases")))).unionByName(one("title", titles))


def score_characters(windows: DataFrame, cards: DataFrame, active: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """`window_id, rank, entity_id, score`: the best characters of every window.

    windows: `window_id, volume_id, scene_id, text`, one row per context text. cards: the
    character table. active: `window_id, name` of names said to be active. Every point has
    its own equi-join; a character without any point is never paired with a window.
    """
    names = character_names(cards)
    found = mentions(context_lines(windows), names).select(F.col("key").alias("window_id"), "entity_id", "what", "name").distinct()
    points = [found.select("window_id", "entity_id", F.when(F.col("what") == "name", 8.0).when(F.col("what") == "alias", 6.0).otherwise(2.0).alias("p"))]
    scene = windows.select("window_id", "volume_id", "scene_id").distinct().where("scene_id is not null")
    for column, p in (("first_seen_scene_id", 1.0), ("latest_seen_scene_id", 1.5)):
        seen = cards.select("volume_id", "entity_id", F.col(column).alias("scene_id"))
        points.append(scene.join(seen, ["volume_id", "scene_id"]).select("window_id", "entity_id", F.lit(p).alias("p")))
    if active is not None:
        shown = windows.select("window_id", "volume_id").distinct().join(active.distinct(), "window_id")
        display = names.where("what = 'name'").select("volume_id", "entity_id", "name")
        points.append(shown.join(display, ["volume_id", "name"]).select("window_id", "entity_id", F.lit(12.0).alias("p")))
    every = points[0]
    for more in points[1:]:
        every = every.unionByName(more)
    summed = every.groupBy("window_id", "entity_id").agg(F.sum("p").alias("p"))
    weight = cards.select("entity_id", X.safe_double(F.col("confidence"), 0.5).alias("c"))
    scored = summed.join(weight, "entity_id").select("window_id", "entity_id", F.round(F.col("p") + F.col("c") * 0.1, 9).alias("score")).where("score > 0.5")
    best = Window.partitionBy("window_id").orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < limit)


def score_mysteries(contexts: DataFrame, mysteries: DataFrame, limit: int = 8) -> DataFrame:
    """`window_id, rank, mystery_id, score` for `window_id, volume_id, scene_id, text, ids ARRAY<STRING>` rows.

    mysteries: `mystery_id, volume_id, name, scene_id, evidence ARRAY<STRING>, confidence`.
    Direct evidence (8) or the name in the text (4) is needed; elsewhere than in its own
    scene (2) only evidence counts. At least one is kept.
    """
    m = mysteries.where(~X.clean_text(F.col("name")).isin(*X.LOW_SIGNAL_TITLES))
    by_name = mentions(context_lines(contexts), m.select("volume_id", X.clean_text(F.col("name")).alias("name"), "mystery_id"))
    by_name = by_name.select(F.col("key").alias("window_id"), "mystery_id", F.lit("name").alias("what"))
    ids = contexts.select("window_id", "volume_id", F.explode("ids").alias("id"))
    by_id = ids.join(m.select("volume_id", "mystery_id", F.explode("evidence").alias("id")), ["volume_id", "id"]).select("window_id", "mystery_id", F.lit("evidence").alias("what"))
    hits = by_name.unionByName(by_id).groupBy("window_id", "mystery_id").agg(F.bool_or(F.col("what") == "name").alias("n"), F.bool_or(F.col("what") == "evidence").alias("e"))
    scene = contexts.groupBy("window_id").agg(F.min("scene_id").alias("here"))
    met = hits.join(scene, "window_id").join(m.select("mystery_id", X.parent_scene(F.col("scene_id")).alias("at"), X.safe_double(F.col("confidence"), 0.5).alias("c")), "mystery_id")
    same = F.coalesce(F.col("here") == F.col("at"), F.lit(False))
    met = met.where(F.col("e") | same).withColumn("score", F.round(F.col("c") * 0.1 + F.when(same, 2.0).otherwise(0.0) + F.when(F.col("e"), 8.0).otherwise(0.0) + F.when(F.col("n"), 4.0).otherwise(0.0), 9))
    best = Window.partitionBy("window_id").orderBy(F.desc("score"), "mystery_id")
    return met.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < max(1, limit)).select("window_id", "rank", "mystery_id", "score")


def speaker_options(cards: DataFrame) -> DataFrame:
    """`entity_id, display, names, markers`: what the rules may match of a character."""
    display = X.clean_text(F.col("display_name"))
    names = X.unique_strings(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), 10)
    usable = F.filter(names, lambda x: (F.length(x) > 1) & ~x.isin(*X.LOW_SIGNAL_NAMES))
    old = F.filter(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("titles", F.array().cast("array<string>"))), lambda x: X.clean_text(x).isin(*X.SELF_PRONOUNS))
    markers = F.filter(X.unique_strings(F.concat(F.coalesce("speech_markers", F.array().cast("array<string>")), old)), X.is_usable_marker)
    rows = cards.where((display != "") & (X.clean_text(F.col("entity_id")) != ""))
    return rows.select("entity_id", "volume_id", display.alias("display"), F.when(F.size(usable) > 0, usable).otherwise(F.array(display)).alias("names"), F.slice(markers, 1, 12).alias("markers"))
