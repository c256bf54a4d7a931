"""Deterministic votes: who speaks by what the text around a line says.

All rules work on two tables: `lines` (one row per dialogue of a window) and `options`
(the few speakers a window can have). Each rule is a join of the two on the window, a
predicate, and the first hit by rank; the cascade is a coalesce in order of trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators.votes import INTRO, RULE_FLOOR, VERBS, attribution_pattern, quoted

# Fixed values of the rules.
MODEL, SURE, BY_MARKER, BY_TURN = "rule:context", 0.98, 0.86, RULE_FLOOR
ADDRESS = "先生|小姐|大人|阁下|夫人"
REACTIONS = ("被询问", "被问", "被这么一问", "被追问", "被提问")
VILLAGE, VILLAGER = ("小村落", "深山", "山里的村民", "村落", "村民"), "小村落的村民"

SPEAKER = "struct<entity_id:string,display:string,status:string,confidence:double,rule:string>"


def lines(dialogues: DataFrame) -> DataFrame:
    """`dialogue_id, window_id, window_pos, text, kind, outside, after, narration, context` from dialogues with their window."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<text:string>>")), lambda x: X.clean_text(x["text"])), lambda x: x != "")
    d = dialogues.withColumn("_n", clean(F.col("next_context"))).withColumn("_p", clean(F.col("prev_context"))).withColumn("outside", X.outside_quote(F.col("paragraph_text"), F.col("char_start"), F.col("char_end")))
    quote = F.expr("array_position(transform(_n, x -> contains(x, '「') or contains(x, '」')), true)")
    after = F.slice("_n", F.lit(1), F.when(quote > 0, F.least(quote.cast("int") - 1, F.lit(2))).otherwise(2))
    context = F.concat_ws("\n", X.clean_text(F.col("text")), X.clean_text(F.col("paragraph_text")), "outside", F.array_join("_p", "\n"), F.array_join("_n", "\n"))
    return d.select("dialogue_id", "window_id", "window_pos", "volume_id", "paragraph_index", X.clean_text(F.col("text")).alias("text"), F.coalesce("dialogue_kind", F.lit("standalone")).alias("kind"),
                    F.filter(F.concat(F.array("outside"), after), lambda x: x != "").alias("narration"), F.array_join(F.slice("_n", 1, 2), "\n").alias("after"), context.alias("context"))


def option_names(options: DataFrame) -> DataFrame:
    return options.select("window_id", "rank", "entity_id", "display", F.posexplode("names").alias("name_pos", "name"))


def _speaker(entity: Column, display: Column, confidence: float, rule: str, status: str = "known") -> Column:
    return F.struct(entity.alias("entity_id"), display.alias("display"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))


def self_introductions(rows: DataFrame, options: DataFrame) -> DataFrame:
    """The first option whose name follows an introduction in the line itself."""
    met = rows.where("kind = 'standalone'").join(option_names(options), "window_id").where("contains(text, name)")
    met = met.withColumn("_until", F.expr("left(text, instr(text, name) + length(name) - 1)")).where(X.any_of(F.col("_until"), list(INTRO)))
    return met.groupBy("dialogue_id").agg(F.min_by(_speaker(F.col("entity_id"), F.col("display"), SURE, "self_intro"), F.struct("rank", "name_pos")).alias("s"))


def by_marker(rows: DataFrame, options: DataFrame) -> DataFrame:
    """The one option that owns, alone in its window, a speech marker of the line."""
    marker = options.select("window_id", "entity_id", "display", F.explode("markers").alias("marker"))
    owned = marker.groupBy("window_id", "marker").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"), F.min("display").alias("display")).where("n = 1").drop("n")
    met = rows.where("kind = 'standalone'").join(owned, "window_id").where("contains(text, marker)")
    met = met.where((F.length("marker") > 1) | F.rlike("text", F.concat(quoted(F.col("marker")), F.lit("(?!们)"))))
    one = met.groupBy("dialogue_id").agg(F.count_distinct("entity_id").alias("n"), F.min(F.struct("entity_id", "display")).alias("o")).where("n = 1")
    return one.select("dialogue_id", _speaker(F.col("o.entity_id"), F.col("o.display"), BY_MARKER, "marker").alias("s"))


def marker_owners(rows: DataFrame, options: DataFrame) -> DataFrame:
    """`dialogue_id, owners, listed`: the options that own, alone in their window, a marker of the line, in order of rank; and all options of the window."""
    marker = options.select("window_id", "rank", "entity_id", "display", F.explode("markers").alias("marker"))
    owned = marker.groupBy("window_id", "marker").agg(F.count_distinct("entity_id").alias("n"), F.min(F.struct("rank", "entity_id", "display")).alias("o")).where("n = 1").drop("n")
    met = rows.where("kind = 'standalone'").join(owned, "window_id").where("contains(text, marker)")
    met = met.where((F.length("marker") > 1) | F.rlike("text", F.concat(quoted(F.col("marker")), F.lit("(?!们)"))))
    found = met.groupBy("dialogue_id", "window_id").agg(F.array_sort(F.collect_set("o")).alias("owners"))
    listed = options.groupBy("window_id").agg(F.collect_set("entity_id").alias("listed"))
    return found.join(listed, "window_id").select("dialogue_id", "owners", "listed")


def by_attribution(rows: DataFrame, options: DataFrame) -> DataFrame:
    """The option that the nearest narration names before a verb of speech; the earliest match in it wins."""
    told = rows.where("kind = 'standalone'").select("dialogue_id", "window_id", F.posexplode("narration").alias("ctx", "said"))
    met = told.join(option_names(options), "window_id").where("contains(said, name)")
    # a pattern is made of the name only where the verb stands in the text at all
    hits = F.array(*[F.when(F.contains("said", F.lit(v)), F.regexp_substr("said", attribution_pattern(F.col("name"), v))) for v in (*VERBS, "念着", "打招呼")])
    met = met.withColumn("hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    start = F.expr("instr(said, hit)")
    order = F.struct("ctx", start, start + F.length("hit"), -F.length("name"), F.col("rank"))
    return met.groupBy("dialogue_id").agg(F.min_by(_speaker(F.col("entity_id"), F.col("display"), SURE, "attribution"), order).alias("s"))


def counterparts(rows: DataFrame, options: DataFrame, named: DataFrame, rule: str) -> DataFrame:
    """The speaker opposite the one a line is about.

    named: `dialogue_id, entity_id, order`. The only other option mentioned in the context
    speaks, else the only other option, else a villager where the context is the village.
    The first by order that has a counterpart counts.
    """
    seen = option_names(options).join(rows.select("dialogue_id", "window_id", "context"), "window_id")
    seen = seen.groupBy("dialogue_id", "entity_id", "display").agg(F.bool_or(F.contains(F.col("context"), F.col("name")) & (F.length("name") > 1)).alias("here"))
    every = seen.groupBy("dialogue_id").agg(F.collect_list(F.struct("entity_id", "display", "here")).alias("opts"))
    met = named.join(every, "dialogue_id").join(rows.select("dialogue_id", "context"), "dialogue_id")
    met = met.withColumn("others", F.filter("opts", lambda o: o["entity_id"] != F.col("entity_id"))).withColumn("near", F.filter("others", lambda o: o["here"]))
    pick = lambda o: _speaker(o["entity_id"], o["display"], SURE, rule)
    villager = _speaker(F.lit(f"npc:{VILLAGER}"), F.lit(VILLAGER), SURE, rule, "npc")
    who = F.when(F.size("near") == 1, pick(F.get("near", F.lit(0)))).when(F.size("others") == 1, pick(F.get("others", F.lit(0)))).when(X.any_of(F.col("context"), list(VILLAGE)), villager)
    return met.withColumn("who", who).where("who is not null").groupBy("dialogue_id").agg(F.min_by("who", "order").alias("s"))


def addressed(rows: DataFrame, options: DataFrame) -> DataFrame:
    """`dialogue_id, entity_id, order` of the options a line addresses: name with a title, or name and then you."""
    met = rows.where("kind = 'standalone'").join(option_names(options), "window_id").where("contains(text, name)")
    called = F.concat(quoted(F.col("name")), F.lit(f"(?:(?:{ADDRESS})|[，、。！？!\\s]*[你您])"))
    return met.where(F.rlike("text", called)).select("dialogue_id", "entity_id", F.struct("rank", "name_pos").alias("order"))


def asked(rows: DataFrame, options: DataFrame) -> DataFrame:
    """`dialogue_id, entity_id, order` of the option that reacts to a question right after it, the nearest to the reaction."""
    r = rows.where("kind = 'standalone' and (contains(text, '？') or contains(text, '?'))").where(X.any_of(F.col("after"), list(REACTIONS)))
    met = r.join(option_names(options), "window_id").where("contains(after, name)")
    at = F.expr("instr(after, name)")
    spots = F.filter(F.array(*[F.expr(f"instr(after, '{m}')") for m in REACTIONS]), lambda p: p > 0)
    cost = lambda p: F.abs(p - at) + F.when(at > p, 20).otherwise(0)
    ranked = met.withColumn("order", F.struct(F.array_min(F.transform(spots, cost)).alias("d"), (-F.length("name")).alias("l"), F.col("rank").alias("r")))
    return ranked.groupBy("dialogue_id").agg(F.min_by("entity_id", "order").alias("entity_id"), F.min("order").alias("order"))


def anchors(rows: DataFrame, options: DataFrame) -> DataFrame:
    """`dialogue_id, s`: the cascade of the explicit rules."""
    ways = [
        self_introductions(rows, options),
        by_marker(rows, options),
        by_attribution(rows, options),
        counterparts(rows, options, asked(rows, options), "listener"),
        counterparts(rows, options, addressed(rows, options), "addressed"),
    ]
    every = None
    for i, w in enumerate(ways):
        w = w.select("dialogue_id", F.lit(i).alias("way"), F.col("s").cast(SPEAKER).alias("s"))
        every = w if every is None else every.unionByName(w)
    return every.groupBy("dialogue_id").agg(F.min_by("s", "way").alias("s"))


def alternation(rows: DataFrame, options: DataFrame, segments: DataFrame, found: DataFrame) -> DataFrame:
    """`dialogue_id, s` of unanchored lines of a segment in which two speakers take turns.

    A segment needs anchors of one or two speakers that agree by parity, two of them if it
    has more than six lines. With one anchored speaker the other is the only other option
    its context mentions, or a villager.
    """
    seg = segments.join(rows.select("dialogue_id", "context"), "dialogue_id").join(found, "dialogue_id", "left")
    seg = seg.withColumn("id", F.concat_ws("#", "window_id", F.col("segment").cast("string")))
    per = seg.groupBy("id", "window_id").agg(
        F.count("*").alias("size"), F.count("s").alias("n_anchors"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("segment_pos"))).alias("ref"), F.min(F.when(F.col("s").isNotNull(), F.col("segment_pos"))).alias("ref_pos"),
        F.array_sort(F.collect_set("s.entity_id")).alias("who"), F.array_join(F.array_sort(F.collect_list(F.struct("segment_pos", "context"))).getField("context"), "\n").alias("context"),
    )
    per = per.where("n_anchors > 0 and size(who) <= 2 and (size <= 6 or n_anchors >= 2)")
    near = option_names(options).join(per.select("id", "window_id", "context", F.col("ref.entity_id").alias("me")), "window_id").where("entity_id <> me and contains(context, name) and length(name) > 1")
    near = near.select("id", "entity_id", "display").distinct().groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("entity_id", "display")).alias("o")).where("n = 1").select("id", _speaker(F.col("o.entity_id"), F.col("o.display"), BY_TURN, "turns").cast(SPEAKER).alias("near"))
    second = seg.where("s is not null").join(per.select("id", F.col("ref.entity_id").alias("me")), "id").where("s.entity_id <> me").groupBy("id").agg(F.min_by("s", "segment_pos").alias("second"))
    villager = _speaker(F.lit(f"npc:{VILLAGER}"), F.lit(VILLAGER), BY_TURN, "turns", "npc").cast(SPEAKER)
    per = per.join(second, "id", "left").join(near, "id", "left")
    other = F.coalesce("second", "near", F.when(X.any_of(F.col("context"), list(VILLAGE)) & (F.col("ref.entity_id") != f"npc:{VILLAGER}"), villager))
    per = per.select("id", "ref", "ref_pos", other.alias("other")).where("other is not null")
    turn = seg.join(per, "id").withColumn("due", F.when((F.col("segment_pos") - F.col("ref_pos")) % 2 == 0, F.col("ref")).otherwise(F.col("other")))
    steady = F.bool_and(F.coalesce(F.col("s.entity_id") == F.col("due.entity_id"), F.lit(True))).over(Window.partitionBy("id"))
    turn = turn.withColumn("steady", steady).where("steady and s is null")
    return turn.select("dialogue_id", _speaker(F.col("due.entity_id"), F.col("due.display"), BY_TURN, "turns").cast(SPEAKER).withField("status", F.col("due.status")).alias("s"))


def rule_votes(rows: DataFrame, options: DataFrame, segments: DataFrame) -> DataFrame:
    """Votes of the rules: explicit ones where there are any, else by turns."""
    found = anchors(rows, options)
    both = found.withColumn("o", F.lit(0)).unionByName(alternation(rows, options, segments, found).withColumn("o", F.lit(1)))
    one = both.groupBy("dialogue_id").agg(F.min_by("s", "o").alias("s"))
    return one.select("dialogue_id", F.lit(MODEL).alias("model"), F.lit(1.0).alias("weight"), F.col("s.entity_id").alias("speaker_entity_id"), F.col("s.display").alias("speaker_display"), F.col("s.status").alias("speaker_status"), F.col("s.confidence").alias("confidence"), F.col("s.rule").alias("rule"))
