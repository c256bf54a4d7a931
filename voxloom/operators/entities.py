"""The entity store: upserts, merges, backfill, pending mysteries and their expiry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators.graph import groups

MERGE_FLOOR, TTL_CHUNKS, MAX_PENDING, MAX_CANDIDATES = 0.85, 12, 8, 12

STORED = "volume_id string, first_record string, record_ids array<string>, display_name string, aliases array<string>, titles array<string>, speech_markers array<string>, confidence double, first_seen_scene_id string, latest_seen_scene_id string"


def alias_table(cards: DataFrame) -> DataFrame:
    """Distinct `entity_id, alias` with the position of the first occurrence."""
    rows = cards.select("entity_id", F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("pos", "a"))
    return rows.select("entity_id", X.clean_name(F.col("a")).alias("alias"), "pos").where("alias <> ''").groupBy("entity_id", "alias").agg(F.min("pos").alias("pos"))


def upsert_characters(cards: DataFrame) -> DataFrame:
    """The character store after all cards of a volume were upserted in order of `seq`, then id.

    A card joins the entity that owns one of its keys, else one with a related key (one
    name ends with the other), else it is new; the order matters.  Cards can only meet if
    a chain of equal or related keys links them, so the ordered fold runs per such group,
    not per volume. cards: `entity_id, volume_id, seq, display_name, aliases, titles,
    speech_markers, confidence, first_seen_scene_id`. Cards without a name are left out.
    """
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    c = cards.withColumn("name", X.clean_name(F.col("display_name"))).where("name <> '' and entity_id is not null")
    raw = F.array_sort(F.array_distinct(F.filter(F.transform(texts("aliases"), X.clean_name), lambda x: x != "")))
    c = c.withColumn("_raw", raw).withColumn("al", F.filter("_raw", X.is_safe_key))
    c = c.withColumn("ti", F.array_sort(F.array_union(F.filter(F.transform(texts("titles"), X.clean_name), lambda x: x != ""), F.array_except("_raw", "al"))))
    c = c.withColumn("mk", F.slice(F.filter(X.unique_strings(F.col("speech_markers")), X.is_useful_marker), 1, 20))
    c = c.select("entity_id", "volume_id", "seq", "name", "al", "ti", "mk", X.safe_double(F.col("confidence"), 0.5).alias("conf"), F.col("first_seen_scene_id").alias("scene"))
    keys = c.select("volume_id", F.concat_ws("|", F.lit("c"), "entity_id").alias("a"), F.explode(F.array_distinct(F.concat(F.array("name"), "al"))).alias("k"))
    node = lambda k: F.concat_ws("|", F.lit("k"), F.coalesce("volume_id", F.lit("")), k)
    known = keys.where(X.is_safe_key(F.col("k")) & (F.length("k") >= 3)).select("volume_id", "k").distinct()
    ends = known.select("volume_id", F.col("k").alias("long"), F.explode(F.expr("transform(sequence(3, length(k)), n -> right(k, n))")).alias("k")).where("long <> k")
    related = ends.join(known, ["volume_id", "k"]).select(node(F.col("long")).alias("a"), node(F.col("k")).alias("b"))
    met = groups(keys.select("a", node(F.col("k")).alias("b")).unionByName(related)).where("node like 'c|%'").select(F.substring("node", 3, 1 << 30).alias("entity_id"), "group")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        # ends: every end, of three characters or more, of a key that may be related, with its earliest owner
        store, owner, ends = [], {}, {}
        for r in g.sort_values(["seq", "entity_id"], na_position="first").itertuples():
            mine = [r.name, *r.al]
            hit = min((owner[k] for k in mine if k in owner), default=None)
            if hit is None:
                usable = [k for k in mine if _may_relate(k)]
                longer = [ends[k] for k in usable if k in ends]
                shorter = [owner[k[-n:]] for k in usable for n in range(3, len(k)) if k[-n:] in owner and _may_relate(k[-n:])]
                hit = min([*longer, *shorter], default=None)
            if hit is None:
                hit = len(store)
                store.append([r.volume_id, r.entity_id, [], r.name, [], [], [], r.conf, r.scene, r.scene])
            s = store[hit]
            s[2].append(r.entity_id)
            s[4] = sorted({*s[4], *r.al})[:20]
            s[5] = sorted({*s[5], *r.ti})[:20]
            s[6] = list(dict.fromkeys([*s[6], *r.mk]))[:20]
            s[7], s[9] = max(s[7], r.conf), r.scene
            for k in (r.name, *s[4]):
                owner[k] = hit
                for n in range(3, len(k) + 1) if _may_relate(k) else ():
                    ends[k[-n:]] = min(hit, ends.get(k[-n:], hit))
        return pd.DataFrame(store, columns=[x.strip().split()[0] for x in STORED.split(", ")])

    return c.join(met, "entity_id").groupBy("group").applyInPandas(fold, STORED)


def _may_relate(k: str) -> bool:
    return len(k) > 2 and k not in X.GENERIC_NAMES


def merges(edges: DataFrame, floor: float = MERGE_FLOOR) -> DataFrame:
    """`source, target, edge_id` of the merges that happen when the sure edges are taken in order of `edge_id`, then ids.

    Both ends are resolved through the merges before, so after A to B a sure edge A to C
    merges B into C; an edge inside one entity changes nothing. A source stands once, and
    no cycle can arise. The ordered fold runs per connected component of sure edges and
    sees ids only, the first edge of every two entities.
    """
    source, target = F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target")
    sure = edges.where((X.clamp(X.safe_double(F.col("confidence"), 0.0), 0.0, 1.0) >= floor) & F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull() & (F.col("source_entity_id") != F.col("target_entity_id")))
    first = sure.select(source, target, "edge_id").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min(F.struct("edge_id", "target", "source")).alias("e"))
    schema = f"source string, target string, edge_id {first.schema['e'].dataType['edge_id'].dataType.simpleString()}"

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        into, out = {}, []

        def end(x: str) -> str:
            while x in into:
                into[x] = x = into.get(into[x], into[x])
            return x

        for r in g.sort_values(["edge_id", "target", "source"]).itertuples():
            s, t = end(r.source), end(r.target)
            if s != t:
                into[s] = t
                out.append((s, t, r.edge_id))
        return pd.DataFrame(out, columns=["source", "target", "edge_id"])

    pairs = first.select("a", "b")
    return first.join(groups(pairs).withColumnRenamed("node", "a"), "a").select("group", "e.*").groupBy("group").applyInPandas(fold, schema)


def merge_cards(cards: DataFrame, resolved: DataFrame, merged: DataFrame) -> DataFrame:
    """One card per resolved entity: names of all, counts summed, the highest importance, the latest chunk, summaries and evidence.

    merged: what `merges` gives; the summary and, if the cards have it, `evidence_refs`
    grow in order of the merges.
    """
    proof = "evidence_refs" in cards.columns
    refs = X.unique_strings(F.col("evidence_refs")) if proof else F.array().cast("array<string>")
    met = cards.join(resolved, cards.entity_id == resolved.node, "left").withColumn("into", F.coalesce("resolved", "entity_id")).withColumn("_s", X.clean_text(F.col("summary"))).withColumn("_e", refs)
    names, own = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.col("entity_id") == F.col("into")
    found = met.groupBy("into").agg(
        F.count("*").alias("merged"), F.sum(F.coalesce("dialogue_count", F.lit(0))).alias("dialogue_count"), F.max(X.importance_level(F.col("importance"))).alias("level"),
        F.max(X.chunk_number(F.col("latest_seen_chunk_id"))).alias("latest_chunk"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(X.unique_strings(names))))).alias("names"),
        F.max(F.when(own, F.col("_s"))).alias("_s"), F.max(F.when(own, F.slice("_e", 1, 24))).alias("_e"),
    )
    nothing = F.lit(None).cast("string")
    held = met.where("node is not null").select("into", F.lit(None).cast(merged.schema["edge_id"].dataType).alias("edge_id"), F.col("entity_id").alias("id"), nothing.alias("target"), F.col("entity_type").isin("npc", "npc_group").alias("many"), "_s", "_e")
    moves = merged.join(resolved, merged.target == resolved.node).select(F.col("resolved").alias("into"), "edge_id", F.col("source").alias("id"), "target", F.lit(None).cast("boolean").alias("many"), nothing.alias("_s"), F.lit(None).cast("array<string>").alias("_e"))
    texts = held.unionByName(moves).groupBy("into").applyInPandas(_merge_texts, "into string, summary string, evidence_refs array<string>")
    out = found.join(texts, "into", "left").withColumn("summary", F.coalesce("summary", "_s", F.lit(""))).withColumn("evidence_refs", F.coalesce("evidence_refs", "_e", F.array().cast("array<string>")))
    out = out.withColumn("importance", F.element_at(F.array(*map(F.lit, X.IMPORTANCE)), F.col("level") + 1)).withColumnRenamed("into", "entity_id").drop("level", "_s", "_e")
    return out if proof else out.drop("evidence_refs")


def _merge_texts(g: pd.DataFrame) -> pd.DataFrame:
    """Summary and evidence of one resolved entity after its merges in order of their edges."""
    cards, into = g[g.target.isna()], g["into"].iloc[0]
    text, many, proof = dict(zip(cards.id, cards._s)), dict(zip(cards.id, cards.many)), {i: list(e) for i, e in zip(cards.id, cards._e)}
    for r in g[g.target.notna()].sort_values("edge_id").itertuples(index=False, name=None):
        s, t = r[2], r[3]
        more, now = text.get(s) or "", text.get(t) or ""
        if more and more not in now:
            now, most = " ".join(x for x in (now, more) if x), 120 if many.get(t) else 180
            text[t] = now if len(now) <= most else now[: most - 1] + "…"
        proof[t] = list(dict.fromkeys([*proof.get(t, []), *proof.get(s, [])]))[:24]
    return pd.DataFrame({"into": [into], "summary": [text.get(into) or ""], "evidence_refs": [proof.get(into, [])[:24]]})


def apply_merges(annotations: DataFrame, resolved: DataFrame, cards: DataFrame, floor: float = 0.92) -> DataFrame:
    """Annotations whose speaker was merged, earlier ones too, take the resolved entity; the rest stay.

    annotations: `dialogue_id, speaker_entity_id, speaker_display, speaker_status, confidence, evidence`.
    """
    card = cards.select(F.col("entity_id").alias("_id"), F.col("display_name").alias("_name"), F.col("entity_type").alias("_type"))
    met = annotations.join(resolved.where("node <> resolved"), annotations.speaker_entity_id == resolved.node, "left").join(card, F.col("resolved") == F.col("_id"), "left")
    hit, known = F.col("resolved").isNotNull(), F.col("_id").isNotNull()
    status = F.when(F.col("_type").isin("character", "known"), "known").when(F.col("_type") == "mystery", "mystery").when(F.col("_type").isin("npc", "npc_group"), "npc_group").otherwise("unknown")
    note = F.concat(F.lit("实体别名归一："), "speaker_entity_id", F.lit(" -> "), "resolved")
    out = met.withColumn("evidence", F.when(known, X.unique_strings(F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.array(note)), 6)).otherwise(F.col("evidence")))
    out = out.withColumn("confidence", F.when(known, X.clamp(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(floor)), 0.0, 1.0)).otherwise(F.col("confidence")))
    out = out.withColumn("speaker_display", F.when(known, F.coalesce(F.nullif("_name", F.lit("")), F.lit(""))).otherwise(F.col("speaker_display"))).withColumn("speaker_status", F.when(known, status).otherwise(F.col("speaker_status")))
    return out.withColumn("speaker_entity_id", F.when(hit, F.col("resolved")).otherwise(F.col("speaker_entity_id"))).select(*annotations.columns)


def top_entities(cards: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The first entities of a volume by importance and latest chunk, both downwards, then id."""
    best = Window.partitionBy("volume_id").orderBy(F.desc(X.importance_level(F.col("importance"))), F.desc(X.chunk_number(F.col("latest_seen_chunk_id"))), "entity_id")
    return cards.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(0, limit))


def pending_mysteries(cards: DataFrame, merged: DataFrame, ttl: int = TTL_CHUNKS) -> DataFrame:
    """`entity_id, volume_id, first_chunk, now_chunk, expired`: mysteries that matter, aren't merged, and whether their time is over.

    Now is the latest chunk seen in the volume; ttl 0 never expires.
    """
    m = cards.where("entity_type = 'mystery'").join(merged.select(F.col("source").alias("entity_id")), "entity_id", "left_anti").where(X.importance_level(F.col("importance")) > 0)
    now = cards.groupBy("volume_id").agg(F.max(X.chunk_number(F.col("latest_seen_chunk_id"))).alias("now_chunk"))
    m = m.join(now, "volume_id").withColumn("first_chunk", X.chunk_number(F.col("first_seen_chunk_id")))
    over = (F.col("first_chunk") > 0) & (F.col("now_chunk") - F.col("first_chunk") >= ttl) if ttl > 0 else F.lit(False)
    return m.select("entity_id", "volume_id", "first_chunk", "now_chunk", over.alias("expired"))
