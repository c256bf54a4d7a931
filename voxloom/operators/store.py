"""The typed note store: usage, routing, search, snapshots, statistics, index checks and vector search.

A note is `type, name, mtime, content`; types are episodic, semantic and procedural.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("episodic", "semantic", "procedural")
BUDGET_CHARS, WARNING, CRITICAL = 800_000, 70, 85
#: Queries of a vector search that are compared at a time; a block is sent to every task.
QUERY_BLOCK = 4096


def usage(notes: DataFrame, budget: int = BUDGET_CHARS) -> DataFrame:
    """One row: bytes, whole percent of the budget, share of each type, and status."""
    n = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    share = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, n)), F.lit(0))
    total = notes.agg(F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), *[share(t).alias(t) for t in TYPES])
    percent = F.floor(F.col("bytes") * 100 / budget).cast("long")
    status = F.when(percent >= CRITICAL, "critical").when(percent >= WARNING, "warning").otherwise("safe")
    whole = F.greatest(F.col("bytes"), F.lit(1))
    return total.select("bytes", percent.alias("percent"), *[F.floor(F.col(t) * 100 / whole).cast("long").alias(t) for t in TYPES], status.alias("status"))


def route(files: DataFrame) -> DataFrame:
    """Where a flat file goes: dated ones to episodic, others copied to legacy, the index files stay."""
    return files.withColumn("target", F.when(F.col("name").isin("MEMORY.md", "README.md"), "stay").when(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}\.md$"), "episodic").otherwise("legacy"))


def categorize(store: DataFrame, new: DataFrame) -> DataFrame:
    """Notes after an upsert: a known (type, name) gets the content appended under a header, others are added."""
    add = new.select("type", "name", F.col("mtime").alias("_t"), F.col("content").alias("_c"))
    met = store.join(add, ["type", "name"], "full")
    text = F.when(F.col("_c").isNull(), F.col("content")).when(F.col("content").isNull(), F.col("_c")).otherwise(F.concat("content", F.lit("\n\n---\n\n# Merged\n\n"), "_c"))
    return met.select("type", "name", F.greatest("mtime", "_t").alias("mtime"), text.alias("content"))


def search(notes: DataFrame, pattern: str, around: int = 2, most: int = 20) -> DataFrame:
    """`type, n, name, line_no, line, hit`: lines that match the pattern in any case, with their neighbours.

    The first `most` lines of a type, in order of name and line; `most` is the report's length.
    """
    cut = notes.select("type", "name", F.split("content", "\n").alias("_l"))
    at = F.filter(F.transform("_l", lambda x, i: F.when(F.rlike(x, F.lit(f"(?i){pattern}")), i).otherwise(-1)), lambda i: i >= 0)
    near = F.array_sort(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - around, F.lit(0)), F.least(i + around, F.size("_l") - 1))))))
    rows = cut.withColumn("_at", at).where(F.size("_at") > 0).select("type", "name", "_at", "_l", F.explode(near).alias("i"))
    rows = rows.select("type", "name", (F.col("i") + 1).alias("line_no"), F.get("_l", F.col("i")).alias("line"), F.array_contains("_at", F.col("i")).alias("hit"))
    first = Window.partitionBy("type").orderBy("name", "line_no")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("type", "n", "name", "line_no", "line", "hit")


def snapshot(notes: DataFrame, now, days: int = 3) -> DataFrame:
    """`type, rank, name, part`: the newest notes of each type, cut to a few lines.

    Episodic: three of the last days, their last 30 lines; semantic: five, procedural:
    three, their first 20 lines; by name, newest name first.
    """
    recent = notes.where((F.col("type") != "episodic") | (F.col("mtime") >= F.lit(now) - F.expr(f"interval {days} days")))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("name")))
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    tail = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 29), F.lit(30))
    part = F.array_join(F.when(F.col("type") == "episodic", tail).otherwise(F.slice(lines, 1, 20)), "\n")
    kept = recent.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("type") == "semantic", 5).otherwise(3))
    return kept.select("type", "rank", "name", part.alias("part"))


def statistics(notes: DataFrame, now) -> DataFrame:
    """Notes, bytes and notes of the last seven days per type, and in total (type null)."""
    week = F.col("mtime") >= F.lit(now) - F.expr("interval 7 days")
    return notes.rollup("type").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"), F.count_if(week).alias("recent"), F.floor(F.count_if(week) / 7).cast("long").alias("per_day"))


def index_parts(entries: DataFrame, size: int = 100) -> DataFrame:
    """`category, part, entries`: an index over `size` entries is split."""
    n = entries.groupBy("category").agg(F.count("*").alias("n"))
    parts = n.select("category", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / size) - 1)).alias("part"))
    return parts.select("category", F.col("part").cast("int").alias("part"), F.least(F.lit(size), F.col("n") - F.col("part") * size).cast("long").alias("entries"))


def reconcile(files: DataFrame, index: DataFrame) -> DataFrame:
    """`name, problem`: files not in the index, and index entries without a file."""
    a, b = files.select("name").distinct(), index.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("problem", F.lit("not indexed")).unionByName(b.join(a, "name", "left_anti").withColumn("problem", F.lit("no file")))


def similar(vectors: DataFrame, queries: DataFrame, floor: float = 0.3, most: int = 20) -> DataFrame:
    """`query_id, rank, vec_id, score`: cosine similarity of a stated query set against all rows, best first.

    Queries are compared in blocks; within a task the best of each batch are kept, so a
    query never brings more than `most` rows per batch into the shuffle.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    marked = queries.select(F.col("vec_id").alias("q"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"))
    found = None
    for b in range(blocks):
        rows = marked.where(F.col("b") == b).collect()  # at most about QUERY_BLOCK vectors
        if not rows:
            continue
        ids, q = np.array([r.q for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def near(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for v in batches:
                m = np.stack(v.embedding.to_numpy()).astype(np.float64)
                s = q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
                vec = v.vec_id.to_numpy()
                order = np.lexsort((np.broadcast_to(vec, s.shape), -np.round(s, 9)))[:, : most + 1]
                rows = [(ids[i], vec[j], s[i, j]) for i in range(len(ids)) for j in order[i] if s[i, j] >= floor and vec[j] != ids[i]]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        part = vectors.where("embedding is not null").select("vec_id", "embedding").mapInPandas(near, "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


STATE = ("last_check", "last_snapshot", "last_organize")
FOLDERS = (*TYPES, "snapshots", "legacy")
ROOT_LINES, CATEGORY_LINES = 20, 100


def init_state(spark: SparkSession, state: DataFrame | None = None) -> DataFrame:
    """The one-row state of a store, `last_check, last_snapshot, last_organize, warnings`; an existing one stays as it is."""
    fresh = spark.createDataFrame([(None, None, None, 0)], "last_check timestamp_ntz, last_snapshot timestamp_ntz, last_organize timestamp_ntz, warnings long")
    if state is None:
        return fresh
    return state.unionByName(fresh.join(state.limit(1).select(F.lit(1).alias("_")), F.lit(True), "left").where("_ is null").drop("_"))


def init_notes(spark: SparkSession, notes: DataFrame, now) -> DataFrame:
    """Notes with a README for each type that has none; it counts as a note from then on."""
    heads = spark.createDataFrame([(t, "README.md", now, f"# {t}") for t in TYPES], "type string, name string, mtime timestamp_ntz, content string")
    return notes.select("type", "name", "mtime", "content").unionByName(heads.join(notes.select("type", "name"), ["type", "name"], "left_anti").select("type", "name", "mtime", "content"))


def update_state(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state after `kind, at` events: the latest check, snapshot and organisation, and one warning more for each `warning`."""
    latest = [F.max(F.when(F.col("kind") == c.removeprefix("last_"), F.col("at"))).alias(f"_{c}") for c in STATE]
    seen = events.agg(*latest, F.count_if(F.col("kind") == "warning").alias("_w"))
    met = state.join(seen, F.lit(True), "left")  # one row each
    return met.select(*[F.greatest(c, f"_{c}").alias(c) for c in STATE], (F.col("warnings") + F.coalesce("_w", F.lit(0))).alias("warnings"))


def health(notes: DataFrame, budget: int = BUDGET_CHARS) -> DataFrame:
    """One row: `bytes, percent, status` of the three types alone; flat and legacy files don't count here."""
    kept = notes.where(F.col("type").isin(*TYPES))
    return usage(kept, budget).select("bytes", "percent", "status")


def archive(notes: DataFrame, before, now, reason: str = "old") -> DataFrame:
    """Notes with those last changed before a date moved: `type, name, mtime, content, archived, reason`; the type becomes `archive/type`."""
    old = (F.col("mtime") < F.lit(before)) & ~F.col("type").startswith("archive/")
    moved = notes.withColumn("_old", F.coalesce(old, F.lit(False)))
    return moved.select(
        F.when(F.col("_old"), F.concat(F.lit("archive/"), "type")).otherwise(F.col("type")).alias("type"), "name", "mtime", "content",
        F.when(F.col("_old"), F.lit(now)).alias("archived"), F.when(F.col("_old"), F.lit(reason)).alias("reason"),
    )


def sort_inbox(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """Notes of type `inbox` with a target (`name, target`) move there; the rest of the inbox stays."""
    met = notes.join(targets.groupBy("name").agg(F.min("target").alias("_t")), "name", "left")
    return met.withColumn("type", F.when((F.col("type") == "inbox") & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("type"))).drop("_t").select(*notes.columns)


def references(notes: DataFrame) -> DataFrame:
    """`type, name, target, anchor, found`: cross-references (see folder/file.md#anchor) of every note, and whether the file is there."""
    link = F.explode(F.regexp_extract_all("content", F.lit(r"see ([\w/.-]+\.md(?:#[\w-]+)?)"), F.lit(1)))
    links = notes.select("type", "name", link.alias("_l")).select("type", "name", F.substring_index("_l", "#", 1).alias("target"), F.when(F.contains("_l", F.lit("#")), F.substring_index("_l", "#", -1)).alias("anchor"))
    files = notes.select(F.concat_ws("/", "type", "name").alias("target")).distinct().withColumn("found", F.lit(True))
    return links.join(files, "target", "left").select("type", "name", "target", "anchor", F.coalesce("found", F.lit(False)).alias("found"))


def rebuild_index(files: DataFrame) -> DataFrame:
    """`category, name, line`: an index line for every file, by name; the index files have none."""
    kept = files.where(F.col("name") != "INDEX.md")
    bare = F.regexp_replace("name", r"\.md$", "")
    return kept.select("category", "name", F.concat(F.lit("| "), bare, F.lit(" | ? | "), F.date_format("mtime", "yyyy-MM-dd"), F.lit(" | "), bare, F.lit(".md |")).alias("line"))


def index_sizes(lines: DataFrame) -> DataFrame:
    """`category, lines, too_long` of `category`, a row per index line; the root (`.`) may have ROOT_LINES, a category CATEGORY_LINES."""
    n = lines.groupBy("category").agg(F.count("*").alias("lines"))
    return n.withColumn("too_long", F.col("lines") > F.when(F.col("category") == ".", ROOT_LINES).otherwise(CATEGORY_LINES))


def structure(files: DataFrame) -> DataFrame:
    """`category, files, has_index` of `category, name`; the root (`.`) is there even without files, and needs a config.md too."""
    root = files.sparkSession.createDataFrame([(".",)], "category string")
    n = files.groupBy("category").agg(F.count("*").alias("files"), F.bool_or(F.col("name") == "INDEX.md").alias("i"), F.bool_or(F.col("name") == "config.md").alias("c"))
    met = files.select("category").unionByName(root).distinct().join(n, "category", "left")
    whole = F.coalesce("i", F.lit(False)) & (F.coalesce("c", F.lit(False)) | (F.col("category") != "."))
    return met.select("category", F.coalesce("files", F.lit(0)).alias("files"), whole.alias("has_index"))
