"""Queries and SQL of the note store, vector search and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import store as M
from voxloom.plans.entity_queries import CARD
from voxloom.plans.sql import ONCE
from voxloom.sources.tables import once, table
from voxloom.streaming import streams as T

NOW = datetime.datetime(2023, 2, 1)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes: a document's kind is its type, its title its name."""
    kind = F.when(F.col("doc_kind") == "memory", "episodic").when(F.col("doc_kind") == "note", "semantic").otherwise("procedural")
    return table(spark, d, "documents").select(kind.alias("type"), F.concat(F.coalesce("title", F.lit("untitled")), F.lit("#"), F.col("doc_id").cast("string")).alias("name"), F.col("added_at").alias("mtime"), F.col("text").alias("content"))


def m_usage(spark: SparkSession, d: str) -> DataFrame:
    return M.usage(_notes(spark, d))


def m_route(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_kind") == "memory", F.date_format("added_at", "yyyy-MM-dd")).otherwise(F.coalesce("title", F.lit("README"))), F.lit(".md")).alias("name"))
    return M.route(n)


def m_search(spark: SparkSession, d: str) -> DataFrame:
    return M.search(_notes(spark, d), "blue rose|钥匙")


def m_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return M.snapshot(_notes(spark, d), NOW)


def m_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.statistics(_notes(spark, d), NOW).withColumn("type", F.coalesce("type", F.lit("all")))


def x_index(spark: SparkSession, d: str) -> DataFrame:
    return M.index_parts(table(spark, d, "documents").select(F.coalesce("doc_kind", F.lit("none")).alias("category")))


def x_reconcile(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "alias_edges").select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("name")).where("name is not null")
    return M.reconcile(once(table(spark, d, "entity_cards"), ["entity_id"], CARD[:1]).select(F.col("entity_id").alias("name")), index)


def m_health(spark: SparkSession, d: str) -> DataFrame:
    return M.health(_notes(spark, d).withColumn("type", F.when(F.col("name").startswith("README"), "legacy").otherwise(F.col("type"))))


def m_state(spark: SparkSession, d: str) -> DataFrame:
    """Notes as events of the store: a scene is a check, a memory a snapshot, a note an organisation, all else a warning."""
    kind = F.when(F.col("doc_kind") == "scene", "check").when(F.col("doc_kind") == "memory", "snapshot").when(F.col("doc_kind") == "note", "organize").otherwise("warning")
    return M.update_state(M.init_state(spark), table(spark, d, "documents").select(kind.alias("kind"), F.col("added_at").alias("at")))


def x_archive(spark: SparkSession, d: str) -> DataFrame:
    moved = M.archive(_notes(spark, d), NOW - datetime.timedelta(days=30), NOW)
    return moved.select("type", "name", "archived", "reason")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of categories; one whose title holds 1 is the index of its category."""
    n = table(spark, d, "documents").select(F.coalesce("doc_kind", F.lit(".")).alias("category"), F.col("doc_id"), "title", F.col("added_at").alias("mtime"))
    return n.select("category", F.when(F.col("title").contains("1"), "INDEX.md").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("name"), "mtime")


def x_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return M.rebuild_index(_files(spark, d))


def x_sizes(spark: SparkSession, d: str) -> DataFrame:
    return M.index_sizes(M.rebuild_index(_files(spark, d)))


def x_structure(spark: SparkSession, d: str) -> DataFrame:
    return M.structure(_files(spark, d))


def x_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return M.similar(v, v.where("vec_id % 20 = 0"))


def t_windows(spark: SparkSession, d: str) -> DataFrame:
    return T.event_windows(spark, d)


def t_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.session_windows(spark, d)


def t_entities(spark: SparkSession, d: str) -> DataFrame:
    return T.entity_state(spark, d)


_NOTES = """nt AS (SELECT CASE doc_kind WHEN 'memory' THEN 'episodic' WHEN 'note' THEN 'semantic' ELSE 'procedural' END AS type, coalesce(title, 'untitled') || '#' || doc_id AS name, added_at AS mtime, text AS content FROM documents)"""
_FILES = """fs AS (SELECT coalesce(doc_kind, '.') AS category, CASE WHEN contains(title, '1') THEN 'INDEX.md' ELSE doc_id || '.md' END AS name, added_at AS mtime FROM documents)"""
SQL = {
    "m_health": f"""WITH {_NOTES}, u AS (SELECT CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS bytes FROM nt WHERE NOT starts_with(name, 'README'))
        SELECT bytes, bytes * 100 // 800000 AS percent, CASE WHEN bytes * 100 // 800000 >= 85 THEN 'critical' WHEN bytes * 100 // 800000 >= 70 THEN 'warning' ELSE 'safe' END AS status FROM u""",
    "m_state": """SELECT max(added_at) FILTER (doc_kind = 'scene') AS last_check, max(added_at) FILTER (doc_kind = 'memory') AS last_snapshot, max(added_at) FILTER (doc_kind = 'note') AS last_organize, count(*) FILTER (coalesce(doc_kind NOT IN ('scene', 'memory', 'note'), true)) AS warnings FROM documents""",
    "x_archive": f"""WITH {_NOTES}, o AS (SELECT *, coalesce(mtime < TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}' - INTERVAL 30 DAY, false) AS old FROM nt)
        SELECT CASE WHEN old THEN 'archive/' || type ELSE type END AS type, name, CASE WHEN old THEN TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}' END AS archived, CASE WHEN old THEN 'old' END AS reason FROM o""",
    "x_rebuild": f"""WITH {_FILES} SELECT category, name, '| ' || regexp_replace(name, '\\.md$', '') || ' | ? | ' || strftime(mtime, '%Y-%m-%d') || ' | ' || regexp_replace(name, '\\.md$', '') || '.md |' AS line FROM fs WHERE name <> 'INDEX.md'""",
    "x_sizes": f"""WITH {_FILES} SELECT category, count(*) AS lines, count(*) > CASE WHEN category = '.' THEN 20 ELSE 100 END AS too_long FROM fs WHERE name <> 'INDEX.md' GROUP BY category""",
    "x_structure": f"""WITH {_FILES}, c AS (SELECT DISTINCT category FROM fs UNION SELECT '.') SELECT c.category, count(fs.name) AS files, coalesce(bool_or(name = 'INDEX.md'), false) AND (coalesce(bool_or(name = 'config.md'), false) OR c.category <> '.') AS has_index FROM c LEFT JOIN fs USING (category) GROUP BY c.category""",
    "m_usage": f"""WITH {_NOTES}, u AS (SELECT CAST(sum(coalesce(strlen(content), 0)) AS BIGINT) AS b, CAST(sum(CASE WHEN type = 'episodic' THEN coalesce(strlen(content), 0) ELSE 0 END) AS BIGINT) AS e, CAST(sum(CASE WHEN type = 'semantic' THEN coalesce(strlen(content), 0) ELSE 0 END) AS BIGINT) AS s,
          CAST(sum(CASE WHEN type = 'procedural' THEN coalesce(strlen(content), 0) ELSE 0 END) AS BIGINT) AS p FROM nt)
        SELECT b AS bytes, b * 100 // 800000 AS percent, e * 100 // greatest(b, 1) AS episodic, s * 100 // greatest(b, 1) AS semantic, p * 100 // greatest(b, 1) AS procedural,
          CASE WHEN b * 100 // 800000 >= 85 THEN 'critical' WHEN b * 100 // 800000 >= 70 THEN 'warning' ELSE 'safe' END AS status FROM u""",
    "m_route": """WITH n AS (SELECT doc_id, CASE WHEN doc_kind = 'memory' THEN strftime(added_at, '%Y-%m-%d') ELSE coalesce(title, 'README') END || '.md' AS name FROM documents)
        SELECT doc_id, name, CASE WHEN name IN ('MEMORY.md', 'README.md') THEN 'stay' WHEN regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}\\.md$') THEN 'episodic' ELSE 'legacy' END AS target FROM n""",
    "m_search": f"""WITH {_NOTES}, l AS (SELECT type, name, string_split(content, chr(10)) AS ls FROM nt WHERE content IS NOT NULL), r AS (SELECT type, name, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM l),
        h AS (SELECT *, regexp_matches(line, '(?i)blue rose|钥匙') AS hit FROM r), k AS (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY type, name ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h)
        SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY name, line_no) AS INTEGER) AS n, name, CAST(line_no AS INTEGER) AS line_no, line, hit FROM k WHERE near = 1 QUALIFY n <= 20""",
    "m_snapshot": f"""WITH {_NOTES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY name DESC) AS INTEGER) AS rank, string_split(coalesce(content, ''), chr(10)) AS ls FROM nt WHERE type <> 'episodic' OR mtime >= TIMESTAMP '2023-01-29')
        SELECT type, rank, name, array_to_string(CASE WHEN type = 'episodic' THEN ls[greatest(1, len(ls) - 29):] ELSE ls[1:20] END, chr(10)) AS part FROM r WHERE rank <= CASE WHEN type = 'semantic' THEN 5 ELSE 3 END""",
    "m_stats": f"""WITH {_NOTES} SELECT coalesce(type, 'all') AS type, count(*) AS files, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS bytes, count(*) FILTER (mtime >= TIMESTAMP '2023-01-25') AS recent, count(*) FILTER (mtime >= TIMESTAMP '2023-01-25') // 7 AS per_day FROM nt GROUP BY ROLLUP (type)""",
    "x_index": """WITH n AS (SELECT coalesce(doc_kind, 'none') AS category, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT *, unnest(range(CAST(ceil(n / 100.0) AS BIGINT))) AS part FROM n)
        SELECT category, CAST(part AS INTEGER) AS part, least(100, n - part * 100) AS entries FROM p""",
    "x_reconcile": f"""WITH f AS (SELECT DISTINCT entity_id AS name FROM entity_cards), i AS (SELECT DISTINCT name FROM (SELECT source_entity_id AS name FROM alias_edges UNION SELECT target_entity_id FROM alias_edges) WHERE name IS NOT NULL)
        SELECT name, 'not indexed' AS problem FROM f WHERE name NOT IN (SELECT name FROM i) UNION ALL SELECT name, 'no file' FROM i WHERE name NOT IN (SELECT name FROM f)""",
    "x_vectors": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s WHERE score >= 0.3 QUALIFY rank <= 20""",
    "t_windows": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""",
    "t_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s
        HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE user_id IS NOT NULL) - INTERVAL 1 HOUR""",
    "t_entities": f"""SELECT volume_id, entity_type, count(*) AS entities, CAST(sum(coalesce(dialogue_count, 0)) AS BIGINT) AS dialogues, max(coalesce(try_cast(nullif(regexp_extract(latest_seen_chunk_id, '-r([0-9]+)$', 1), '') AS INTEGER), 0)) AS latest_chunk
        FROM {ONCE("entity_cards", "entity_id, " + ", ".join(CARD))} GROUP BY ALL""",
}
