"""Queries and SQL of labeled text and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import render as O
from voxloom.operators import votes as V
from voxloom.plans import vote_queries as VQ
from voxloom.plans.sql import ONCE
from voxloom.plans.text_queries import SQL as TEXT
from voxloom.sources.tables import once, table


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    return V.aggregate_votes(VQ.dialogues_of(spark, d), VQ.votes_of(spark, d))


def o_labeled(spark: SparkSession, d: str) -> DataFrame:
    at = once(table(spark, d, "dialogues"), ["dialogue_id"], ["paragraph_id", "char_start", "dialogue_kind"])
    a = _annotations(spark, d).join(at, "dialogue_id")
    labels = a.select("paragraph_id", "char_start", O.label(F.col("dialogue_kind"), F.col("needs_review"), F.col("speaker_status"), F.col("speaker_display")).alias("label"))
    p = once(table(spark, d, "paragraphs"), ["paragraph_id"], ["text"])
    return O.labeled_text(p, labels)


def o_review(spark: SparkSession, d: str) -> DataFrame:
    return _annotations(spark, d).where("needs_review").select("dialogue_id", "speaker_display", "review_reason", "confidence")


def o_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.run_summary(_annotations(spark, d))


def o_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return O.length_report(docs.select(F.coalesce("doc_kind", F.lit("none")).alias("task"), X.estimate_tokens(F.col("text")).alias("tokens")), 1000, 8000)


_A = f"a AS ({VQ.SQL['v_aggregate']})"
SQL = {
    "o_labeled": f"""WITH {_A}, l AS (SELECT paragraph_id, char_start, CASE WHEN coalesce(dialogue_kind, 'standalone') = 'inline' THEN '' WHEN needs_review THEN '待复核' WHEN speaker_display <> '' THEN speaker_display ELSE '待复核' END AS label
          FROM a JOIN {ONCE("dialogues", "dialogue_id, paragraph_id, char_start, dialogue_kind")} USING (dialogue_id)),
        p AS (SELECT paragraph_id, text FROM {ONCE("paragraphs", "paragraph_id, text")}),
        c AS (SELECT paragraph_id, least(greatest(char_start, 0), length(coalesce(text, ''))) AS s, label, coalesce(text, '') AS t FROM l JOIN p USING (paragraph_id) WHERE label <> ''),
        g AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY paragraph_id ORDER BY s), 0) AS b, row_number() OVER (PARTITION BY paragraph_id ORDER BY s DESC) AS e FROM c),
        r AS (SELECT paragraph_id, string_agg(substring(t, b + 1, s - b) || '【' || label || '】' || CASE WHEN e = 1 THEN substring(t, s + 1) ELSE '' END, '' ORDER BY s) AS x FROM g GROUP BY paragraph_id)
        SELECT paragraph_id, coalesce(x, text) AS text FROM p LEFT JOIN r USING (paragraph_id)""",
    "o_review": f"WITH {_A} SELECT dialogue_id, speaker_display, review_reason, confidence FROM a WHERE needs_review",
    "o_summary": f"WITH {_A} SELECT count(*) AS annotations, count(*) FILTER (needs_review) AS reviews, count(*) FILTER (rule_applied) AS by_rule, CAST(sum(vote_count) AS BIGINT) AS votes, round(avg(confidence), 4) AS mean_confidence FROM a",
    "o_lengths": f"""WITH t AS ({TEXT["n_tokens"]}) SELECT coalesce(doc_kind, 'none') AS task, count(*) AS prompts, max(tokens) AS most, round(avg(tokens), 2) AS mean, count(*) FILTER (status = 'near_limit') AS near_limit,
        count(*) FILTER (status = 'over_limit') AS over_limit FROM t JOIN documents USING (doc_id) GROUP BY 1""",
}
