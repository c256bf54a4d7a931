"""Labeled text, the review queue and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as X

REVIEW_LABEL, NOBODY = "待复核", "路人"


def label(kind: Column, review: Column, status: Column, display: Column) -> Column:
    """What stands before a quote: nothing for inline ones, the review mark, the speaker, or a passer-by."""
    shown = X.clean_text(display)
    return F.when(F.coalesce(kind, F.lit("standalone")) == "inline", "").when(F.coalesce(review, F.lit(False)), REVIEW_LABEL).when(shown != "", shown).when(status == "npc", NOBODY).otherwise(REVIEW_LABEL)


def labeled_text(paragraphs: DataFrame, labels: DataFrame) -> DataFrame:
    """`paragraph_id, text` with 【label】 before each quote; rightmost first, so offsets stay valid.

    labels: `paragraph_id, char_start, label`. Offsets beyond the text are clamped.
    """
    marks = labels.where("label <> ''").groupBy("paragraph_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "label")), asc=False).alias("_m"))
    met = paragraphs.join(marks, "paragraph_id", "left")

    def put(text: Column, m: Column) -> Column:
        at = F.least(F.greatest(m["char_start"], F.lit(0)), F.length(text))
        return F.concat(F.substring(text, F.lit(1), at), F.lit("【"), m["label"], F.lit("】"), F.substring(text, at + 1, F.length(text)))

    return met.withColumn("text", F.when(F.col("_m").isNull(), F.col("text")).otherwise(F.aggregate("_m", F.coalesce("text", F.lit("")), put))).drop("_m")


def length_report(prompts: DataFrame, target: int = 24000, hard: int = 30000) -> DataFrame:
    """`task, prompts, most, mean, near_limit, over_limit` over `task, tokens` rows."""
    status = X.budget_status(F.col("tokens"), target, hard)
    return prompts.groupBy("task").agg(F.count("*").alias("prompts"), F.max("tokens").alias("most"), F.round(F.avg("tokens"), 2).alias("mean"), F.count_if(status == "near_limit").alias("near_limit"), F.count_if(status == "over_limit").alias("over_limit"))


def run_summary(annotations: DataFrame) -> DataFrame:
    """One row of counts over a run's annotations."""
    return annotations.agg(F.count("*").alias("annotations"), F.count_if(F.col("needs_review")).alias("reviews"), F.count_if(F.col("rule_applied")).alias("by_rule"), F.coalesce(F.sum("vote_count"), F.lit(0)).alias("votes"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("mean_confidence"))
