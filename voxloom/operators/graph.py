"""Small graph helpers over edge tables: groups of related records and resolution of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.sources.scratch import Scratch


def groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`node, group` for undirected edges `a, b`: labels spread to neighbours and jump to their own label's label until they stay."""
    scratch = Scratch(edges.sparkSession)
    e = edges.where("a is not null and b is not null and a <> b")
    both = scratch.save(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("group")), "label-0")
    for i in range(1, max_rounds + 1):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        step = label.join(near, "node").select("node", "group", F.least("group", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("group").alias("far"))
        now = scratch.save(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("now"), "group"), f"step-{i}")
        moved = not now.where("now <> group").isEmpty()
        if i > 1:
            scratch.drop(f"step-{i - 1}")
        label = now.select("node", F.col("now").alias("group"))
        if not moved:
            return label
    raise RuntimeError(f"groups didn't settle in {max_rounds} rounds")


def resolve_aliases(edges: DataFrame) -> DataFrame:
    """`node, resolved` following each source's one edge to the end: `source, target`, one row per source.

    A chain that runs into a cycle resolves to the smallest id of the cycle. Pointers
    double every round, so a chain of n edges takes log2(n) rounds.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.where("source is not null and target is not null and source <> target").groupBy("source").agg(F.min("target").alias("target"))
    ends = e.select(F.col("target").alias("node")).distinct().join(e.select(F.col("source").alias("node")), "node", "left_anti")
    now = scratch.save(e.select(F.col("source").alias("node"), F.col("target").alias("ptr"), F.col("target").alias("low")).unionByName(ends.select("node", F.col("node").alias("ptr"), F.col("node").alias("low"))), "p-0")
    n, reach, i = now.count(), 1, 0
    while reach < n:
        i += 1
        reach *= 2
        far = now.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        now = scratch.save(now.join(far, "ptr").select("node", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")), f"p-{i}")
        scratch.drop(f"p-{i - 1}")
    # a pointer at an end stays there, one in a cycle has seen all of the cycle
    stop = ends.select(F.col("node").alias("ptr"), F.lit(True).alias("is_end"))
    lows = now.select(F.col("node").alias("ptr"), F.col("low").alias("cycle_low"))
    return now.select("node", "ptr").join(stop, "ptr", "left").join(lows, "ptr").select("node", F.when(F.col("is_end"), F.col("ptr")).otherwise(F.col("cycle_low")).alias("resolved"))
