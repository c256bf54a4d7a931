"""Problem 4: connected components by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.sources.scratch import Scratch

#: A node is heavy if it has more than 1/HEAVY_SHARE of all edge ends, so there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 1000


def _with_minimum(ends: DataFrame, total: int) -> DataFrame:
    """`ends(u, v)` with the least id `m` among u and its neighbours.

    Minima are aggregated map-side. Those of heavy nodes (at most HEAVY_SHARE rows) are
    broadcast, so the edges of a hub are never shuffled to one task; the rest meet by key.
    """
    low = ends.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree")).select("u", F.least("u", "low").alias("m"), (F.col("degree") > max(1000, total // HEAVY_SHARE)).alias("heavy"))
    hubs = F.broadcast(low.where("heavy").select("u", F.col("m").alias("hm")))
    tagged = ends.join(hubs, "u", "left")
    return tagged.where("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(tagged.where("hm is null").drop("hm").join(low.where("not heavy").select("u", "m"), "u"))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_minimum(both, 2 * total).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges are (larger a, smaller b)."""
    met = _with_minimum(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), total)
    moved = met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """`node, component` for every node with an edge to another node; component is its least node.

    Edges with a null end and self-links link nothing; direction and repetition don't
    matter. Each round is written to the shared folder and cuts the lineage; the rounds
    end when every tree is a star. No edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    a, b = F.col(left), F.col(right)
    now = scratch.save(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "round-0")
    total = now.count()
    for i in range(1, max_rounds + 1):
        then = now
        large = scratch.save(large_star(then, total), f"large-{i}")
        now = scratch.save(small_star(large, total), f"round-{i}")
        scratch.drop(f"large-{i}")
        scratch.drop(f"round-{i - 1}")
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        bent = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)")
        if bent.isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
