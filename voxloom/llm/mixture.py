"""Problem 8: one collection in which every source holds its target share of all tokens.

The collection is as large as the scarcest source allows: T = min(max_repeats * tokens /
share). A text of a source is then wanted share * T / tokens times, in general not a whole
number; all its texts get the whole part, and pivotal sampling rounds the fractions: two
texts exchange token mass at random until one fraction is 0 or 1, so the tokens of a
source stay what they are and each text keeps its expected copies. Every bucket of texts
leaves at most one fraction; these meet in a reduction tree, and the last one per source
is drawn.

Sources without a target, null sources, and null or empty texts aren't used; a target
whose source has no text can't be reached, and the rest keep their proportions. Random
draws come from a hash of the seed and the doc_ids, so a task run again draws the same.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.sources.scratch import Scratch

BUCKET_TEXTS, FAN_IN = 20_000, 64
DECIDED = "source string, bucket long, doc_id long, tokens long, whole int, p double"
#: Fractions this near to 0 or 1 are whole.
NEAR = 1e-12


def _draw(seed: int, *ids: int) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *ids)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivotal(rows: list[tuple[int, int, float]], seed: int) -> list[tuple[int, int, float]]:
    """Round `doc_id, tokens, p` until at most one p is a fraction; the sum of tokens * p stays."""
    out: list[tuple[int, int, float]] = []
    held: tuple[int, int, float] | None = None
    for row in rows:
        if row[2] <= NEAR or row[2] >= 1 - NEAR:
            out.append((row[0], row[1], float(round(row[2]))))
            continue
        if held is None:
            held = row
            continue
        (i, wi, pi), (j, wj, pj) = held, row
        up, down = min((1 - pi) * wi, pj * wj), min(pi * wi, (1 - pj) * wj)
        move = up if _draw(seed, i, j) * (up + down) < down else -down
        pi, pj = pi + move / wi, pj - move / wj
        held = None
        for x in ((i, wi, pi), (j, wj, pj)):
            if x[2] <= NEAR or x[2] >= 1 - NEAR:
                out.append((x[0], x[1], float(round(x[2]))))
            else:
                held = x
    return out + ([held] if held else [])


def copy_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """`source, target_share, max_repeats, available, copies`: a row per source on either side."""
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    want = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = have.join(want, "source", "full").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = both.where("available > 0 and target_share > 0 and max_repeats > 0 and source is not null")
    size = usable.agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("T")).first().T  # one number
    reach = usable.select("source", (F.col("target_share") * F.lit(size or 0.0) / F.col("available")).alias("copies"))
    return both.join(reach, "source", "left")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The collection `doc_id, source, tokens, copies` and the report of shares, for `doc_id, source, tokens`."""
    scratch = Scratch(sized.sparkSession)
    sized = scratch.save(sized.where("tokens > 0").select("doc_id", "source", "tokens"), "sized")
    plan = scratch.save(copy_plan(sized, targets), "plan")
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_TEXTS))
    wanted = F.broadcast(plan.where("copies is not null").select("source", "copies"))  # a row per targeted source
    open_rows = sized.join(wanted, "source").select(
        "source", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "tokens",
        F.floor(F.col("copies") + NEAR).cast("int").alias("whole"), F.greatest(F.col("copies") - F.floor(F.col("copies") + NEAR), F.lit(0.0)).alias("p"),
    )

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", key=lambda s: s.map(lambda x: _draw(seed, x)))
        whole = dict(zip(rows.doc_id.tolist(), rows.whole.tolist()))
        done = pivotal(list(zip(rows.doc_id.tolist(), rows.tokens.tolist(), rows.p.tolist())), seed)
        return pd.DataFrame([(key[0], key[1], d, t, whole[d], p) for d, t, p in done], columns=[x.split()[0] for x in DECIDED.split(", ")])

    parts, level = [], 0
    fraction = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        done = scratch.save(open_rows.groupBy("source", "bucket").applyInPandas(run, DECIDED), f"level-{level}")
        parts.append(done.where(~fraction))
        if buckets == 1:
            draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
            parts.append(done.where(fraction).withColumn("p", (draw < F.col("p")).cast("double")))
            break
        buckets = -(-buckets // FAN_IN)
        open_rows = done.where(fraction).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level += 1
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    mixed = rows.select("doc_id", "source", "tokens", (F.col("whole") + F.col("p")).cast("int").alias("copies")).where("copies > 0")
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    every = Window.partitionBy(F.lit(0))  # of a row per source
    report = plan.join(used, "source", "left").withColumn("total", F.sum("mixed_tokens").over(every)).select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return mixed, report
