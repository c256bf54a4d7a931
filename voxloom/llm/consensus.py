"""Problem 5: consensus of several annotators, and how far each can be relied on.

Two annotators that both know the answer agree; if one guesses, they agree by chance c.
So the agreement x of a pair, centred by chance, (agree - c) / (1 - c), is the product of
their reliabilities. The centred matrix says little where a pair met seldom and nothing
on its diagonal. Corrected for that, its entries are w * x + (1 - w) * r_a * r_b, with w
the overlap count over the largest one and 0 on the diagonal, and the reliabilities r are
its leading eigenvector, its length the root of the eigenvalue: the one fixed point of
r_a = sum(n * x * r_b) / sum(n * r_b^2). Power iteration finds it by joins over the sparse
table of pairs. The plain step would swing between s * r and r / s for ever, so a step
goes two thirds of the way in the logarithm, and the iteration ends when no reliability
moves by SETTLED or more. Chance is the value of the
grid with the least weighted absolute residual; all of them are iterated side by side,
until the best one and its neighbours have settled.

A pair whose agreement is far above the product depends on each other: the fit is repeated
without it, and in a dialogue where both give the same label, the weaker one's vote counts
only for the part that isn't copied.

A vote weighs the log odds of being right. A stated confidence moves that weight as far as
the agreement of such votes bears it out: the row of the matrix is taken apart by
confidence level, and each level is projected on the eigenvector like the whole row.

Abstentions (null labels) are not votes; null keys are left out; a model's repeated rows
for a dialogue count once; an empty table gives no rows. Ties go to the label with more
votes, then to the smaller id. An annotator without a pair that met often enough has
reliability 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.sources.scratch import Scratch
from voxloom.sources.tables import once

MIN_OVERLAP = 10
CHANCE_GRID = [i / 50 for i in range(1, 26)]
#: A pair depends on each other if its centred agreement exceeds the product by this much and by so many standard errors.
DEPENDENT_BY, DEPENDENT_SIGMA = 0.15, 5.0
LEAST, MOST = 0.01, 0.995
#: Steps between two looks at the change, and the change that ends the iteration; some 10 to 20 steps are taken.
STEPS, SETTLED, MAX_STEPS = 5, 5e-4, 300
#: Votes' worth of prior in the reliability of a confidence level.
PRIOR = 8.0


def confidence_level(confidence: Column) -> Column:
    """Tenths of the confidence; percentages are scaled, null and out of range is level -1."""
    c = F.when((confidence > 1) & (confidence <= 100), confidence / 100).otherwise(confidence)
    return F.when((c >= 0) & (c <= 1), F.least(F.floor(c * 10), F.lit(9))).otherwise(-1).cast("int")


def _step(entries: DataFrame, v: DataFrame) -> DataFrame:
    """`c, model, r, was` after one step of the power iteration from `c, model, r`."""
    met = entries.join(v.select("c", F.col("model").alias("b"), "r"), ["c", "b"])
    new = met.groupBy("c", F.col("a").alias("model")).agg(
        (F.sum(F.expr("n * x * r")) / F.sum(F.expr("n * r * r"))).alias("to"), F.max(F.when(F.col("a") == F.col("b"), F.col("r"))).alias("was")
    )
    inside = lambda r: F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(LEAST)), F.lit(MOST))
    return new.select("c", "model", inside(F.pow("was", 1 / 3) * F.pow(inside(F.col("to")), 2 / 3)).alias("r"), "was")


def fit(pairs: DataFrame, scratch: Scratch, name: str, start: float | DataFrame = 0.6) -> tuple[float, DataFrame]:
    """Chance level and `c, model, r` for every value of chance, those of the level best; pairs: `a, b, n, agree`, both directions."""
    grid = F.explode(F.array(*[F.lit(c) for c in CHANCE_GRID]))
    entries = pairs.withColumn("c", grid).select("c", "a", "b", "n", ((F.col("agree") - F.col("c")) / (1 - F.col("c"))).alias("x"))
    itself = pairs.select("a").distinct().withColumn("c", grid).select("c", "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("x"))
    entries = scratch.save(entries.unionByName(itself), f"{name}-entries")
    v = entries.where("a = b").select("c", F.col("a").alias("model"))
    v = v.withColumn("r", F.lit(start)) if isinstance(start, float) else v.join(start, ["c", "model"], "left").withColumn("r", F.coalesce("r", F.lit(0.6)))
    best = CHANCE_GRID[0]
    for i in range(0, MAX_STEPS, STEPS):
        for _ in range(STEPS):
            v = _step(entries, v.select("c", "model", "r"))
        v = scratch.save(v, f"{name}-v{i}")
        one = lambda side: v.select("c", F.col("model").alias(side), F.col("r").alias(f"r{side}"), F.abs(F.col("r") - F.col("was")).alias(f"moved{side}"))  # noqa: B023, E731
        met = entries.join(one("a"), ["c", "a"]).join(one("b"), ["c", "b"])
        seen = met.groupBy("c").agg(F.sum(F.expr("n * abs(x - ra * rb) * (1 - c)")).alias("loss"), F.max("moveda").alias("moved")).collect()  # a row per value of the grid
        if not seen:
            break
        best = min(seen, key=lambda r: (r.loss, r.c)).c
        if i:
            scratch.drop(f"{name}-v{i - STEPS}")
        if max(r.moved for r in seen if abs(r.c - best) < 0.03) < SETTLED:
            break
    scratch.drop(f"{name}-entries")
    return best, v.select("c", "model", "r")


def met_pairs(votes: DataFrame) -> DataFrame:
    """`a, level, b, n, same`: how often an annotator met another at a level of its own confidence, and agreed."""
    pair = F.expr("""explode(flatten(transform(cast, x -> transform(filter(cast, y -> y.model <> x.model),
        y -> struct(x.model as a, x.level as level, y.model as b, x.label = y.label as same)))))""")
    met = votes.select(pair.alias("p"))
    return met.groupBy("p.a", "p.level", "p.b").agg(F.count("*").alias("n"), F.count_if("p.same").alias("same"))


def reliability(votes: DataFrame, scratch: Scratch) -> tuple[float, DataFrame, DataFrame, DataFrame]:
    """Chance level, `model, r, votes`, `model, level, r`, and `copier, source, rate` of dependent pairs.

    votes: `item, cast ARRAY<STRUCT<model, label, level>>`, one element per annotator.
    """
    met = scratch.save(met_pairs(votes), "met")
    pairs = met.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum("same") / F.sum("n")).alias("agree")).where(F.col("n") >= MIN_OVERLAP)
    pairs = scratch.save(pairs, "pairs")
    chance, of = fit(pairs, scratch, "first")
    v = of.where(F.col("c") == chance).drop("c")

    def rest(v: DataFrame, chance: float) -> DataFrame:
        with_a = pairs.join(v.select(F.col("model").alias("a"), F.col("r").alias("ra")), "a")
        with_both = with_a.join(v.select(F.col("model").alias("b"), F.col("r").alias("rb")), "b")
        over = (F.col("agree") - chance) / (1 - chance) - F.col("ra") * F.col("rb")
        return with_both.withColumn("over", over).withColumn("dependent", (over > DEPENDENT_BY) & (over * F.sqrt("n") > DEPENDENT_SIGMA))

    first = scratch.save(rest(v, chance), "first-rest")
    if not first.where("dependent").isEmpty():
        chance, of = fit(first.where("not dependent").select("a", "b", "n", "agree"), scratch, "second", of)
        v = of.where(F.col("c") == chance).drop("c")
    counts = votes.select(F.explode("cast").alias("x")).groupBy(F.col("x.model").alias("model")).agg(F.count("*").alias("votes"))
    v = scratch.save(counts.join(v, "model", "left").select("model", "votes", F.coalesce("r", F.lit(0.5)).alias("r")), "reliability")
    weaker = (F.col("ra") < F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("a") > F.col("b")))
    over = scratch.save(rest(v, chance), "second-rest")
    rate = F.least(F.col("over") / (1 - F.col("ra") * F.col("rb")), F.lit(1.0))
    copied = over.where("dependent").where(weaker).select(F.col("a").alias("copier"), F.col("b").alias("source"), rate.alias("rate"))
    # the row of an annotator, taken apart by level and projected on the eigenvector
    others = over.where("not dependent").select("a", "b", "ra", "rb")
    x = (F.col("same") - chance * F.col("n")) / (1 - chance)
    levels = met.join(others, ["a", "b"]).groupBy(F.col("a").alias("model"), "level").agg(
        ((F.sum(x * F.col("rb")) + PRIOR * F.first("ra")) / (F.sum(F.col("n") * F.col("rb") * F.col("rb")) + PRIOR)).alias("r")
    )
    levels, copied = scratch.save(levels, "levels"), scratch.save(copied, "copied")
    for name in ("met", "pairs", "first-rest", "second-rest"):
        scratch.drop(name)
    return chance, v, levels, copied


def _scores(votes: DataFrame, weights: DataFrame, copied: DataFrame) -> DataFrame:
    """`item, model, label, level, w`: what each vote weighs in its dialogue.

    weights has one row per annotator and level, copied one per dependent pair: both are
    bounded by the number of annotators, not by the votes.
    """
    one = votes.select("item", "cast", F.explode("cast").alias("x")).select("item", "cast", "x.model", "x.label", "x.level")
    one = one.join(F.broadcast(weights), ["model", "level"], "left")
    sources = copied.groupBy(F.col("copier").alias("model")).agg(F.collect_list(F.struct("source", "rate")).alias("sources"))
    one = one.join(F.broadcast(sources), "model", "left")
    own = F.expr("aggregate(filter(sources, s -> exists(cast, y -> y.model = s.source and y.label = label)), 1D, (z, s) -> z * (1 - s.rate))")
    return one.select("item", "model", "label", "level", (F.coalesce("w", F.lit(0.0)) * F.coalesce(own, F.lit(1.0))).alias("w"))


def _log_odds(p: Column, others: float) -> Column:
    return F.log(p / (1 - p) * others)


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The consensus per item and the reliability per annotator.

    votes: `item, model, label, confidence`. Items: `item, label, n_models, agreement,
    posterior`; agreement is the share of agreeing pairs of annotators (null for one
    annotator). Annotators: `model, votes, reliability, accuracy, chance, copies_of`.
    """
    scratch = Scratch(votes.sparkSession)
    given = votes.where("label is not null").withColumn("level", confidence_level(F.col("confidence")))
    given = once(given, ["item", "model"], ["label", "level"])
    members = F.array_sort(F.collect_list(F.struct("model", "label", "level")))
    cast = scratch.save(given.groupBy("item").agg(members.alias("cast")), "cast")
    chance, r, by_level, copied = reliability(cast, scratch)
    others = max(1.0, 1 / chance - 1)
    right = lambda r: F.least(F.greatest(r + (1 - r) * chance, F.lit(LEAST)), F.lit(0.99))
    r = r.withColumn("accuracy", right(F.col("r")))
    every = r.select("model", F.col("r").alias("whole"), F.explode(F.sequence(F.lit(-1), F.lit(9))).alias("level"))
    weights = every.join(by_level, ["model", "level"], "left").select("model", "level", F.greatest(_log_odds(right(F.coalesce("r", "whole")), others), F.lit(0.0)).alias("w"))
    scored = _scores(cast, weights, copied)
    labels = scored.groupBy("item", "label").agg(F.sum("w").alias("s"), F.count("*").alias("k"))
    best = labels.groupBy("item").agg(
        F.max(F.struct(F.round("s", 9).alias("s"), "k")).alias("top"),
        F.sum("k").alias("n_models"),
        F.sum(F.expr("k * (k - 1)")).alias("same"),
        F.sum(F.exp(F.least("s", F.lit(300.0)))).alias("mass"),
        F.collect_list(F.struct(F.round("s", 9).alias("s"), "k", "label")).alias("all"),
    )
    n = F.col("n_models")
    items = best.select(
        "item",
        F.array_min(F.expr("transform(filter(all, x -> x.s = top.s and x.k = top.k), x -> x.label)")).alias("label"),
        n.cast("int").alias("n_models"),
        F.when(n > 1, F.col("same") / (n * (n - 1))).alias("agreement"),
        (F.exp(F.least(F.col("top.s"), F.lit(300.0))) / F.col("mass")).alias("posterior"),
    )
    sources = copied.groupBy(F.col("copier").alias("model")).agg(F.array_sort(F.collect_list("source")).alias("copies_of"))
    annotators = r.join(sources, "model", "left").select("model", "votes", F.col("r").alias("reliability"), "accuracy", F.lit(chance).alias("chance"), "copies_of")
    return items, annotators
