"""Running totals that don't sort a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that are summed by one task.
BLOCK = 8192


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds `name`: the sum of `value` over the key up to and including the row, by `order` (an integer, unique in the key).

    Totals are taken over blocks of the order column first; a window over the few blocks
    and one inside each block give the rest, so the largest key is spread over its blocks.
    A null order counts as before all others.
    """
    at = df.withColumn("_o", F.coalesce(F.col(order), F.lit(-1)).cast("long")).withColumn("_b", F.floor(F.col("_o") / block))
    sums = at.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    ahead = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    on = (F.col("_b") == F.col("_b2")) & F.expr("true")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
    out = at.withColumn("_run", inside).join(sums, on).withColumn(name, F.col("_run") + F.col("_ahead"))
    return out.drop("_o", "_b", "_run", "_ahead", "_b2", *[f"_k{i}" for i in range(len(keys))])
