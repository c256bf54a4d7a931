"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.tables import table

#: Largest written table, in bytes of Parquet, that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The run_limits table (five rows) as a dictionary."""
    return {r.limit_name: r.limit_value for r in table(spark, sf_dir, "run_limits").collect()}


def small_or_shuffled(df: DataFrame, n_bytes: int) -> DataFrame:
    """`df` marked for broadcast if its written size is within BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


#: A key is hot if more than 1/HOT_SHARE of all rows have it, so at most HOT_SHARE keys are.
HOT_SHARE, HOT_LEAST = 1000, 1000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows.join(counted, on) for `counted` with one row per key and its number of rows, `n`; total: all rows.

    Rows of hot keys stay where they are and meet the at most HOT_SHARE hot rows of
    `counted`, which are broadcast; their values take no more room than HOT_SHARE average
    rows, as each stands for so many. The rest meet by key, and no key of the rest is large.
    """
    cut = max(HOT_LEAST, total // HOT_SHARE)
    hot = counted.where(F.col("n") > cut)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.where(F.col("n") <= cut), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
