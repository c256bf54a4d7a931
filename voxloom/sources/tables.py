"""Reading the project's tables: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per key from a table whose rows may be delivered more than once.

    Deliveries of a key that agree in `columns` are merged by a hash aggregate; if they
    disagree, the smallest row wins, so the result does not depend on file order.  Rows
    with a null key are left out.
    """
    kept = df.select(*key, *[c for c in columns if c not in key])
    for k in key:
        kept = kept.where(F.col(k).isNotNull())
    rest = [c for c in columns if c not in key]
    if not rest:
        return kept.distinct()
    return kept.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
