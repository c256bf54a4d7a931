"""Structured Streaming forms: windows, sessions, and keyed state with expiry.

Every stream reads a folder of Parquet files as they arrive; `run` drives one to the end
of what is there and returns what it wrote, in the shared folder, so it can be restarted.
State goes when the watermark has passed it: rows that come later than LATE after the
newest one may be dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.functions import text as X
from voxloom.sources.scratch import Scratch


#: Deliveries are days or weeks late; this covers them and bounds the state.
LATE = "60 days"
#: How long a session stays open for late events.
SESSION_LATE = "1 hour"


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, times as instants of the session's time zone."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as a table is one file or a folder
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run(spark: SparkSession, flow: DataFrame, key: list[str], mode: str = "update") -> DataFrame:
    """Drive a stream over all present files; the last version of each key is the result."""
    scratch = Scratch(spark)
    out = scratch.path("out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{out}/epoch={epoch}")

    q = flow.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.parquet(out).drop("epoch")
    rest = [c for c in seen.columns if c not in (*key, "_epoch")]
    return seen.groupBy(*key).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*key, "_r.*")


def event_windows(spark: SparkSession, d: str, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Counts and sums of events per tumbling window and type; events later than the watermark are dropped."""
    w = stream(spark, d, "events").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return run(spark, w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), ["start", "event_type"])


def session_windows(spark: SparkSession, d: str, gap: str = "30 minutes", late: str = SESSION_LATE) -> DataFrame:
    """Events of a user grouped by gaps; a session ends when the next event is `gap` away.

    A session is given out when the watermark, `late` before the newest event, has passed
    its end; those still open stay in the state.
    """
    e = stream(spark, d, "events").where("user_id is not null and ts is not null").withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return run(spark, s.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n"), ["user_id", "start"], "append")


STATE = "entities long, dialogues long, latest int"
SUMMARY = "volume_id string, entity_type string, entities long, dialogues long, latest_chunk int"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts of a volume's entities of one type; only three numbers are kept."""
    n, dialogues, latest = state.get if state.exists else (0, 0, 0)
    for rows in batches:
        n, dialogues, latest = n + len(rows), dialogues + int(rows.dialogue_count.sum()), max(latest, int(rows.chunk.max()))
    state.update((n, dialogues, latest))
    yield pd.DataFrame([(*key, n, dialogues, latest)], columns=["volume_id", "entity_type", "entities", "dialogues", "latest_chunk"])


def entity_state(spark: SparkSession, d: str) -> DataFrame:
    """Running totals per volume and entity type; a card delivered again counts once."""
    cards = stream(spark, d, "entity_cards").withWatermark("ingested_at", LATE).dropDuplicatesWithinWatermark(["entity_id"])
    cards = cards.select("volume_id", "entity_type", F.coalesce("dialogue_count", F.lit(0)).alias("dialogue_count"), X.chunk_number(F.col("latest_seen_chunk_id")).alias("chunk"))
    return run(spark, cards.groupBy("volume_id", "entity_type").applyInPandasWithState(_fold, SUMMARY, STATE, "update", GroupStateTimeout.NoTimeout), ["volume_id", "entity_type"])


PENDING_STATE = "first int, name string"
PENDING = "volume_id string, entity_id string, name string, event string, chunk int"


def pending_events(mysteries: DataFrame, ttl_chunks: int = 12) -> DataFrame:
    """Added and expired events of pending mysteries on a stream of `volume_id, entity_id, name, chunk`.

    State is one small row per mystery; it is dropped when the mystery has been pending for
    ttl_chunks chunks, and a later sighting adds it anew.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, name = state.get if state.exists else (None, None)
        out = []
        for rows in batches:
            for chunk, shown in sorted(zip(rows.chunk.tolist(), rows.name.tolist())):
                if first is None:
                    first, name = chunk, shown
                    out.append((*key, name, "added", chunk))
                elif ttl_chunks and chunk - first >= ttl_chunks:
                    out.append((*key, name, "expired", chunk))
                    first = None
        if first is None:
            state.remove()
        else:
            state.update((first, name))
        yield pd.DataFrame(out, columns=["volume_id", "entity_id", "name", "event", "chunk"])

    return mysteries.groupBy("volume_id", "entity_id").applyInPandasWithState(fold, PENDING, PENDING_STATE, "append", GroupStateTimeout.NoTimeout)
