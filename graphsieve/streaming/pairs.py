"""A graph kept up by a stream: pairs of users who did the same kind of thing in the same ten minutes, each told once.

State is keyed by kind and ten minutes and holds the users seen there, until the watermark has passed them; a user new
to a key is paired with those seen before. Which pairs other keys have told already is settled in the sink: each micro-batch is set
against the table so far and written under its own number, so a batch that is run again replaces what it wrote and no pair comes twice.

Rows without user, kind or time are passed over. Users who come later than the watermark allows are paired with nobody.
A key's users are one state: some ten bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECONDS = 600
PAIR = "a long, b long"


def keyed(events: DataFrame, delay: str, seconds: int = SECONDS) -> DataFrame:
    """user_id, event_type, slot (``seconds`` of time) and at, with a watermark of ``delay``."""
    at = F.col("ts").cast("timestamp")
    rows = events.where("user_id is not null and event_type is not null and ts is not null").select("user_id", "event_type", at.alias("at"), F.floor(F.unix_timestamp(at) / seconds).alias("slot"))
    return rows.withWatermark("at", delay)


def slot_pairs(events: DataFrame, delay: str = "1 hour", seconds: int = SECONDS) -> DataFrame:
    """a < b: pairs that a key's new users make; a pair may come again from another key."""

    def pairs(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        for part in parts:
            for user in sorted(set(part["user_id"].tolist()) - seen):
                if seen:  # a frame of one user's pairs at most
                    yield pd.DataFrame({"a": [min(user, x) for x in seen], "b": [max(user, x) for x in seen]})
                seen.add(user)
        state.update((sorted(seen),))
        ends = (int(key[1]) + 1) * seconds * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    return keyed(events, delay, seconds).groupBy("event_type", "slot").applyInPandasWithState(pairs, PAIR, "users array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def keep_pairs(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Starts a query that adds new pairs to the table at ``path``; ``trigger`` as for ``DataStreamWriter.trigger``."""

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.distinct()
        before = known_pairs(batch.sparkSession, path, number)
        if before is not None:
            fresh = fresh.join(before, ["a", "b"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return slot_pairs(events, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add).trigger(**trigger or {"processingTime": "10 seconds"}).start()


def known_pairs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """a, b of the table (of batches before a number); None while there is no table."""
    try:
        rows = spark.read.schema(f"{PAIR}, batch long").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return (rows if before is None else rows.where(F.col("batch") < before)).select("a", "b")
