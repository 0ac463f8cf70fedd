"""Structured Streaming over tracking and billing events.

Each function takes a streaming (or static) DataFrame and returns one; ``drain`` runs a stream over all that is there and
stops. State is bounded by watermarks, and checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Stream of event files in a folder, with event time as a timestamp."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_windows(events: DataFrame, limit: int = 60, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests of each key per tumbling window, and whether they are over the limit."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), "user_id", "n", (F.col("n") > limit).alias("over"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by kind and UTC day."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return n.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


#: What an event does to a subscription.
ENDS, STARTS = ("error",), ("purchase", "signup")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Events in the order of their delivery; one that starts the very subscription that has ended is stale and ignored."""
    status, sub, ignored = state.get if state.exists else ("none", -1, 0)
    rows = [x for pdf in batches for x in zip(pdf["seq"].tolist(), pdf["sub"].tolist(), pdf["event_type"].tolist(), strict=True)]
    for _, own, kind in sorted(rows):
        if kind in ENDS:
            status, sub = "inactive", own
        elif status == "inactive" and sub == own:
            ignored += 1
        else:
            status, sub = "active", own
    state.update((status, sub, ignored))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "sub": [sub], "ignored": [ignored]})


def subscriptions(events: DataFrame) -> DataFrame:
    """State of each user's subscription after the events so far: status, sub, and how many stale starts were ignored.

    events: user_id, sub (subscription id), seq (order of delivery, ascending from batch to batch), event_type."""
    rows = events.where(F.col("event_type").isin(*ENDS, *STARTS)).select("user_id", "seq", "sub", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(
        _fold, "user_id long, status string, sub long, ignored long", "status string, sub long, ignored long", "update", "NoTimeout"
    )


def drain(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet (append) or, for other modes, batch by batch, and read the result."""
    spark = stream.sparkSession
    out = f"{folder}/{name}"
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    else:

        def save(df: DataFrame, batch: int) -> None:
            df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

        query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data")
