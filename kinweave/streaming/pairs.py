"""Linkage over streams: normalise, look up, score and count as records arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.functions import text as T


def exact_lookup(records: DataFrame, s1: DataFrame, field: str = "business_name") -> DataFrame:
    """Arriving source records joined to the S1s of the same normalised field (stream with table)."""
    left = s1.select(F.col("entity_id").alias("source1_entity_id"), T.normalise(field).alias("_key")).where("_key <> ''")
    right = records.withColumn("_key", T.normalise(field)).where("_key <> ''")
    return right.join(left, "_key").drop("_key")


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows by tumbling or sliding window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window, slide), key).agg(F.count("*").alias("rows"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("rows"))


def write_parts(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, batch_id: str = "batch_id") -> StreamingQuery:
    """All that has arrived, through a function of batches, as Parquet parts; done when nothing is left.

    A batch that is run again after a failure writes the same part anew, so
    every row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/{batch_id}={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
