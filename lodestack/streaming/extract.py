"""Forward-only extraction: one pass over a stream of records, keeping those that are needed until all were seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def needed_records(records: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Records of a stream whose key is needed; the others are skipped. ``needed`` is a static table of distinct keys."""
    return records.join(needed.select(key).distinct(), key, "left_semi")


def extract_stream(records: DataFrame, needed: DataFrame, key: str, sink: str, checkpoint: str, on_batch: Callable[[int, int], bool] | None = None) -> StreamingQuery:
    """Writes the needed records of a stream to Parquet files below ``sink``, a folder for each batch.

    A batch that is run again after a failure replaces its own folder. ``on_batch`` gets the batch number and its number
    of records and stops the query by returning False.
    """
    query: list[StreamingQuery] = []

    def write(batch: DataFrame, number: int) -> None:
        needed_records(batch, needed, key).dropDuplicates([key]).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if on_batch and not on_batch(number, batch.sparkSession.read.parquet(f"{sink}/batch={number}").count()) and query:
            query[0].stop()

    query.append(records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return query[0]


def extracted(spark: SparkSession, sink: str, needed: DataFrame, key: str) -> DataFrame:
    """What a finished extraction wrote, each key once; refuses if the stream ended before all that is needed was seen."""
    found = spark.read.parquet(sink).drop("batch").dropDuplicates([key])
    lacking = needed.select(key).distinct().join(found.select(key), key, "left_anti")
    if not lacking.isEmpty():
        raise EOFError(f"the stream ended before {lacking.count()} needed records")
    return found


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and kind; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
