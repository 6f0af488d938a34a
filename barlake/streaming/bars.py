"""Structured Streaming: ticks → bars (Z1), late-tick handling (Z2), sliding
rolling means (Z5).

Event time must be a session-zone TIMESTAMP (``withWatermark`` rejects
TIMESTAMP_NTZ), so the NTZ tick time is cast on the way in and window starts
are cast back to NTZ on the way out. Append mode emits a bar once the
watermark passes its window end; ticks older than the watermark are dropped
by the state store, never patched into emitted bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.windows import KEY, TIME

TICK_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def tick_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File source over a folder of tick files (new files = new micro-batches)."""
    r = spark.readStream.schema(TICK_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def _event_time(df: DataFrame, delay: str) -> DataFrame:
    return (df.where(F.col("value").isNotNull() & F.col("ts").isNotNull())
            .withColumn("event_time", F.col("ts").cast("timestamp"))
            .withWatermark("event_time", delay))


def stream_bars(ticks: DataFrame, bar: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window OHLCV per instrument with a watermark."""
    t = _event_time(ticks, delay)
    agg = (t.groupBy(F.window("event_time", bar).alias("w"), F.col("event_type").alias(KEY))
           .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"),
                F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
                F.count(F.lit(1)).cast("double").alias("volume"), F.sum("value").alias("amount")))
    return agg.select(KEY, F.col("w.start").cast("timestamp_ntz").alias(TIME),
                      "open", "high", "low", "close", "volume", "amount")


def stream_rolling(ticks: DataFrame, length: str = "3 hours", slide: str = "1 hour",
                   delay: str = "10 minutes") -> DataFrame:
    """Sliding-window mean / count of the tick value per instrument."""
    t = _event_time(ticks, delay)
    agg = (t.groupBy(F.window("event_time", length, slide).alias("w"), F.col("event_type").alias(KEY))
           .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_ticks")))
    return agg.select(KEY, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "mean_value", "n_ticks")


def run_to_folder(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  available_now: bool = True, fmt: str = "parquet"):
    """Start a query into a file sink; ``availableNow`` drains what exists and stops."""
    w = (stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
