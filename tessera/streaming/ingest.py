"""Events of files as a stream, applied to a store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("received_at", T.TimestampNTZType())])
#: What ends a file's life; the old name of a renamed file is gone as well.
GONE = ("Deleted", "Renamed")


def latest_events(events: DataFrame) -> DataFrame:
    """(path, event_type, ts): the last event of each path; at one time a later arrival, then an end of life, counts. NULL paths or
    times have no row. Events are reduced before they cross the network."""
    order = F.struct("ts", F.coalesce("received_at", "ts").alias("r"), F.col("event_type").isin(*GONE).alias("g"), "event_type")
    m = events.filter(F.col("path").isNotNull() & F.col("ts").isNotNull()).groupBy("path").agg(F.max(order).alias("m"))
    return m.select("path", F.col("m.event_type").alias("event_type"), F.col("m.ts").alias("ts"))


def live_paths(events: DataFrame) -> DataFrame:
    return latest_events(events).filter(~F.col("event_type").isin(*GONE))


def event_counts(events: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, event_type, n): distinct events per window; on a stream with a watermark of ``late``."""
    e = events.select("path", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    if events.isStreaming:
        e = e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "event_type", "ts"])
    else:
        e = e.dropDuplicates(["path", "event_type", "ts"])
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def event_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Files of events that arrive in a folder (or one that a pattern names)."""
    r = spark.readStream.schema(EVENTS)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as rows; the source needs its schema stated."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(schema).load(folder)


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """``state`` (path, event_type, ts) with a batch of events: last writer wins by time, whatever the order of arrival."""
    new = latest_events(batch)
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.col("event_type").isin(*GONE).desc(), "event_type")
    return state.select("path", "event_type", "ts").unionByName(new).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def tick_stream(spark: SparkSession) -> DataFrame:
    """A row a second, which only says that time has passed."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()


def run_stream(stream: DataFrame, checkpoint: str | None, apply: Callable[[DataFrame, int], None], once: bool = True, interval: str | None = None):
    """Feeds micro-batches to ``apply``: what is there now, then stop; with an ``interval``, until stopped. ``apply`` must be idempotent for a
    batch number, then a file counts exactly once however often executors or the driver are lost."""
    w = stream.writeStream.foreachBatch(apply)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
    if once and not interval:
        q.awaitTermination()
    return q
