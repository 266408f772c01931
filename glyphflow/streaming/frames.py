"""Frames as a stream: ordered numbering per source and grouping into batches, by Structured Streaming over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import results
from ..storage import new_folder


def frame_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A file stream whose pace is bounded by ``files_per_trigger``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(frames: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Frames of each stream and hour with their summed value; works alike on a stream (with a watermark) and a table."""
    timed = frames.select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    if frames.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy("stream_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n_frames"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select("stream_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n_frames", "value")


def numbered(frames: DataFrame) -> DataFrame:
    """``frame_num`` of every frame (stream_id, ts, event_id) in its stream, from 0, by time and then by id, nulls first; for tables.

    Frames are numbered over all streams and a stream's first number is taken off, so a stream of any length is dealt out; a null
    stream is one stream, repeated frames are numbered each.
    """
    placed = results.numbered(frames, "stream_id", "ts", "event_id")
    first = placed.groupBy(F.col("stream_id").alias("_of")).agg(F.min("_n").alias("_first"))
    joined = placed.join(first, placed["stream_id"].eqNullSafe(first["_of"]))
    return joined.withColumn("frame_num", F.col("_n") - F.col("_first")).drop("_n", "_of", "_first")


def run_available(frames: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is there into Parquet files below ``path`` and stop: each input file counts once, over restarts too."""
    frames.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scratch(spark: SparkSession) -> str:
    """A new folder for a stream's output and checkpoint, below the folder that driver and executors share."""
    return new_folder(spark, "stream")
