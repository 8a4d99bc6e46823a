"""Windowed counts and duplicates over a stream of events, by Structured Streaming.

These extend the listing operators, which know no streams. State is bounded by the watermark and
the number of open windows; results are tables in the shared folder, where each batch has a folder
of its own that a replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.shared import shared_folder

LATE = "1 hour"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def writer(path: str, mode: str) -> Callable[[DataFrame, int], None]:
    """What writes a batch to its folder; complete results replace one another."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={'last' if mode == 'complete' else number}")

    return write


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream yields of all data available now; in complete mode the last state."""
    spark = stream.sparkSession
    path = shared_folder(spark, "stream")
    schema = stream.schema

    stream.writeStream.foreachBatch(writer(path, mode)).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def tumbling(stream: DataFrame, width: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, width: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def once(stream: DataFrame, key: list[str]) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(key)
