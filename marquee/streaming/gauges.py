"""Gauges of sources, kept up to date by a stream: what a dashboard reads is a versioned table, a row for each
source, into which every micro-batch merges the sources that it has changed. A batch that is written again,
as after a failure, is found among those written and changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.versions import Table

SCHEMA = "region string, source string, events long, valuable long, last long"


def gauges(events: DataFrame, sources: DataFrame) -> DataFrame:
    """(region, source, events, valuable, last) of events (source_id, value, ts), a table or a stream, joined with the
    table of sources (source_id, source, region); last is the latest time in microseconds. Events of
    unknown sources count for the source "unknown"."""
    both = events.join(sources, "source_id", "left")
    keys = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("region", "source")]
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce(F.col("value") > 50, F.lit(False))).alias("valuable"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))


def merger(table: Table, name: str) -> Callable[[DataFrame, int], None]:
    """What merges a micro-batch into the table by region and source; name tells queries apart."""

    def merge(batch: DataFrame, number: int) -> None:
        table.save(batch.select(*table.columns), f"{name}-{number}")

    return merge


def keep(events: DataFrame, sources: DataFrame, table: Table, name: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over what is there now. State is a row for each source."""
    write = gauges(events, sources).writeStream.outputMode("update").foreachBatch(merger(table, name))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
