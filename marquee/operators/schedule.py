"""Schedules: due and stuck sources, recurring events, and rows that depend on rows before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Doublings of the interval at most, and minutes after which a run counts as stuck.
MAX_DOUBLINGS, STUCK_MINUTES = 6, 30


def due(sources: DataFrame, now: str) -> DataFrame:
    """Enabled sources to import: never imported or idle ones, and those whose interval, doubled
    for every retry after a failure, is over. Failed ones only while retries are left."""
    at = F.to_timestamp(F.lit(now))
    doublings = F.when((F.col("status") == "FAILED") & (F.col("retry_count") > 0), F.least(F.col("retry_count"), F.lit(MAX_DOUBLINGS))).otherwise(0)
    wait = (F.col("import_interval_minutes") * F.pow(F.lit(2), doublings)).cast("int")
    open_ = F.col("enabled") & ~F.col("status").isin("RUNNING", "MISCONFIGURED") & ((F.col("status") != "FAILED") | (F.col("retry_count") < F.col("max_retries")))
    return sources.filter(open_ & (F.col("last_import_at").isNull() | (F.col("status") == "IDLE") | (at > F.timestamp_add("MINUTE", wait, F.col("last_import_at")))))


def stuck(now: str) -> Column:
    return (F.col("status") == "RUNNING") & (F.col("last_import_at") < F.timestamp_add("MINUTE", F.lit(-STUCK_MINUTES), F.to_timestamp(F.lit(now))))


def reset_stuck(sources: DataFrame, now: str) -> DataFrame:
    """Stuck sources fail and count a retry; others stay."""
    s = stuck(now)
    return sources.withColumns({"retry_count": F.when(s, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "status": F.when(s, "FAILED").otherwise(F.col("status"))})


def recurring(rules: DataFrame, excluded: DataFrame, as_of: str, until: str) -> DataFrame:
    """(id, day) of rules (id, start, weeks, last, most) up to a horizon. At most `most` days are
    counted before exclusions (id, day) and past days are taken away."""
    end = F.least(F.coalesce("last", F.lit(until).cast("date")), F.lit(until).cast("date"))
    days = F.expr("sequence(start, x_end, make_interval(0, 0, weeks))")
    rows = rules.withColumn("x_end", end).filter("start <= x_end").withColumn("x_days", days)
    rows = rows.withColumn("x_days", F.when(F.col("most").isNull(), F.col("x_days")).otherwise(F.slice("x_days", F.lit(1), F.col("most"))))
    out = rows.select("id", F.explode("x_days").alias("day"))
    return out.filter(F.col("day") >= F.lit(as_of).cast("date")).join(excluded, ["id", "day"], "left_anti")


def weekly_nights(nights: DataFrame, as_of: str, count: int = 8) -> DataFrame:
    """(id, day): the next `count` dates of nights (id, weekday, paused_from), today included."""
    first = F.expr(f"next_day(date_sub(DATE '{as_of}', 1), weekday)")
    days = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.date_add(F.col("x_first"), (i * 7).cast("int")))
    rows = nights.withColumn("x_first", first).select("id", "paused_from", F.explode(days).alias("day"))
    return rows.filter(F.col("paused_from").isNull() | (F.col("day") < F.col("paused_from"))).select("id", "day")


def filled_forward(rows: DataFrame, column: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """column with its last value before, in order, in place of nulls."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def segments(rows: DataFrame, marker: Column, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with segment: how many markers stand at or before each."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(marker.cast("int")).over(w))


def age_minutes(at: Column, now: str) -> Column:
    return (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(at)) / 60
