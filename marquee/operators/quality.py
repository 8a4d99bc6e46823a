"""Data quality: per-source counts in one pass, worklists, snapshots and coverage drops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def issues() -> dict[str, Column]:
    """Issue by key; reports count by these and worklists filter by them."""
    unpriced = F.col("price_presale").isNull() & F.col("price_box_office").isNull() & ~F.col("free") & F.col("price_note").isNull()
    return {
        "concerts_without_artist": (F.col("event_type") == "CONCERT") & ~F.col("has_artist"),
        "events_typed_other": F.col("event_type") == "OTHER",
        "missing_genre": F.coalesce("genre", F.lit("")) == "",
        "missing_promoter": ~F.col("has_promoter"),
        "missing_price": unpriced,
        "missing_start_time": F.col("start_time").isNull(),
    }


def flagged(tables) -> DataFrame:
    """Events with has_artist and has_promoter: one left join each against distinct keys."""
    artists = tables.event_artist.select(F.col("event_id").alias("id")).distinct().withColumn("a", F.lit(True))
    promoters = tables.event_promoter.select(F.col("event_id").alias("id")).distinct().withColumn("p", F.lit(True))
    rows = tables.event.join(artists, "id", "left").join(promoters, "id", "left")
    return rows.withColumn("has_artist", F.col("a").isNotNull()).withColumn("has_promoter", F.col("p").isNotNull()).drop("a", "p")


def percent(part: Column, whole: Column) -> Column:
    """Percent to one decimal, ties to even; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.rint(part * 1000.0 / whole) / 10.0)


def label(source_id: Column, slug: Column) -> Column:
    """A source's name: manual without a source, unresolved-source-<id> if it is unknown."""
    return F.when(source_id.isNull(), "manual").otherwise(F.coalesce(slug, F.concat(F.lit("unresolved-source-"), source_id.cast("string"))))


def counts_per_source(events: DataFrame) -> DataFrame:
    counts = [F.count_if(c).alias(k) for k, c in issues().items()]
    concerts = F.count_if(F.col("event_type") == "CONCERT").alias("concerts")
    return events.groupBy("event_source_id").agg(F.count(F.lit(1)).alias("total"), concerts, *counts)


def report(tables) -> DataFrame:
    """A row per source: total and a count for each issue."""
    counts = counts_per_source(flagged(tables))
    names = tables.event_source.select(F.col("id").alias("event_source_id"), "slug")
    return counts.join(names, "event_source_id", "left").select(label(F.col("event_source_id"), F.col("slug")).alias("source"), "total", *issues())


def overall(per_source: DataFrame) -> DataFrame:
    """One row of sums and percents over a report."""
    sums = per_source.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in issues()])
    return sums.select("*", *[percent(F.col(k), F.col("total")).alias(f"{k}_pct") for k in issues()])


def with_total(tables) -> DataFrame:
    """The report with a row named overall, from one rollup of the grouped counts."""
    r = report(tables)
    return r.rollup("source").agg(F.sum("total").alias("total"), *[F.sum(k).alias(k) for k in issues()]).withColumn("source", F.coalesce("source", F.lit("overall")))


def worklist(tables, issue: str, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events with an issue, latest first, of one source if given."""
    known = issues()
    if issue not in known:
        raise ValueError(f"unknown issue {issue}; there are {', '.join(known)}")
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must lie in 1..500 and offset not below 0")
    names = tables.event_source.select(F.col("id").alias("event_source_id"), F.col("slug").alias("source_slug"))
    rows = flagged(tables).filter(known[issue]).join(names, "event_source_id", "left").withColumn("source", label(F.col("event_source_id"), F.col("source_slug")))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return rows.select("id", "title", "event_date", "source").orderBy(F.col("event_date").desc(), F.col("id").desc()).offset(offset).limit(limit)


def snapshot(per_source: DataFrame, day: str) -> DataFrame:
    """The report in long form: (snapshot_date, source_slug, metric, metric_count, total_events)."""
    pairs = ", ".join(f"'{k}', {k}" for k in issues())
    long = per_source.select("source", "total", F.expr(f"stack({len(issues())}, {pairs}) AS (metric, metric_count)"))
    return long.select(F.lit(day).cast("date").alias("snapshot_date"), F.col("source").alias("source_slug"), "metric", "metric_count", F.col("total").alias("total_events"))


def merged_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots with those of new in place of old ones with the same day, source and metric."""
    key = ["snapshot_date", "source_slug", "metric"]
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


#: Values that stand for no title, without dots and in lower case.
PLACEHOLDERS = ("tba", "tbd", "tbc", "nn", "na", "null", "-", "")


def placeholder(name: Column) -> Column:
    return F.lower(F.trim(F.replace(name, F.lit("."), F.lit("")))).isin(*PLACEHOLDERS)


def suspects(names: DataFrame, suspect: Column) -> DataFrame:
    """(source, n): distinct suspect names of rows (source, name)."""
    return names.select("source", "name").distinct().filter(suspect).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def coverage(events: DataFrame, present: dict[str, Column], by: str) -> DataFrame:
    """(<by>, field, total, with_value) for each field of present, from one aggregation."""
    wide = events.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f) for f, c in present.items()])
    return wide.unpivot([by, "total"], list(present), "field", "with_value")


#: The detector's settings: runs of the baseline, runs it needs, events a run needs, and how far
#: coverage must fall (share of the baseline, and points).
RUNS, LEAST_RUNS, LEAST_EVENTS, FALL_TO, FALL_BY = 10, 3, 10, 0.5, 0.2


def baselines(stats: DataFrame, key: list[str], at: str = "observed_at") -> DataFrame:
    """Rows with ratio, the median ratio of up to RUNS earlier runs (null under LEAST_RUNS), and
    the run's own before it."""
    order = Window.partitionBy(*key).orderBy(at)
    before = order.rowsBetween(-RUNS, -1)
    rows = stats.withColumn("ratio", F.col("events_with_value") / F.col("events_total"))
    median = F.when(F.count("ratio").over(before) >= LEAST_RUNS, F.percentile("ratio", 0.5).over(before))
    return rows.withColumn("baseline", median).withColumn("previous", F.lag("ratio").over(order))


def drop(ratio: Column, base: Column, fall_to: float = FALL_TO, fall_by: float = FALL_BY) -> Column:
    return (ratio <= base * fall_to) & (base - ratio >= fall_by)


def findings(stats: DataFrame, key: list[str], least_events: int = LEAST_EVENTS, fall_to: float = FALL_TO, fall_by: float = FALL_BY) -> DataFrame:
    """Runs in which coverage fell against the baseline for the second time on end."""
    rows = baselines(stats, key)
    tests = [F.col("events_total") >= least_events, F.col("baseline").isNotNull(), drop(F.col("ratio"), F.col("baseline"), fall_to, fall_by), drop(F.col("previous"), F.col("baseline"), fall_to, fall_by)]
    return rows.filter(reduce(lambda a, b: a & b, tests))


def latest(stats: DataFrame, key: list[str], n: int, at: str = "observed_at") -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col(at).desc())
    return stats.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def tracked() -> dict[str, Column]:
    """Whether a staged record carries each of the fields that an import watches, by their names: texts that are
    not blank, other values that are there, lists with members. priceAny is any of the three prices."""

    def text(c: str) -> Column:
        return F.coalesce(~F.col(c).rlike(r"^\s*$"), F.lit(False))

    def some(c: str) -> Column:
        return F.coalesce(F.size(c) > 0, F.lit(False))

    there = {c: F.col(c).isNotNull() for c in ("doors_time", "start_time", "price_presale", "price_box_office")}
    return {
        "subtitle": text("subtitle"),
        "description": text("description"),
        "eventType": text("event_type"),
        "doorsTime": there["doors_time"],
        "startTime": there["start_time"],
        "imageUrl": text("image_url"),
        "ticketUrl": text("ticket_url"),
        "genre": text("genre"),
        "pricePresale": there["price_presale"],
        "priceBoxOffice": there["price_box_office"],
        "priceNote": text("price_note"),
        "priceAny": there["price_presale"] | there["price_box_office"] | text("price_note"),
        "artists": some("artists"),
        "promoters": some("promoters"),
    }
