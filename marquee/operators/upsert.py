"""From a scrape to table changes: first-wins dedup, stale rows, change detection, associations.

Every operator is a function of DataFrames; a scrape's page order is the column pos. Nothing is
gathered per source: windows are keyed by ids and slugs, and the rest are joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("x_rn", F.row_number().over(w)).filter("x_rn = 1").drop("x_rn")


def upcoming(scraped: DataFrame, as_of: str) -> DataFrame:
    """Rows that are not past; unresolved (null) dates drop out."""
    return scraped.filter(F.col("event_date") >= F.lit(as_of).cast("date"))


def sitting_key(title: Column, day: Column, start: Column) -> Column:
    """What two listings of one performance share: day, title and time."""
    slug = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(day.cast("string"), F.lit("-"), slug, F.coalesce(F.concat(F.lit("@"), F.date_format(F.to_timestamp(start, "HH:mm:ss"), "HHmm")), F.lit("@")))


def deduplicated(scraped: DataFrame, source: str = "event_source_id") -> DataFrame:
    """First listing of each source_id, then of those the first of each sitting, in page order.
    A repeated id never claims a sitting, so the two windows chain."""
    once = first_of(scraped, [source, "source_id"], ["pos"])
    keyed = once.withColumn("x_key", sitting_key(F.col("title"), F.col("event_date"), F.col("start_time")))
    return first_of(keyed, [source, "x_key"], ["pos"]).drop("x_key")


def discriminated(rows: DataFrame, slug: str = "slug") -> DataFrame:
    """Slugs that several rows share get the start time as a suffix; rows without one keep it."""
    shared = F.count(F.lit(1)).over(Window.partitionBy(slug)) > 1
    suffix = F.concat(F.lit("-"), F.replace(F.substring("start_time", 1, 5), F.lit(":"), F.lit("")))
    return rows.withColumn(slug, F.when(shared & F.col("start_time").isNotNull(), F.concat(F.col(slug), suffix)).otherwise(F.col(slug)))


def side_by_side(existing: DataFrame, scraped: DataFrame, key: Sequence[str]) -> DataFrame:
    """(o, n): for each key (nulls are values) the existing row and the scraped one as structs, null where there is
    none. One aggregation over both; a key stands at most once on either side."""
    sides = [df.select(*[F.col(c).alias(f"k_{c}") for c in key], F.struct(*df.columns).alias(here), F.lit(None).cast(other.schema).alias(there)) for df, here, there, other in ((existing, "o", "n", scraped), (scraped, "n", "o", existing))]
    return sides[0].unionByName(sides[1]).groupBy(*[f"k_{c}" for c in key]).agg(F.first("o", ignorenulls=True).alias("o"), F.first("n", ignorenulls=True).alias("n"))


def _with_reach(both: DataFrame, scraped: DataFrame, source: str) -> DataFrame:
    """side_by_side with the last day that its source's scrape lists."""
    reach = scraped.groupBy(F.col(source).alias("x_source")).agg(F.max("event_date").alias("x_last"))
    return both.join(reach, F.col(f"o.{source}") == F.col("x_source"), "left")


def _gone(as_of: str) -> Column:
    """An existing row that the scrape no longer lists, from tomorrow to its source's last day."""
    day = F.col("o.event_date")
    return F.col("n").isNull() & F.coalesce((day > F.lit(as_of).cast("date")) & (day <= F.col("x_last")), F.lit(False))


def stale(existing: DataFrame, scraped: DataFrame, as_of: str, source: str = "event_source_id") -> DataFrame:
    """Existing rows that the scrape no longer lists, from tomorrow to its source's last date.
    Today and the past are never retracted, and a source without a scrape retracts nothing."""
    narrow = scraped.select(source, "source_id", "event_date").dropDuplicates([source, "source_id"])
    both = side_by_side(existing, narrow, [source, "source_id"]).filter("o IS NOT NULL")
    return _with_reach(both, scraped, source).filter(_gone(as_of)).select("o.*")


def changes(scraped: DataFrame, existing: DataFrame, columns: Sequence[str], key: str = "source_id") -> DataFrame:
    """scraped with op: INSERT, UPDATE if any of columns differs (nulls are values), else SKIP."""
    old = existing.select(key, *[F.col(c).alias(f"x_{c}") for c in columns], F.lit(True).alias("x_known"))
    both = scraped.join(old, key, "left")
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"x_{c}"))
    op = F.when(F.col("x_known").isNull(), "INSERT").when(same, "SKIP").otherwise("UPDATE")
    return both.withColumn("op", op).select(*scraped.columns, "op")


def outcome(changed: DataFrame) -> DataFrame:
    """(inserted, updated, skipped, total), one row."""
    one = [F.count_if(F.col("op") == op).alias(name) for op, name in (("INSERT", "inserted"), ("UPDATE", "updated"), ("SKIP", "skipped"))]
    return changed.agg(*one, F.count(F.lit(1)).alias("total"))


def upserted(existing: DataFrame, scraped: DataFrame, columns: Sequence[str], as_of: str) -> DataFrame:
    """The table after an import: past listings dropped, the rest deduplicated, stale rows
    deleted, changed rows replaced and new ones added. Applying it twice changes nothing more."""
    fresh = deduplicated(upcoming(scraped, as_of)).select(*existing.columns)
    both = _with_reach(side_by_side(existing, fresh, ["source_id"]), fresh, "event_source_id")
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    stays = F.col("n").isNull() | (F.col("o").isNotNull() & same)
    return both.filter(~_gone(as_of)).select(F.when(stays, F.col("o")).otherwise(F.col("n")).alias("r")).select("r.*")


def association_diff(desired: DataFrame, existing: DataFrame, key: Sequence[str], attributes: Sequence[str] = ()) -> DataFrame:
    """(key..., op, attributes...): INSERT, UPDATE or DELETE that turn existing into desired.
    Of repeated desired keys the one with the smallest attributes counts."""
    want = desired.groupBy(*key).agg(F.min(F.struct(*attributes, F.lit(True).alias("x_w"))).alias("d"))
    have = existing.select(*key, F.struct(*attributes, F.lit(True).alias("x_w")).alias("e"))
    both = want.join(have, list(key), "full_outer")
    same = F.lit(True)
    for a in attributes:
        same &= F.col(f"d.{a}").eqNullSafe(F.col(f"e.{a}"))
    op = F.when(F.col("e").isNull(), "INSERT").when(F.col("d").isNull(), "DELETE").when(~same, "UPDATE")
    return both.withColumn("op", op).filter("op IS NOT NULL").select(*key, "op", *[F.coalesce(f"d.{a}", f"e.{a}").alias(a) for a in attributes])


def replaced(links: DataFrame, new: DataFrame, saved: DataFrame, key: Sequence[str]) -> DataFrame:
    """links where those of the saved owners (key) have given way to the new ones; new links of owners that are not
    saved are left out, and a saved owner may keep none."""
    owners = saved.select(*key).distinct()
    return links.join(owners, list(key), "left_anti").unionByName(new.join(owners, list(key), "left_semi"))


def missing(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Requested keys that do not exist."""
    return requested.select(key).distinct().join(existing.select(key), key, "left_anti")


def resolved(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(slug, name, id, created) of candidates (slug, name): known slugs keep their rows, others
    get the smallest name and an id from a hash of the slug, so that no counter is shared."""
    wanted = candidates.filter("slug <> ''").groupBy("slug").agg(F.min("name").alias("x_name"))
    both = wanted.join(existing.select("slug", "name", "id"), "slug", "left")
    return both.select("slug", F.coalesce("name", "x_name").alias("name"), F.coalesce("id", F.xxhash64("slug")).alias("id"), F.col("id").isNull().alias("created"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "source", value: str = "n") -> DataFrame:
    """(key, before, after, verdict): REGRESSION, grew, same, GONE or new."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "GONE").when(F.col("after") < F.col("before"), "REGRESSION").when(F.col("after") > F.col("before"), "grew").otherwise("same")
    return both.withColumn("verdict", verdict)
