"""Faceted search over event listings: filters, orders and pages as composed Columns.

An absent facet adds nothing to the plan. Facets on other tables are semi joins, so they never
multiply events; Catalyst chooses broadcast or shuffle by size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest range, in days, that may be asked for without pages.
MAX_RANGE_DAYS = 92


@dataclass(frozen=True)
class Facets:
    """What a search asks for; None and blank text mean: not asked."""

    date_from: date | None = None
    date_to: date | None = None
    event_type: str | None = None
    venue: str | None = None
    district: str | None = None
    genre: str | None = None
    artist: str | None = None
    promoter: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    text: str | None = None
    exclude_sold_out: bool = False
    only_free: bool = False


def price() -> Column:
    """The price that a search compares; unknown prices meet no bound."""
    return F.coalesce("price_presale", "price_box_office")


def given(value: str | None) -> bool:
    return value is not None and bool(value.strip())


def conditions(f: Facets, as_of: date) -> list[Column]:
    """The filters on the event table itself. Without any bound, only what is still to come is
    found; with an upper bound alone there is no lower one."""
    out = []
    if f.date_from is None and f.date_to is None:
        out.append(F.col("event_date") >= F.lit(as_of))
    if f.date_from is not None:
        out.append(F.col("event_date") >= F.lit(f.date_from))
    if f.date_to is not None:
        out.append(F.col("event_date") <= F.lit(f.date_to))
    if given(f.event_type):
        out.append(F.col("event_type") == f.event_type.strip().upper())
    if f.min_price is not None:
        out.append(price() >= F.lit(f.min_price).cast("decimal(10,2)"))
    if f.max_price is not None:
        out.append(price() <= F.lit(f.max_price).cast("decimal(10,2)"))
    if given(f.text):
        # % and _ in the text stay wildcards
        like = f"%{f.text}%"
        out.append(F.col("title").ilike(like) | F.coalesce(F.col("subtitle").ilike(like), F.lit(False)))
    if f.exclude_sold_out:
        out.append(~F.col("sold_out"))
    if f.only_free:
        out.append(F.col("free"))
    return out


def search(tables, f: Facets, as_of: date) -> DataFrame:
    """Events that meet all facets; unordered."""
    events = tables.event
    if found := conditions(f, as_of):
        events = events.filter(reduce(and_, found))
    if given(f.venue) or given(f.district):
        venues = tables.venue
        if given(f.venue):
            venues = venues.filter(F.col("slug") == f.venue)
        if given(f.district):
            venues = venues.filter(F.col("district") == f.district)
        events = events.join(venues.select(F.col("id").alias("venue_id")), "venue_id", "left_semi")
    if given(f.genre):
        events = events.join(tables.genre_links.filter(F.col("genre_slug") == f.genre).select(F.col("event_id").alias("id")), "id", "left_semi")
    if given(f.artist):
        one = tables.artist.filter(F.col("slug") == f.artist).select(F.col("id").alias("artist_id"))
        events = events.join(tables.event_artist.join(one, "artist_id").select(F.col("event_id").alias("id")), "id", "left_semi")
    if given(f.promoter):
        one = tables.promoter.filter(F.col("slug") == f.promoter).select(F.col("id").alias("promoter_id"))
        events = events.join(tables.event_promoter.join(one, "promoter_id").select(F.col("event_id").alias("id")), "id", "left_semi")
    return events


#: Sort keys that may be asked for, and their columns. Ascending puts nulls last, descending first.
SORTS = {"eventDate": "event_date", "startTime": "start_time", "title": "title", "pricePresale": "price_presale"}


def ordering(sorts: Sequence[tuple[str, bool]] = (), allowed: dict[str, str] = SORTS) -> list[Column]:
    """Columns for (key, ascending) pairs. Unknown keys are ignored, and none left means the
    default: date, start time, id. A sort by date goes on with the start time; all end with id."""
    out = []
    for key, ascending in sorts:
        if key in allowed:
            c = F.col(allowed[key])
            out.append(c.asc_nulls_last() if ascending else c.desc_nulls_first())
            if key == "eventDate":
                out.append(F.col("start_time").asc_nulls_last())
    if not out and allowed is SORTS:
        out = [F.col("event_date").asc_nulls_last(), F.col("start_time").asc_nulls_last()]
    return [*out, F.col("id").asc()]


def page(found: DataFrame, order: Sequence[Column], number: int = 0, size: int = 20) -> DataFrame:
    """One page. Sort, offset and limit become one top-k, so tasks send number * size + size rows
    each at most."""
    return found.orderBy(*order).offset(number * size).limit(size)


def page_meta(found: DataFrame, number: int, size: int) -> DataFrame:
    """(page, size, total_elements, total_pages) of a search."""
    pages = F.ceil(F.col("total_elements") / size).cast("long") if size else F.lit(0).cast("long")
    return found.agg(F.count(F.lit(1)).alias("total_elements")).select(F.lit(number).alias("page"), F.lit(size).alias("size"), "total_elements", pages.alias("total_pages"))


def calendar(tables, date_from: date, date_to: date) -> DataFrame:
    """All events of a range of at most MAX_RANGE_DAYS days."""
    if date_to < date_from:
        raise ValueError("the range ends before it begins")
    if date_from + timedelta(days=MAX_RANGE_DAYS) <= date_to:
        raise ValueError(f"the range spans over {MAX_RANGE_DAYS} days")
    return search(tables, Facets(date_from=date_from, date_to=date_to), date_from)


def named_like(rows: DataFrame, name: str | None = None, district: str | None = None) -> DataFrame:
    """Rows whose name holds a text, whatever its case, and whose district is the given one."""
    if given(name):
        rows = rows.filter(F.lower("name").contains(name.lower()))
    if given(district):
        rows = rows.filter(F.col("district") == district)
    return rows
