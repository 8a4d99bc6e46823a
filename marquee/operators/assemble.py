"""Assembled results: events with their venue, line-up, promoters and genres.

All kinds of links of the events at hand are gathered by one aggregation over their union. The events
of a page are fetched first, a bounded number of rows: their ids then reach the scans of the link
tables as literals, and the search behind the page runs once. Events without a bound, as in a
calendar, restrict the union by one semi join, which Catalyst moves below the links' own joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a page at most.
PAGE = 100


def fetched(page: DataFrame, size: int = PAGE) -> tuple[DataFrame, list[int]]:
    """The rows of a page of at most size rows, as a table that no longer depends on the search, and
    their ids."""
    rows = page.limit(size + 1).collect()
    if len(rows) > size:
        raise ValueError(f"a page has at most {size} rows")
    return page.sparkSession.createDataFrame(rows, page.schema), [r["id"] for r in rows]


#: What a link carries, whatever its kind; kinds leave null what they do not have.
LINK = {"by": "string", "id": "long", "slug": "string", "name": "string", "image_url": "string", "website_url": "string", "role": "string", "billing_order": "int", "stage": "string"}


def _or_null(table: DataFrame, column: str, kind: str = "string") -> Column:
    """A column, or nulls where the table has none."""
    return (F.col(column) if column in table.columns else F.lit(None)).cast(kind)


def _of(links: DataFrame, kind: str, by: Column) -> DataFrame:
    given = {c: _or_null(links, c, t) for c, t in LINK.items()} | {"by": by}
    return links.select("event_id", F.lit(kind).alias("kind"), F.struct(*[v.cast(LINK[c]).alias(c) for c, v in given.items()]).alias("link"))


def linked(tables, events: DataFrame, ids: Sequence[int] | None, kinds: Sequence[str]) -> DataFrame:
    """(id, *kinds): arrays of LINK for events, in order: artists by place on the bill, genres by slug,
    promoters by name; ties by id and name. Links to what does not exist drop out, and an event without
    any link has no row. ids, where given, are those of the events. All kinds are gathered by one
    aggregation, and the events' ids are looked up in them once."""

    def own(table: DataFrame) -> DataFrame:
        return table if ids is None else table.filter(F.col("event_id").isin(list(ids)))

    def artists() -> DataFrame:
        bill = own(tables.event_artist)
        if "role" not in bill.columns:
            bill = bill.withColumn("role", F.when(F.col("billing_order") == 1, "HEADLINER").otherwise("SUPPORT"))
        both = bill.join(tables.artist.withColumnRenamed("id", "artist_id"), "artist_id").withColumnRenamed("artist_id", "id")
        # places as text of one width, so that they sort as numbers do
        return _of(both, "artists", F.lpad(F.col("billing_order").cast("string"), 20, "0"))

    def genres() -> DataFrame:
        return _of(own(tables.event_genre_tag).join(tables.genre_tag.withColumn("genre_slug", F.col("slug")), "genre_slug"), "genres", F.col("genre_slug"))

    def promoters() -> DataFrame:
        both = own(tables.event_promoter).join(tables.promoter.withColumnRenamed("id", "promoter_id"), "promoter_id").withColumnRenamed("promoter_id", "id")
        return _of(both, "promoters", F.col("name"))

    made = {"artists": artists, "genres": genres, "promoters": promoters}
    first, *rest = (made[k]() for k in kinds)
    for other in rest:
        first = first.unionByName(other)
    if ids is None:
        first = first.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return first.groupBy(F.col("event_id").alias("id")).agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("link")))).alias(k) for k in kinds])


def links(tables, events: DataFrame, ids: Sequence[int] | None, kinds: Sequence[str]) -> DataFrame:
    """(id, *kinds): the names of linked, ties of a place by name."""
    named = lambda k: F.transform(F.sort_array(F.transform(k, lambda x: F.struct(x["by"], x["name"]))), lambda x: x["name"])
    return linked(tables, events, ids, kinds).select("id", *[named(k).alias(k) for k in kinds])


def _or_none(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>")).alias(name)


def summaries(tables, events: DataFrame, ids: Sequence[int] | None = None, kinds: Sequence[str] = ("artists", "genres")) -> DataFrame:
    """events with venue_name, district and an array for each of kinds (empty if none). An event whose
    venue does not exist is an error. ids, where given, are those of events (see fetched)."""
    venues = tables.venue.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), "district")
    known = F.coalesce("venue_name", F.raise_error(F.concat(F.lit("no venue of event "), F.col("id").cast("string"))).cast("string"))
    out = events.join(venues, "venue_id", "left").withColumn("venue_name", known).join(links(tables, events, ids, kinds), "id", "left")
    return out.select(*[c for c in out.columns if c not in kinds], *map(_or_none, kinds))


def details(tables, events: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Summaries with promoters (by name) added."""
    return summaries(tables, events, ids, ("artists", "genres", "promoters"))


# Fields of results, in their order.
EVENT = {
    "id": "long", "slug": "string", "title": "string", "subtitle": "string", "event_type": "string", "status": "string", "event_date": "date", "doors_time": "string", "start_time": "string", "image_url": "string",
    "price_presale": "decimal(10,2)", "price_box_office": "decimal(10,2)", "price_currency": "string", "price_note": "string", "sold_out": "boolean", "free": "boolean",
}
DETAIL = {"description": "string", "source_url": "string", "ticket_url": "string", "facebook_event_url": "string", "genre": "string"}
ADMIN = {"venue_id": "long", "source_id": "string", "created_at": "timestamp", "updated_at": "timestamp"}
VENUE = {"id": "long", "slug": "string", "name": "string", "city": "string", "address": "string", "district": "string", "image_url": "string"}


def _event(events: DataFrame, fields: dict[str, str]) -> list[Column]:
    """Fields of events; prices are in euros and flags false where a table does not say."""
    known = {"price_currency": F.lit("EUR"), "sold_out": F.lit(False), "free": F.lit(False)}
    return [F.coalesce(_or_null(events, c, t), known[c]).alias(c) if c in known else _or_null(events, c, t).alias(c) for c, t in fields.items()]


def _with(tables, events: DataFrame, ids: Sequence[int] | None, kinds: Sequence[str], venue: bool = True) -> DataFrame:
    """events with an array of LINK for each kind and, if asked for, venue as a struct of VENUE; a missing venue is
    an error."""
    out = events.join(linked(tables, events, ids, kinds), "id", "left")
    for k in kinds:
        out = out.withColumn(k, F.coalesce(k, F.array().cast(out.schema[k].dataType)))
    if not venue:
        return out
    v = tables.venue
    venues = v.select(F.col("id").alias("venue_id"), F.struct(*[_or_null(v, c, t).alias(c) for c, t in VENUE.items()]).alias("venue"))
    known = F.when(F.col("venue").isNull(), F.raise_error(F.concat(F.lit("no venue of event "), F.col("id").cast("string"))).cast(venues.schema["venue"].dataType)).otherwise(F.col("venue"))
    return out.join(venues, "venue_id", "left").withColumn("venue", known)


def event_summaries(tables, events: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """The nineteen fields of an event in a list: EVENT, venue (struct), artist_names by place on the bill, and
    genre_tags."""
    out = _with(tables, events, ids, ("artists", "genres"))
    return out.select(*_event(out, EVENT), "venue", F.transform("artists", lambda x: x["name"]).alias("artist_names"), F.transform("genres", lambda x: x["name"]).alias("genre_tags"))


def event_details(tables, events: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """An event's page: EVENT and DETAIL, venue, lineup (artist as a struct, role, billing_order, stage), promoters
    (structs) and genre_tags."""
    out = _with(tables, events, ids, ("artists", "genres", "promoters"))
    act = lambda x: F.struct(F.struct(x["id"].alias("id"), x["slug"].alias("slug"), x["name"].alias("name"), x["image_url"].alias("image_url")).alias("artist"), x["role"].alias("role"), x["billing_order"].alias("billing_order"), x["stage"].alias("stage"))
    host = lambda x: F.struct(*[x[c].alias(c) for c in ("id", "slug", "name", "website_url", "image_url")])
    return out.select(*_event(out, EVENT | DETAIL), "venue", F.transform("artists", act).alias("lineup"), F.transform("promoters", host).alias("promoters"), F.transform("genres", lambda x: x["name"]).alias("genre_tags"))


def admin_events(tables, events: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """An event as its editors see it: EVENT, DETAIL and ADMIN, artists (id, role, billing_order, stage),
    promoter_ids in ascending order and genre_tags."""
    out = _with(tables, events, ids, ("artists", "genres", "promoters"), venue=False)
    act = lambda x: F.struct(x["id"].alias("artist_id"), x["role"].alias("role"), x["billing_order"].alias("billing_order"), x["stage"].alias("stage"))
    return out.select(*_event(out, EVENT | DETAIL | ADMIN), F.transform("artists", act).alias("artists"), F.array_sort(F.transform("promoters", lambda x: x["id"])).alias("promoter_ids"), F.transform("genres", lambda x: x["name"]).alias("genre_tags"))
