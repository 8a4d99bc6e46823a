"""Queries of the read API: searches, pages, lists and details."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marquee.operators import assemble, search
from marquee.operators.search import Facets
from marquee.plans.registry import query
from marquee.sources.tables import AS_OF, Listings, over_model

TODAY = date.fromisoformat(AS_OF)
BRIEF = ["id", "event_date", "start_time", "title", "price_presale"]


def _search(name: str, where: str, **facets) -> None:
    """Registers an unpaged search by facets, and its SQL by condition."""

    @query(name, over_model(f"SELECT {', '.join(BRIEF)} FROM event WHERE {where}"))
    def run(spark, sf_dir, f=Facets(**facets)):
        return search.search(Listings(spark, sf_dir), f, TODAY).select(*BRIEF)


_UPCOMING = f"event_date >= DATE '{AS_OF}'"
_search("search_open_ended_to", "event_date <= DATE '1996-01-31'", date_to=date(1996, 1, 31))
_search("search_date_range", "event_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-15'", date_from=date(1997, 3, 1), date_to=date(1997, 4, 15))
_search("search_by_type", f"{_UPCOMING} AND event_type = 'PARTY'", event_type=" party ")
_search("search_by_venue", f"{_UPCOMING} AND venue_id IN (SELECT id FROM venue WHERE slug = 'customer-000000007')", venue="customer-000000007")
_search("search_by_district", f"{_UPCOMING} AND venue_id IN (SELECT id FROM venue WHERE district = 'BUILDING')", district="BUILDING")
_search("search_by_genre", f"{_UPCOMING} AND EXISTS (SELECT 1 FROM event_genre_tag g WHERE g.event_id = event.id AND g.genre_slug = 'economy')", genre="economy")
_search("search_by_artist", f"{_UPCOMING} AND EXISTS (SELECT 1 FROM event_artist x JOIN artist a ON a.id = x.artist_id WHERE x.event_id = event.id AND a.slug = 'a-77')", artist="a-77")
_search("search_by_promoter", f"{_UPCOMING} AND id IN (SELECT x.event_id FROM event_promoter x JOIN promoter p ON p.id = x.promoter_id WHERE p.slug = 'supplier-000000003')", promoter="supplier-000000003")
_search("search_price_band", f"{_UPCOMING} AND coalesce(price_presale, price_box_office) BETWEEN 1000.00 AND 90000.00", min_price=1000, max_price=90000)
_search("search_text", f"{_UPCOMING} AND (title ILIKE '%ght _2%' OR subtitle ILIKE '%ght _2%')", text="ght _2")
_search("search_text_subtitle", f"{_UPCOMING} AND (title ILIKE '%URGENT%' OR subtitle ILIKE '%URGENT%')", text="urgent")
_search("search_exclude_sold_out", f"{_UPCOMING} AND NOT sold_out", exclude_sold_out=True)
_search("search_only_free", f"{_UPCOMING} AND free", only_free=True)
_search("search_blank_facets", _UPCOMING, venue=" ", text="", genre=None)


def _page(name: str, order: str, sorts=(), number: int = 0) -> None:
    @query(name, over_model(f"SELECT {', '.join(BRIEF)} FROM event WHERE {_UPCOMING} ORDER BY {order} LIMIT 20 OFFSET {20 * number}"))
    def run(spark, sf_dir):
        found = search.search(Listings(spark, sf_dir), Facets(), TODAY).select(*BRIEF)
        return search.page(found, search.ordering(sorts), number)


_DEFAULT = "event_date, start_time NULLS LAST, id"
_page("search_upcoming_default", _DEFAULT)
_page("search_third_page", _DEFAULT, number=2)
_page("search_sort_price_asc", "price_presale ASC NULLS LAST, id", [("pricePresale", True)])
_page("search_sort_price_desc", "price_presale DESC NULLS FIRST, id", [("pricePresale", False)])
_page("search_sort_date_desc", "event_date DESC, start_time ASC NULLS LAST, id", [("eventDate", False)])
_page("search_sort_title_time", "title ASC NULLS LAST, start_time DESC NULLS FIRST, id", [("title", True), ("startTime", False)])
_page("search_unknown_sort", _DEFAULT, [("password", True)])

_LISTS = """, lineup AS (SELECT x.event_id, string_agg(a.name, '|' ORDER BY x.billing_order, a.name) AS artists FROM event_artist x JOIN artist a ON a.id = x.artist_id GROUP BY x.event_id),
tags AS (SELECT x.event_id, string_agg(g.name, '|' ORDER BY g.slug, g.name) AS genres FROM event_genre_tag x JOIN genre_tag g ON g.slug = x.genre_slug GROUP BY x.event_id),
hosts AS (SELECT x.event_id, string_agg(p.name, '|' ORDER BY p.name) AS promoters FROM event_promoter x JOIN promoter p ON p.id = x.promoter_id GROUP BY x.event_id)
"""
_SUMMARY = "e.id, e.event_date, e.start_time, e.title, e.price_presale, v.name AS venue_name, v.district, coalesce(artists, '') AS artists, coalesce(genres, '') AS genres"
_JOINS = "JOIN venue v ON v.id = e.venue_id LEFT JOIN lineup l ON l.event_id = e.id LEFT JOIN tags t ON t.event_id = e.id"


def _flat(df, *lists):
    for c in lists:
        df = df.withColumn(c, F.array_join(c, "|"))
    return df


def _summary(tables, events, ids=None):
    return _flat(assemble.summaries(tables, events, ids), "artists", "genres").select(*BRIEF, "venue_name", "district", "artists", "genres")


@query("search_all_facets", over_model(f"""{_LISTS} SELECT {_SUMMARY} FROM (SELECT * FROM event WHERE event_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND event_type = 'CONCERT'
    AND venue_id IN (SELECT id FROM venue WHERE district = 'BUILDING') AND id IN (SELECT event_id FROM event_genre_tag WHERE genre_slug = 'economy')
    AND coalesce(price_presale, price_box_office) BETWEEN 100.00 AND 400000.00 AND title ILIKE '%night%' AND NOT sold_out
    ORDER BY {_DEFAULT} LIMIT 20) e {_JOINS}"""))
def search_all_facets(spark, sf_dir):
    tables = Listings(spark, sf_dir)
    f = Facets(date_from=date(1996, 1, 1), date_to=date(2000, 12, 31), event_type="concert", district="BUILDING", genre="economy", min_price=100, max_price=400000, text="NIGHT", exclude_sold_out=True)
    return _summary(tables, *assemble.fetched(search.page(search.search(tables, f, TODAY), search.ordering())))


@query("search_page_meta", over_model(f"SELECT 2 AS page, 20 AS size, count(*) AS total_elements, ceil(count(*) / 20)::BIGINT AS total_pages FROM event WHERE {_UPCOMING}"))
def search_page_meta(spark, sf_dir):
    return search.page_meta(search.search(Listings(spark, sf_dir), Facets(), TODAY), 2, 20)


@query("today_events", over_model(f"{_LISTS} SELECT {_SUMMARY} FROM event e {_JOINS} WHERE e.event_date = DATE '{AS_OF}'"))
def today_events(spark, sf_dir):
    tables = Listings(spark, sf_dir)
    return _summary(tables, search.search(tables, Facets(date_from=TODAY, date_to=TODAY), TODAY))


@query("calendar_window", over_model(f"{_LISTS} SELECT {_SUMMARY} FROM event e {_JOINS} WHERE e.event_date BETWEEN DATE '{AS_OF}' AND DATE '1998-08-20'"))
def calendar_window(spark, sf_dir):
    tables = Listings(spark, sf_dir)
    return _summary(tables, search.calendar(tables, TODAY, date(1998, 8, 20)))


@query("event_detail", over_model(f"{_LISTS} SELECT {_SUMMARY}, coalesce(promoters, '') AS promoters FROM event e {_JOINS} LEFT JOIN hosts h ON h.event_id = e.id WHERE e.slug = 'e-101'"))
def event_detail(spark, sf_dir):
    tables = Listings(spark, sf_dir)
    one = assemble.fetched(tables.event_of("e-101"))
    return _flat(assemble.details(tables, *one), "artists", "genres", "promoters").select(*BRIEF, "venue_name", "district", "artists", "genres", "promoters")


def _json(*columns):
    """Nested columns as JSON, nulls included, for comparison as text."""
    return [F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in columns]


_NULL = "NULL::VARCHAR"
_EVENT_SQL = f"e.id, e.slug, e.title, e.subtitle, e.event_type, e.status, e.event_date, {_NULL} AS doors_time, e.start_time, {_NULL} AS image_url, e.price_presale, e.price_box_office, 'EUR' AS price_currency, e.price_note, e.sold_out, e.free"
_VENUE_SQL = "to_json({'id': v.id, 'slug': v.slug, 'name': v.name, 'city': v.city, 'address': NULL, 'district': v.district, 'image_url': NULL})::VARCHAR AS venue"
_TAGS_SQL = "coalesce((SELECT to_json(list(g.name ORDER BY g.slug, g.name)) FROM event_genre_tag x JOIN genre_tag g ON g.slug = x.genre_slug WHERE x.event_id = e.id)::VARCHAR, '[]') AS genre_tags"
_ROLE_SQL = "CASE WHEN x.billing_order = 1 THEN 'HEADLINER' ELSE 'SUPPORT' END"
_DAYS = f"e.event_date BETWEEN DATE '{AS_OF}' AND DATE '1998-06-20'"


def _near(tables):
    return search.search(tables, Facets(date_from=TODAY, date_to=date(1998, 6, 20)), TODAY)


@query("event_summaries_nested", over_model(f"""SELECT {_EVENT_SQL}, {_VENUE_SQL}, coalesce((SELECT to_json(list(a.name ORDER BY x.billing_order, a.id)) FROM event_artist x JOIN artist a ON a.id = x.artist_id WHERE x.event_id = e.id)::VARCHAR, '[]') AS artist_names, {_TAGS_SQL}
    FROM event e JOIN venue v ON v.id = e.venue_id WHERE {_DAYS}"""))
def event_summaries_nested(spark, sf_dir):
    """All nineteen fields of listed events, the venue nested."""
    tables = Listings(spark, sf_dir)
    found = assemble.event_summaries(tables, _near(tables))
    return found.select(*list(assemble.EVENT), *_json("venue", "artist_names", "genre_tags"))


@query("event_details_nested", over_model(f"""SELECT {_EVENT_SQL}, {', '.join(f'{_NULL} AS {c}' for c in ('description', 'source_url', 'ticket_url', 'facebook_event_url'))}, e.genre, {_VENUE_SQL},
    coalesce((SELECT to_json(list({{'artist': {{'id': a.id, 'slug': a.slug, 'name': a.name, 'image_url': NULL}}, 'role': {_ROLE_SQL}, 'billing_order': x.billing_order, 'stage': NULL}} ORDER BY x.billing_order, a.id)) FROM event_artist x JOIN artist a ON a.id = x.artist_id WHERE x.event_id = e.id)::VARCHAR, '[]') AS lineup,
    coalesce((SELECT to_json(list({{'id': p.id, 'slug': p.slug, 'name': p.name, 'website_url': NULL, 'image_url': NULL}} ORDER BY p.name, p.id)) FROM event_promoter x JOIN promoter p ON p.id = x.promoter_id WHERE x.event_id = e.id)::VARCHAR, '[]') AS promoters, {_TAGS_SQL}
    FROM event e JOIN venue v ON v.id = e.venue_id WHERE {_DAYS}"""))
def event_details_nested(spark, sf_dir):
    """Events' pages: line-ups, promoters and venues as nested values."""
    tables = Listings(spark, sf_dir)
    found = assemble.event_details(tables, _near(tables))
    return found.select(*assemble.EVENT, *assemble.DETAIL, *_json("venue", "lineup", "promoters", "genre_tags"))


@query("admin_events_nested", over_model(f"""SELECT e.id, e.venue_id, e.source_id, e.genre, coalesce((SELECT to_json(list({{'artist_id': x.artist_id, 'role': {_ROLE_SQL}, 'billing_order': x.billing_order, 'stage': NULL}} ORDER BY x.billing_order, x.artist_id)) FROM event_artist x WHERE x.event_id = e.id)::VARCHAR, '[]') AS artists,
    coalesce((SELECT to_json(list(x.promoter_id ORDER BY x.promoter_id)) FROM event_promoter x WHERE x.event_id = e.id)::VARCHAR, '[]') AS promoter_ids, {_TAGS_SQL} FROM event e WHERE {_DAYS}"""))
def admin_events_nested(spark, sf_dir):
    """Events as editors see them: ids and roles of artists, ids of promoters, names of genres."""
    tables = Listings(spark, sf_dir)
    found = assemble.admin_events(tables, _near(tables))
    return found.select("id", "venue_id", "source_id", "genre", *_json("artists", "promoter_ids", "genre_tags"))


@query("events_by_ids", over_model("SELECT e.id, e.title, k.pos FROM (VALUES (33, 0), (1, 1), (7, 2), (999999999, 3)) k(id, pos) JOIN event e ON e.id = k.id"))
def events_by_ids(spark, sf_dir):
    keys = spark.createDataFrame([(33, 0), (1, 1), (7, 2), (999999999, 3)], "id long, pos int")
    return Listings(spark, sf_dir).event.join(F.broadcast(keys), "id").select("id", "title", "pos").orderBy("pos")


def _list(name: str, table: str, columns: list[str], where: str, text=None, district=None, order=None) -> None:
    @query(name, over_model(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"))
    def run(spark, sf_dir):
        rows = search.named_like(getattr(Listings(spark, sf_dir), table), text, district)
        return rows.select(*columns).orderBy(*(order or ["name", "id"]))


_list("venue_list", "venue", ["id", "name", "slug", "district", "city"], "true")
_list("venue_list_name_district", "venue", ["id", "name", "slug"], "lower(name) LIKE '%0001%' AND district = 'BUILDING'", "0001", "BUILDING")
_list("artist_list", "artist", ["id", "name", "slug"], "lower(name) LIKE '%ring%'", "RING")
_list("promoter_list", "promoter", ["id", "name", "slug"], "true", "  ")
_list("genre_list", "genre_tag", ["name", "slug"], "true", order=["name"])
