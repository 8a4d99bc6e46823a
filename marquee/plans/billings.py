"""Queries of line-ups, genre tags and documents for search engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import billing, genres
from marquee.operators import assemble, documents
from marquee.plans.registry import query
from marquee.sources.tables import Listings, over_model

SITE = "https://example.org"
#: Titles and subtitles made of orders, and the acts that they name.
_BILLS = (
    ("Moderat + Apparat", None, ["Moderat", "Apparat"]),
    ("Simon & Garfunkel", None, ["Simon & Garfunkel"]),
    ("Tigercub - NETS TO CATCH THE WIND", "Tour | Support: High On Fire & Gnome", ["Tigercub", "High On Fire", "Gnome"]),
    ("Grey City Fest Opener", "Opener: Warwolf + Special Guest: Motorjesus", ["Warwolf", "Motorjesus"]),
    ("Toshin and the Teleporters - 2 Sets!", None, ["Toshin and the Teleporters"]),
    ("TBA", "Support: Special Guest", []),
    ("Loft - Night of Lights", "Loft Concerts presents", []),
)


def _choice(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "][o_orderkey % 7 + 1]"


@query("headliners", f"SELECT o_orderkey AS id, unnest({'[' + ', '.join(str(b[2]) + '::VARCHAR[]' for b in _BILLS) + ']'}[o_orderkey % 7 + 1]) AS name FROM orders")
def headliners(spark, sf_dir):
    k = (F.col("o_orderkey") % 7).cast("int")
    title, subtitle = (F.get(F.array(*[F.lit(b[i]).cast("string") for b in _BILLS]), k) for i in (0, 1))
    rows = Listings(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), title.alias("title"), subtitle.alias("subtitle"))
    return rows.select("id", F.explode(billing.lineup_udf("title", "subtitle", F.lit("CONCERT"))["name"]).alias("name"))


@query("headliners_of_parts", """WITH b AS (SELECT o_orderkey AS id, a.p_name AS a, b.p_name AS b, c.p_name AS c FROM orders JOIN part a ON a.p_partkey = o_orderkey % 50 + 1 JOIN part b ON b.p_partkey = o_orderkey % 60 + 51 JOIN part c ON c.p_partkey = o_orderkey % 70 + 111)
    SELECT id, unnest(CASE id % 4 WHEN 0 THEN [a, b] WHEN 1 THEN [a, c] WHEN 2 THEN [a, b, c] ELSE [a] END) AS name FROM b""")
def headliners_of_parts(spark, sf_dir):
    """Line-ups from titles and subtitles that are put together of names: joint bills, support lines, tour notes."""
    t, k = Listings(spark, sf_dir), F.col("o_orderkey")
    part = lambda n: t.raw("part").select(F.col("p_partkey").alias(f"k{n}"), F.col("p_name").alias(n))
    rows = t.raw("orders").join(part("a"), k % 50 + 1 == F.col("ka")).join(part("b"), k % 60 + 51 == F.col("kb")).join(part("c"), k % 70 + 111 == F.col("kc"))
    title = F.when(k % 4 == 0, F.concat("a", F.lit(" + "), "b")).when(k % 4 == 2, F.concat("a", F.lit(" + "), "b")).when(k % 4 == 1, F.col("a")).otherwise(F.concat("a", F.lit(" - THE LONG TOUR")))
    subtitle = F.when(k % 4 == 1, F.concat(F.lit("Support: "), "c")).when(k % 4 == 2, F.concat(F.lit("Tour | Support: "), "c"))
    made = rows.select(k.alias("id"), title.alias("title"), subtitle.alias("subtitle"))
    return made.select("id", F.explode(billing.lineup_udf("title", "subtitle", F.lit("CONCERT"))["name"]).alias("name"))


@query("split_acts", "SELECT id, unnest([name, 'DJ ' || name, name || ' & the Band']) AS act FROM (SELECT p_partkey AS id, p_name AS name FROM part)")
def split_acts(spark, sf_dir):
    name = F.col("p_name")
    line = F.concat(name, F.lit(", DJ "), name, F.lit(" / "), name, F.lit(" & the Band"))
    return Listings(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.explode(billing.support_acts_udf(line)).alias("act"))


@query("genre_tags", over_model("""SELECT id, unnest(CASE genre WHEN 'Techno / House' THEN ['Techno', 'House'] WHEN 'Pop Punk, Indie' THEN ['Punk', 'Indie'] WHEN 'Jazz' THEN ['Jazz']
    WHEN 'Alternative / Indie' THEN ['Alternative', 'Indie'] END) AS tag FROM event"""))
def genre_tags(spark, sf_dir):
    return Listings(spark, sf_dir).event.select("id", F.explode(genres.tags_udf("genre")).alias("tag"))


_START = "CASE WHEN e.start_time IS NULL THEN e.event_date::VARCHAR ELSE e.event_date::VARCHAR || 'T' || e.start_time || CASE WHEN (e.event_date::VARCHAR || ' ' || e.start_time)::TIMESTAMP - (((e.event_date::VARCHAR || ' ' || e.start_time)::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC') = INTERVAL 2 HOUR THEN '+02:00' ELSE '+01:00' END END"
_PEOPLE = """(SELECT x.event_id, '"{key}":[' || string_agg('{{"@type":"{kind}","name":"' || p.name || '"}}', ',' ORDER BY {order}) || '],' AS j FROM {links} x JOIN {people} p ON p.id = x.{fk} GROUP BY x.event_id)"""


@query("jsonld_event", over_model(f"""SELECT e.id, '{{"@context":"https://schema.org","@type":"' || CASE e.event_type WHEN 'CONCERT' THEN 'MusicEvent' WHEN 'FESTIVAL' THEN 'MusicEvent' WHEN 'PARTY' THEN 'SocialEvent' ELSE 'Event' END
    || '","name":"' || e.title || '","startDate":"' || {_START} || '","location":{{"@type":"Place","name":"' || v.name || '","address":{{"@type":"PostalAddress","addressLocality":"Berlin","addressCountry":"DE"}}}},"url":"{SITE}/en/events/' || e.slug
    || '",' || coalesce('"description":"' || e.subtitle || '",', '') || '"eventStatus":"https://schema.org/' || CASE e.status WHEN 'CANCELLED' THEN 'EventCancelled' ELSE 'EventScheduled' END
    || '","eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode"' || coalesce(',' || rtrim(a.j, ','), '') || coalesce(',' || rtrim(o.j, ','), '')
    || coalesce(',"offers":{{"@type":"Offer","price":' || CASE WHEN e.free THEN '0.00' ELSE coalesce(e.price_presale, e.price_box_office)::VARCHAR END || ',"priceCurrency":"EUR","availability":"https://schema.org/' || CASE WHEN e.sold_out THEN 'SoldOut' ELSE 'InStock' END || '","url":"{SITE}/en/events/' || e.slug || '"}}', '') || '}}' AS document
    FROM event e JOIN venue v ON v.id = e.venue_id LEFT JOIN {_PEOPLE.format(key="performer", kind="PerformingGroup", order="x.billing_order, p.name", links="event_artist", people="artist", fk="artist_id")} a ON a.event_id = e.id
    LEFT JOIN {_PEOPLE.format(key="organizer", kind="Organization", order="p.name", links="event_promoter", people="promoter", fk="promoter_id")} o ON o.event_id = e.id"""))
def jsonld_event(spark, sf_dir):
    t = Listings(spark, sf_dir)
    return documents.event_documents(assemble.details(t, t.event), SITE)


@query("jsonld_venue", over_model(f"""SELECT id, '{{"@context":"https://schema.org","@type":"MusicVenue","name":"' || name || '","url":"{SITE}/en/venues/' || slug || '","address":{{"@type":"PostalAddress","addressLocality":"Berlin","addressCountry":"DE"}}}}' AS document FROM venue"""))
def jsonld_venue(spark, sf_dir):
    return documents.venue_documents(Listings(spark, sf_dir).venue, SITE)


@query("jsonld_breadcrumbs", over_model(f"""SELECT e.id, '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[' || CASE WHEN e.id % 5 = 0 THEN '' ELSE '{{"@type":"ListItem","position":1,"name":"Events","item":"{SITE}/de/events"}},{{"@type":"ListItem","position":2,"name":"' || v.name || '","item":"{SITE}/de/venues/' || v.slug || '"}},{{"@type":"ListItem","position":3,"name":"' || e.title || '"}}' END || ']}}' AS document
    FROM event e JOIN venue v ON v.id = e.venue_id"""))
def jsonld_breadcrumbs(spark, sf_dir):
    """The trail of each event's page; the last step has no link."""
    t = Listings(spark, sf_dir)
    venues = t.venue.select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), F.col("slug").alias("venue_slug"))
    step = lambda name, path: F.struct(name.alias("name"), path.alias("path"))
    trail = F.array(step(F.lit("Events"), F.lit("/events")), step(F.col("venue"), F.concat(F.lit("/venues/"), "venue_slug")), step(F.col("title"), F.concat(F.lit("/events/"), "slug")))
    pages = t.event.join(venues, "venue_id").select("id", F.when(F.col("id") % 5 != 0, trail).otherwise(F.slice(trail, 1, 0)).alias("trail"))
    return documents.breadcrumb_documents(pages, SITE, "de")


@query("jsonld_website", f"""SELECT l AS language, '{{"@context":"https://schema.org","@type":"WebSite","name":"Marquee","url":"{SITE}/' || l || '","inLanguage":"' || l || '"}}' AS document FROM (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'de' ELSE 'en' END AS l FROM nation)""")
def jsonld_website(spark, sf_dir):
    """The site itself, in the languages of its sources."""
    languages = Listings(spark, sf_dir).event_source.select(F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("language")).distinct()
    return documents.website_documents(languages, "Marquee", SITE)


@query("sitemap", over_model(f"""SELECT '{SITE}/' || l || path AS loc, '<url><loc>{SITE}/' || l || path || '</loc><xhtml:link href="{SITE}/en' || path || '" hreflang="en" rel="alternate"/><xhtml:link href="{SITE}/de' || path || '" hreflang="de" rel="alternate"/></url>' AS entry
    FROM (SELECT '/venues/' || slug AS path FROM venue), (SELECT unnest(['en', 'de']) AS l)"""))
def sitemap(spark, sf_dir):
    return documents.sitemap(Listings(spark, sf_dir).venue.select(F.concat(F.lit("/venues/"), F.col("slug")).alias("path")), SITE)
