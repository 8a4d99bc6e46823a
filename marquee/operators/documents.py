"""Documents for search engines: schema.org JSON of events and venues, and site-map entries.

All of it is built by JVM functions; absent values leave their fields out. A site map is one row
per page and language, so a large one is written by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schema.org terms of the types and states of events.
TERMS = {"CONCERT": "MusicEvent", "FESTIVAL": "MusicEvent", "CLUB_NIGHT": "MusicEvent", "PARTY": "SocialEvent", "QUIZ": "SocialEvent", "SCREENING": "ScreeningEvent", "EXHIBITION": "ExhibitionEvent"}
STATES = {"SCHEDULED": "https://schema.org/EventScheduled", "CANCELLED": "https://schema.org/EventCancelled", "POSTPONED": "https://schema.org/EventPostponed"}
SCHEMA, OFFLINE = "https://schema.org", "https://schema.org/OfflineEventAttendanceMode"
ZONE = "Europe/Berlin"


def _term(column: Column, known: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), column)


def local_start(day: Column, time: Column, zone: str = ZONE) -> Column:
    """yyyy-MM-ddTHH:mm:ss with the zone's offset; the day alone without a time."""
    at = F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), time))
    minutes = ((F.unix_timestamp(at) - F.unix_timestamp(F.to_utc_timestamp(at, zone))) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.coalesce(F.concat(day.cast("string"), F.lit("T"), time, offset), day.cast("string"))


def _named(kind: str, names: Column) -> Column:
    """An array of things with a name, or null without any."""
    things = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(F.lit(kind).alias("@type"), n.alias("name")))
    return F.when(F.size(things) > 0, things)


def event_documents(events: DataFrame, site: str, language: str = "en") -> DataFrame:
    """(id, document) of rows as assemble.details gives them; document is null where the title,
    the day or the venue's name is."""
    url = F.concat(F.lit(f"{site}/{language}/events/"), F.col("slug"))
    price = F.when(F.col("free"), F.lit(0).cast("decimal(10,2)")).otherwise(F.coalesce("price_presale", "price_box_office"))
    sold = F.when(F.col("sold_out"), f"{SCHEMA}/SoldOut").otherwise(f"{SCHEMA}/InStock")
    offer = F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.lit("EUR").alias("priceCurrency"), sold.alias("availability"), url.alias("url"))
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.lit("Berlin").alias("addressLocality"), F.lit("DE").alias("addressCountry"))
    place = F.struct(F.lit("Place").alias("@type"), F.col("venue_name").alias("name"), address.alias("address"))
    document = F.struct(
        F.lit(SCHEMA).alias("@context"), F.coalesce(_term(F.col("event_type"), TERMS), F.lit("Event")).alias("@type"), F.col("title").alias("name"),
        local_start(F.col("event_date"), F.col("start_time")).alias("startDate"), place.alias("location"), url.alias("url"), F.col("subtitle").alias("description"),
        _term(F.col("status"), STATES).alias("eventStatus"), F.lit(OFFLINE).alias("eventAttendanceMode"), _named("PerformingGroup", F.col("artists")).alias("performer"),
        _named("Organization", F.col("promoters")).alias("organizer"), F.when(price.isNotNull() & url.isNotNull(), offer).alias("offers"),
    )
    whole = F.col("title").isNotNull() & F.col("event_date").isNotNull() & F.col("venue_name").isNotNull()
    return events.select("id", F.when(whole, F.to_json(document)).alias("document"))


def venue_documents(venues: DataFrame, site: str, language: str = "en") -> DataFrame:
    """(id, document) of venues (id, name, slug, city); document is null without a name."""
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.coalesce("city", F.lit("Berlin")).alias("addressLocality"), F.lit("DE").alias("addressCountry"))
    url = F.concat(F.lit(f"{site}/{language}/venues/"), F.col("slug"))
    document = F.struct(F.lit(SCHEMA).alias("@context"), F.lit("MusicVenue").alias("@type"), "name", url.alias("url"), address.alias("address"))
    return venues.select("id", F.when(F.col("name").isNotNull(), F.to_json(document)).alias("document"))


def breadcrumb_documents(pages: DataFrame, site: str, language: str = "en") -> DataFrame:
    """(id, document) of pages (id, trail: an array of name and path, from the site's top to the page itself). The page
    itself has no link; an empty trail has an empty list, a null one no document."""
    count = F.size("trail")
    item = lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), F.when(i + 1 < count, F.concat(F.lit(f"{site}/{language}"), x["path"])).alias("item"))
    document = F.struct(F.lit(SCHEMA).alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.transform("trail", item).alias("itemListElement"))
    return pages.select("id", F.when(F.col("trail").isNotNull(), F.to_json(document)).alias("document"))


def website_documents(languages: DataFrame, name: str, site: str) -> DataFrame:
    """(language, document): the site itself in each language."""
    document = F.struct(F.lit(SCHEMA).alias("@context"), F.lit("WebSite").alias("@type"), F.lit(name).alias("name"), F.concat(F.lit(f"{site}/"), "language").alias("url"), F.col("language").alias("inLanguage"))
    return languages.select("language", F.to_json(document).alias("document"))


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def sitemap(paths: DataFrame, site: str, languages: Sequence[str] = ("en", "de")) -> DataFrame:
    """(loc, entry) for each path and language: every entry names its alternates, itself too.
    Rows without a path drop out."""
    links = F.lit("")
    for x in languages:
        href = _escaped(F.concat(F.lit(f"{site}/{x}"), F.col("path")))
        links = F.concat(links, F.lit('<xhtml:link href="'), href, F.lit(f'" hreflang="{x}" rel="alternate"/>'))
    loc = F.concat(F.lit(f"{site}/"), F.col("language"), F.col("path"))
    rows = paths.filter("path IS NOT NULL").select("path", F.explode(F.array(*map(F.lit, languages))).alias("language"))
    return rows.select(loc.alias("loc"), F.concat(F.lit("<url><loc>"), _escaped(loc), F.lit("</loc>"), links, F.lit("</url>")).alias("entry"))
