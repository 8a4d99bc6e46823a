"""Fields of JSON payloads as VARIANT: paths, presence, the events that a page builder embeds in its
pages, their local schedules and states. All of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The script that holds the embedded state, the events application in it, and numbers of
# its states and kinds of registration.
WARMUP_SCRIPT = "#wix-warmup-data"
EVENTS_APP = "140603ad-af8d-84a5-2c80-a0f60cb47351"
CANCELLED, TICKETS = 3, 2
FALLBACK_ZONE = "Europe/Berlin"
INSTANT = r"^[+-]?\d{4,10}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)$"


def presence(record: Column, path: str) -> Column:
    """"value", "null" (the path leads to a JSON null) or "missing"."""
    found = F.try_variant_get(record, path, "variant")
    return F.when(found.isNull(), "missing").when(F.is_variant_null(found), "null").otherwise("value")


def text_at(record: Column, path: str) -> Column:
    """A trimmed text, number or truth value at a path; null where it is missing, null or blank, and for
    objects and lists."""
    found = F.try_variant_get(record, path, "variant")
    plain = ~F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)")
    return F.nullif(F.btrim(F.when(plain, F.try_variant_get(record, path, "string")), F.lit(" \t\n\r\u000b\u000c")), F.lit(""))


def texts_at(record: Column, path: str) -> Column:
    """The trimmed texts of a list that are not null or blank; empty where there is no list."""
    found = F.try_variant_get(record, path, "array<string>")
    return F.coalesce(F.filter(F.transform(found, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def embedded_events(state: Column) -> Column:
    """The events (an array of VARIANT) in the JSON that a page builder embeds: of the widgets of its events
    application, in the order of the page, the first that has a list of events; null without one, and
    for what is no JSON."""
    widgets = F.map_values(F.from_json(F.get_json_object(state, f"$.appsWarmupData['{EVENTS_APP}']"), "map<string, string>"))
    lists = F.transform(widgets, lambda w: F.try_variant_get(F.try_parse_json(w), "$.events.events", "array<variant>"))
    return F.get(F.filter(lists, lambda x: x.isNotNull()), F.lit(0))


def known_zone(zone: Column) -> Column:
    """A zone if it is one, else the fallback."""
    known = F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), zone), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()
    return F.when(known, zone).otherwise(FALLBACK_ZONE)


def clock(instant: Column, zone: Column) -> Column:
    """A written instant (UTC or with an offset) as the clock of a zone shows it; null for what is none. No
    session zone has a say in it."""
    micros = F.unix_micros(F.try_to_timestamp(F.when(instant.rlike(INSTANT), instant)))
    # whole seconds and the rest apart: both fit an interval's seconds
    since = F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), known_zone(zone), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + since)


def schedule(event: Column, config: str = "$.scheduling.config") -> tuple[Column, Column]:
    """Local date and time (HH:mm:ss) of an embedded event; null without a start."""
    local = clock(text_at(event, f"{config}.startDate"), text_at(event, f"{config}.timeZoneId"))
    return F.to_date(local), F.date_format(local, "HH:mm:ss")


def embedded_status(event: Column) -> Column:
    """CANCELLED or SCHEDULED; numbers of other states, and what is no number, are SCHEDULED."""
    return F.when(F.try_variant_get(event, "$.status", "int") == CANCELLED, "CANCELLED").otherwise("SCHEDULED")


def embedded_sold_out(event: Column) -> Column:
    """Sold out, which an event tells truly only where its tickets are sold on the page itself."""
    own = F.try_variant_get(event, "$.registration.type", "int") == TICKETS
    return F.coalesce(own & F.try_variant_get(event, "$.registration.ticketing.soldOut", "boolean"), F.lit(False))


def resolved(base: Column, address: Column) -> Column:
    """An address as seen from a page: absolute ones, and those that begin with a host, a path, a query or a
    name beside the page's own. Steps upwards in paths stay as they are."""
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(address.startswith("http"), address)
        .when(address.startswith("//"), F.concat(scheme, address))
        .when(address.startswith("/"), F.concat(origin, address))
        .when(address.startswith("?"), F.concat(page, address))
        .when(address.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), address))
        .otherwise(F.concat(folder, address))
    )
