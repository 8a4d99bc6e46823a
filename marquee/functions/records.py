"""Fields of scraped records as Column expressions: titles, types, times, prices, labels; and the
event row that a record becomes. All of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import classify
from marquee.functions.names import slug_udf
from marquee.operators import upsert

# Characters that titles lose, notes before and behind them, and labels.
ZERO_WIDTH = r"[\u200b-\u200d\ufeff]"
BLANKS = r"[\s\u00a0\u202f]+"
MOVED_BEFORE = r"(?i)^\s*[-–—]?\s*verlegt\s+ins?\s+.+?\s*[-–—]\s*"
NOTES_BEHIND = (
    r"(?i)\s+[-–—(]*\s*(?:nachholtermin|hochverlegung|verschoben|verlegt\s+(?:ins|nach))\b.*$"
    r"|\s+[-–—(]*\s*ausverkauft!?\s*\)?\s*$"
    r"|\s+[-–—]\s*$"
)
BOX_OFFICE = r"(?i)abendkasse|\bak\b"
STATES = ("SCHEDULED", "RELOCATED", "CANCELLED", "POSTPONED")
TYPES = ("CONCERT", "FESTIVAL", "PARTY", "QUIZ", "CLUB_NIGHT", "SHOW", "SCREENING", "EXHIBITION", "READING", "OTHER")
DISTRICTS = {
    "mitte": "Mitte", "friedrichshain-kreuzberg": "Friedrichshain-Kreuzberg", "pankow": "Pankow", "charlottenburg-wilmersdorf": "Charlottenburg-Wilmersdorf", "spandau": "Spandau",
    "steglitz-zehlendorf": "Steglitz-Zehlendorf", "tempelhof-schoeneberg": "Tempelhof-Schöneberg", "neukoelln": "Neukölln", "treptow-koepenick": "Treptow-Köpenick",
    "marzahn-hellersdorf": "Marzahn-Hellersdorf", "lichtenberg": "Lichtenberg", "reinickendorf": "Reinickendorf",
}


def _or(text: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(text), F.lit("")), otherwise)


def without_move(title: Column) -> Column:
    """A title without the note before it that the show has moved; never blank for it."""
    return _or(F.regexp_replace(title, F.lit(MOVED_BEFORE), F.lit("")), F.btrim(title))


def clean_title(title: Column) -> Column:
    """A title with single blanks and no invisible characters, without notes behind it (new dates,
    moves, sold out, stray dashes); never blank for it. Notes go in one pass: what one leaves behind
    stays, as the dash of "Luna - (verschoben aus 2026)"."""
    plain = F.regexp_replace(F.btrim(F.regexp_replace(title, ZERO_WIDTH, "")), BLANKS, " ")
    return _or(F.regexp_replace(plain, F.lit(NOTES_BEHIND), F.lit("")), plain)


def concert_type(title: Column) -> Column:
    """The type of an event that a concert venue leaves open."""
    return F.coalesce(classify.type_of_title(title), F.lit("CONCERT"))


def unmarked_type(title: Column) -> Column:
    """The type of an event without the mark that its venue gives to concerts."""
    return F.coalesce(classify.type_of_title(title), F.lit("OTHER"))


def refined_type(kind: Column, title: Column) -> Column:
    """A venue's own type where it is specific; otherwise what the title tells."""
    return F.when(kind.isNull(), concert_type(title)).when(kind == "OTHER", unmarked_type(title)).otherwise(kind)


def time_of(text: Column) -> Column:
    """HH:mm as HH:mm:ss; null for what is no time."""
    return F.when(F.btrim(text).rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.concat(F.btrim(text), F.lit(":00")))


def iso_date(text: Column) -> Column:
    day = F.substring_index(text, "T", 1)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def iso_time(text: Column) -> Column:
    """The time behind the T, if it is a bare HH:mm."""
    return time_of(F.regexp_extract(text, "^[^T]*T(.*)$", 1))


def real_date(text: Column) -> Column:
    """The leading ISO date of a date, time and offset."""
    return iso_date(F.substring_index(F.btrim(text), " ", 1))


def in_order(doors: Column, start: Column) -> tuple[Column, Column]:
    """Doors and start, swapped where doors come later."""
    both = doors.isNotNull() & start.isNotNull()
    return F.when(both, F.least(doors, start)).otherwise(doors), F.when(both, F.greatest(doors, start)).otherwise(start)


def local_time(instant: Column, zone: Column, zones: tuple[str, ...], fallback: str = "Europe/Berlin") -> Column:
    """An instant in UTC on the clock of its zone; zones that are not among zones are fallback's."""
    return F.from_utc_timestamp(instant, F.when(zone.isin(*zones), zone).otherwise(fallback))


def prices(labelled: Column) -> tuple[Column, Column]:
    """Presale and box office of an array of (label, text): the first amount of each sort."""
    known = F.filter(F.transform(labelled, lambda p: F.struct(F.coalesce(p["label"], F.lit("")).rlike(BOX_OFFICE).alias("box"), classify.price_of(p["text"]).alias("amount"))), lambda p: p["amount"].isNotNull())
    return F.get(F.filter(known, lambda p: ~p["box"]), F.lit(0))["amount"], F.get(F.filter(known, lambda p: p["box"]), F.lit(0))["amount"]


def district_label(slug: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DISTRICTS.items() for x in kv])
    return F.coalesce(F.element_at(known, slug), slug, F.lit(""))


def humanised(name: Column) -> Column:
    """CLUB_NIGHT as Club night."""
    words = F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def camel(name: Column) -> Column:
    """MISSING_START_TIME as missingStartTime."""
    parts = F.split(F.lower(name), "_")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 20), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), ""))


def labelled(title: Column, venue: Column) -> Column:
    """title @ venue, or the one that is there."""
    title, venue = F.nullif(title, F.lit("")), F.nullif(venue, F.lit(""))
    return F.coalesce(F.concat(title, F.lit(" @ "), venue), title, venue, F.lit(""))


def weekend(today: Column) -> tuple[Column, Column]:
    """From Friday, or from today once it is Friday, to Sunday."""
    day = F.weekday(today) + 1
    return F.when(day < 5, F.date_add(today, 5 - day)).otherwise(today), F.date_add(today, 7 - day)


def days_of(instant: Column, zone: str = "Europe/Berlin") -> tuple[Column, Column]:
    """Today and tomorrow on a zone's calendar at an instant in UTC (a timestamp without a zone); tomorrow is the
    next day there, also where a clock changes."""
    today = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))
    return today, F.date_add(today, 1)


def failure_reason(status: Column, error: Column) -> Column:
    """Why a page could not be read, from an HTTP status or the sort of error."""
    return (
        F.when(status == 429, "http_rate_limited")
        .when(status == 403, "http_forbidden")
        .when(status.between(400, 499), "http_4xx")
        .when(status.between(500, 599), "http_5xx")
        .when(status.isNotNull(), "http_other")
        .when(error == "unknown_host", "dns")
        .when(error == "timeout", "timeout")
        .when(error == "io", "network")
        .when(error.isin("state", "argument", "null", "index"), "parse")
        .otherwise("other")
    )


def named(value: Column, known: tuple[str, ...], otherwise: str) -> Column:
    """One of known, whatever its case and the blanks around it; otherwise for all else."""
    name = F.upper(F.btrim(value))
    return F.when(name.isin(*known), name).otherwise(otherwise)


#: Columns that an event row takes over from its record as they are.
PLAIN = ("subtitle", "description", "image_url", "source_url", "ticket_url", "genre", "price_note")


def event_rows(scraped: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Staged records (marquee.sources.registry.STAGED, with venue_id, venue_slug and event_source_id) as whole
    event rows. The slug is made of day, venue, title and, where several records of a venue's day share
    these, the start (see upsert.discriminated). Doors that come later than the start change places
    with it; unknown states are SCHEDULED, unknown types OTHER before title and genre have their say;
    amounts have two digits, in euros. A record says itself that entry is free, or its prices, note
    and title do. existing (id, source_id, created_at): rows of a known source_id keep these; others
    have null for id and created_at."""
    doors, start = in_order(F.col("doors_time"), F.col("start_time"))
    presale, box = (F.col(c).cast("decimal(10,2)") for c in ("price_presale", "price_box_office"))
    kind = classify.resolved_type(named(F.col("event_type"), TYPES, "OTHER"), F.col("title"), F.coalesce("genre", F.lit("")))
    free = F.coalesce("free", F.lit(False)) | classify.is_free(presale, box, F.coalesce("price_note", F.lit("")), F.col("title"))
    rows = scraped.select(
        "source_id",
        "venue_id",
        "event_source_id",
        "title",
        slug_udf(F.concat_ws("-", F.col("event_date").cast("string"), "venue_slug", "title")).alias("slug"),
        kind.alias("event_type"),
        named(F.col("status"), STATES, "SCHEDULED").alias("status"),
        "event_date",
        doors.alias("doors_time"),
        start.alias("start_time"),
        *PLAIN,
        presale.alias("price_presale"),
        box.alias("price_box_office"),
        F.lit("EUR").alias("price_currency"),
        F.coalesce("sold_out", F.lit(False)).alias("sold_out"),
        free.alias("free"),
    )
    rows = upsert.discriminated(rows)
    if existing is None:
        return rows.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("created_at"), *rows.columns)
    known = existing.select("source_id", "id", "created_at")
    return rows.join(known, "source_id", "left").select("id", "created_at", *rows.columns)


#: Columns of an event that an editor's request holds as they are.
ASKED = ("venue_id", "title", *PLAIN, "source_id", "event_date", "doors_time", "start_time", "price_currency", "sold_out", "free", "facebook_event_url")


def requested(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Event rows of an editor's requests (ASKED, with event_type, status, price_presale, price_box_office and
    venue_slug, and id where an event is replaced): slug of day, venue and title, amounts with two
    digits. Of existing (id, event_source_id, created_at) a replaced event keeps its source and its
    creation; new ones have null for both. A request for an unknown id is an error."""
    made = requests.select(
        "id",
        *ASKED,
        "event_type",
        "status",
        slug_udf(F.concat_ws("-", F.col("event_date").cast("string"), "venue_slug", "title")).alias("slug"),
        *[F.col(c).cast("decimal(10,2)").alias(c) for c in ("price_presale", "price_box_office")],
    )
    if existing is None:
        return made.select("*", F.lit(None).cast("long").alias("event_source_id"), F.lit(None).cast("timestamp").alias("created_at"))
    known = existing.select("id", "event_source_id", "created_at", F.lit(True).alias("x_known"))
    both = made.join(known, "id", "left")
    sure = F.when(F.col("id").isNull() | F.col("x_known"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no event "), F.col("id").cast("string"))).cast("long"))
    return both.withColumn("id", sure).drop("x_known")


def patched(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the values of changes where those have any."""
    new = changes.select(key, *[F.col(c).alias(f"x_{c}") for c in columns])
    both = rows.join(new, key, "left")
    return both.select(*[F.coalesce(f"x_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def carried(rows: DataFrame, page: str, at: list[str], heading: Column, value: Column, name: str) -> DataFrame:
    """The rows below headings of a page, each with the value of the heading above it; rows before
    the first heading carry null."""
    above = Window.partitionBy(page).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("x_heading", heading).withColumn(name, F.last(F.when(heading, value), ignorenulls=True).over(above))
    return marked.filter(~F.col("x_heading")).drop("x_heading")
