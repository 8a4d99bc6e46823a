"""Types, states, prices and dates of listings as Column expressions; all of it runs in the JVM.

The order of the rules decides, so each is a chain of `when`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and words that listings use, and what they stand for.
TYPE_LABELS = {
    "konzert": "CONCERT", "concert": "CONCERT", "festival": "FESTIVAL", "party": "PARTY", "quiz": "QUIZ", "show": "SHOW", "public viewing": "SCREENING",
    "lesung": "READING", "reading": "READING", "ausstellung": "EXHIBITION", "exhibition": "EXHIBITION", "vernissage": "EXHIBITION", "sonstiges": "OTHER", "other": "OTHER",
}
SHOW_WORDS = ("wrestling", "burlesque", "circus")
SCREENING_WORDS = ("public viewing", "live-screening", "screening", "world cup", "weltmeisterschaft", "fußball", "fussball", "wm-quartier", "11freunde")
READING_WORDS = ("lesung", "lesedüne")
EXHIBITION_WORDS = ("ausstellung", "exhibition", "vernissage")
OTHER_WORDS = ("markt",)
PARTY_WORDS = ("aftershow", "afterparty", "after-party", "after party", "party", "club night", "clubnight", "karaoke")
FREE_PHRASES = ("eintritt frei", "freier eintritt", "kostenloser eintritt", "free entry", "free admission")
FREE_TOKENS = ("free", "frei", "gratis", "kostenlos", "umsonst")
MONTHS = {"jan": 1, "feb": 2, "mär": 3, "märz": 3, "mrz": 3, "maer": 3, "maerz": 3, "apr": 4, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12}
FESTIVAL = r"(?i)\b(festivaltickets?|festivals?)\b"
PRICE = "(\\d+(?:[.,]\\d{1,2})?)[\\s ]*€"


def _holds(text: Column, words) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def type_of_label(label: Column, extra: dict[str, str] | None = None) -> Column:
    """The type that a label names, or null."""
    pairs = TYPE_LABELS | (extra or {})
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.element_at(known, F.lower(F.trim(label)))


def is_screening(text: Column) -> Column:
    low = F.lower(text)
    return _holds(low, SCREENING_WORDS) | low.rlike(r"\bkino\b")


def type_of_title(title: Column) -> Column:
    """The type that words of a title tell, or null."""
    low = F.lower(title)
    return (
        F.when(low.contains("quiz"), "QUIZ")
        .when(_holds(low, SHOW_WORDS), "SHOW")
        .when(is_screening(title), "SCREENING")
        .when(_holds(low, READING_WORDS) | low.rlike(r"\bslam\b"), "READING")
        .when(_holds(low, EXHIBITION_WORDS), "EXHIBITION")
        .when(_holds(low, OTHER_WORDS), "OTHER")
        .when(_holds(low, PARTY_WORDS) | low.rlike(r"\brave\b"), "PARTY")
    )


def type_of_genre(genre: Column) -> Column:
    low = F.lower(genre)
    return F.when(is_screening(genre), "SCREENING").when(_holds(low, READING_WORDS) | low.rlike(r"\bslam\b"), "READING").when(_holds(low, EXHIBITION_WORDS), "EXHIBITION")


def resolved_type(kind: Column, title: Column, genre: Column) -> Column:
    """Concerts and others give way to what the title (a festival) or the genre tells."""
    open_ = F.coalesce(kind, F.lit("OTHER")).isin("CONCERT", "OTHER")
    return F.when(open_ & title.rlike(FESTIVAL), "FESTIVAL").when(open_, F.coalesce(type_of_genre(genre), kind, F.lit("OTHER"))).otherwise(kind)


def status_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("abgesagt") | low.contains("cancel"), "CANCELLED").when(low.contains("verschoben") | low.contains("postpon"), "POSTPONED").when(low.contains("verlegt") | low.contains("reloc"), "RELOCATED").otherwise("SCHEDULED")


def status_of_schema(url: Column) -> Column:
    """The state that a schema.org term names."""
    term = F.substring_index(url, "/", -1)
    return F.when(term == "EventCancelled", "CANCELLED").when(term.isin("EventPostponed", "EventRescheduled"), "POSTPONED").when(term == "EventMovedOnline", "RELOCATED").otherwise("SCHEDULED")


def is_free(presale: Column, box_office: Column, note: Column, title: Column) -> Column:
    phrase = f"(?i){'|'.join(FREE_PHRASES)}"
    token = rf"(?i)\b({'|'.join(FREE_TOKENS)})\b"
    tests = [presale == 0, box_office == 0, title.rlike(phrase), note.rlike(phrase), note.rlike(token)]
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def price_of(text: Column) -> Column:
    """The first amount in euros, or null."""
    return F.replace(F.nullif(F.regexp_extract(text, PRICE, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(10,2)")


def german_date(text: Column, short: bool = False) -> Column:
    """d.M.yyyy, or d.M.yy of this century; null for what is no date."""
    return F.try_to_date(F.trim(text), "d.M.yy" if short else "d.M.yyyy")


def month_of(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.element_at(known, F.lower(F.btrim(text, F.lit(",. "))))


def inferred_date(month: Column, day: Column, weekday: Column, as_of: str, window: int = 2) -> Column:
    """The date with this month and day that lies nearest to as_of, on the weekday (1: Monday) if
    one of the years around has it there; null if no year has the day. Of two as near ones the
    earlier counts."""
    today = F.lit(as_of).cast("date")
    years = F.sequence(F.year(today) - window, F.year(today) + window)
    dates = F.filter(F.transform(years, lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")), lambda d: d.isNotNull())
    fits = F.filter(dates, lambda d: F.weekday(d) + 1 == weekday)
    pool = F.when(F.size(fits) > 0, fits).otherwise(dates)
    return F.array_min(F.transform(pool, lambda d: F.struct(F.abs(F.datediff(d, today)), d.alias("d"))))["d"]


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits with single dashes between."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def url_slug(url: Column) -> Column:
    """The last part of a URL's path."""
    path = F.rtrim(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return F.substring_index(path, "/", -1)
