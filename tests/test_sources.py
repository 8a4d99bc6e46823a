"""Registered sources, VARIANT fields and embedded schedules by example, and what they do not read."""

import json

import pytest
from pyspark.sql import functions as F

from marquee.functions import payloads, records
from marquee.sources.registry import STAGED, Registry, Source

PAGES = "source string, url string, page string"


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def state(widgets, app=payloads.EVENTS_APP):
    return json.dumps({"appsWarmupData": {app: widgets}})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (state({"z": {"events": {"events": [{"a": 1}]}}, "a": {"events": {"events": [{"a": 2}]}}}), ['{"a":1}']),  # in the page's order, not by name
        (state({"a": {"events": {"events": {"a": 1}}}, "b": {"events": []}, "c": 3, "d": {"events": {"events": []}}}), []),
        (state({"a": {"events": {}}}), None),
        (state([{"events": {"events": [1]}}]), None),
        (state({"a": {"events": {"events": [1]}}}, "another"), None),
        ('{"appsWarmupData": ', None),
        ("", None),
        (None, None),
    ],
)
def test_embedded_events(spark, text, want):
    found = first(spark, payloads.embedded_events(F.lit(text).cast("string")).cast("array<string>"))
    assert found == want


@pytest.mark.parametrize(
    ("start", "zone", "want"),
    [
        ("2026-07-17T17:00:00.000Z", "Europe/Berlin", ("2026-07-17", "19:00:00")),
        ("2026-01-17T23:30:00Z", None, ("2026-01-18", "00:30:00")),
        ("2026-07-17T17:00:00Z", "America/New_York", ("2026-07-17", "13:00:00")),
        ("2026-07-17T17:00:00+02:00", "UTC", ("2026-07-17", "15:00:00")),
        ("1969-07-17T17:00:00.5Z", "Mars/Base", ("1969-07-17", "18:00:00")),
        ("2026-07-17T17:00Z", "UTC", (None, None)),
        ("2026-07-17", "UTC", (None, None)),
        ("2026-13-17T17:00:00Z", "UTC", (None, None)),
        ("soon", "UTC", (None, None)),
        (None, "UTC", (None, None)),
    ],
)
def test_schedules(spark, start, zone, want):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "Asia/Tokyo"):  # no session zone has a say
            spark.conf.set("spark.sql.session.timeZone", session)
            event = F.try_parse_json(F.lit(json.dumps({"scheduling": {"config": {"startDate": start, "timeZoneId": zone}}})))
            day, time = (first(spark, x) for x in payloads.schedule(event))
            assert (day and str(day), time) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_fields_of_events(spark):
    cases = {'{"status": 3}': "CANCELLED", '{"status": "3"}': "CANCELLED", '{"status": 4}': "SCHEDULED", "{}": "SCHEDULED", '{"status": null}': "SCHEDULED", '{"status": {"a": 3}}': "SCHEDULED"}
    for text, want in cases.items():
        assert first(spark, payloads.embedded_status(F.try_parse_json(F.lit(text)))) == want
    for kind, sold, want in ((2, True, True), (2, False, False), (3, True, False), (None, True, False)):
        text = json.dumps({"registration": {"type": kind, "ticketing": {"soldOut": sold}}})
        assert first(spark, payloads.embedded_sold_out(F.try_parse_json(F.lit(text)))) is want
    texts = {'{"a": " x\\n"}': "x", '{"a": " "}': None, '{"a": null}': None, "{}": None, '{"a": 1.5}': "1.5", '{"a": true}': "true", '{"a": {"b": 1}}': None, '{"a": [1]}': None, "[1]": None}
    for text, want in texts.items():
        assert first(spark, payloads.text_at(F.try_parse_json(F.lit(text)), "$.a")) == want


@pytest.mark.parametrize(
    ("base", "address", "want"),
    [
        ("https://v.example/a/b?q=1#f", "https://o.example/x", "https://o.example/x"),
        ("https://v.example/a/b?q=1#f", "/e/1", "https://v.example/e/1"),
        ("https://v.example/a/b?q=1#f", "e/1", "https://v.example/a/e/1"),
        ("https://v.example/a/b?q=1#f", "//cdn.example/i", "https://cdn.example/i"),
        ("https://v.example/a/b?q=1", "?p=2", "https://v.example/a/b?p=2"),
        ("https://v.example/a/b?q=1#f", "#g", "https://v.example/a/b?q=1#g"),
        ("https://v.example", "e", "https://v.example/e"),
    ],
)
def test_addresses(spark, base, address, want):
    assert first(spark, payloads.resolved(F.lit(base), F.lit(address))) == want


def test_what_cannot_be_read_is_a_row(spark):
    registry = Registry(
        Source("list", "elements", "li", {"title": ("b", "text"), "source_id": ("", "@id")}, {"event_date": lambda get: F.lit("2026-01-02").cast("date")}),
        Source("state", "warmup", "", {"title": "$.t"}),
        Source("api", "api", "items", {"title": "$.t"}),
        Source("kit", "script", "events", {"title": "$.t"}),
    )
    rows = [("list", "a", "<li id=1><b>A</b><li id=2>"), ("list", "b", ""), ("list", "c", None), ("gone", "d", "x"), (None, "e", "x"), ("state", "f", "<p>"), ("state", "g", "<script id=wix-warmup-data>{}</script>"),
            ("api", "h", "{"), ("api", "i", '{"items": {}}'), ("api", "j", '{"items": [1, null, {"t": "T"}]}'), ("kit", "k", "<script>f({events: [g]})</script>"), ("kit", "l", "<script>1</script>"), ("api", "m", '{"items": [NaN]}')]
    found = registry.staged(spark.createDataFrame(rows, PAGES))
    assert found.columns == ["source", "url", "pos", *STAGED, "error"] and [f.dataType.simpleString() for f in found.schema][3:-1] == list(STAGED.values())
    got = {(r.url, r.pos): (r.title, r.error) for r in found.collect()}
    assert got.pop(("h", 0))[1] and got.pop(("k", 0))[1].startswith("no value")
    assert got == {
        ("a", 1): ("A", None), ("a", 2): (None, "no title"), ("c", 0): (None, "no page"), ("d", 0): (None, "unknown source"), ("e", 0): (None, "unknown source"), ("f", 0): (None, "no embedded state"),
        ("g", 0): (None, "no list of events in the embedded state"), ("i", 0): (None, "no list at items"), ("j", 1): (None, "no title"), ("j", 2): (None, "no title"), ("j", 3): ("T", "no event_date"),
        ("l", 0): (None, "no script has a list events"), ("m", 1): (None, "no JSON"),
    }
    assert registry.staged(spark.createDataFrame([], PAGES)).count() == 0


def test_wrong_declarations():
    for wrong in (lambda: Source("a", "xml", "", {}), lambda: Source("a", "elements", "li >", {}), lambda: Source("a", "elements", "", {"t": "$.t"}), lambda: Source("a", "api", "", {"t": ("b", "text")}), lambda: Source("a", "api", "", {}, {"nothing": lambda get: get("url")}), lambda: Registry(*[Source("a", "api", "", {})] * 2)):
        with pytest.raises(ValueError):
            wrong()


def test_requests_for_unknown_events_fail(spark):
    columns = {c: F.lit(None).cast("string") for c in records.ASKED} | {"event_date": F.lit("2026-01-02").cast("date"), "venue_slug": F.lit("v"), "title": F.lit("Ärger"), "event_type": F.lit("OTHER"), "status": F.lit("SCHEDULED"), "price_presale": F.lit(1), "price_box_office": F.lit(2)}
    asked = spark.range(2).select(F.when(F.col("id") == 1, F.lit(5)).cast("long").alias("id"), *[v.alias(k) for k, v in columns.items()])
    known = spark.createDataFrame([(5, 9, None)], "id long, event_source_id long, created_at timestamp")
    got = {r.id: (r.slug, r.event_source_id, str(r.price_presale)) for r in records.requested(asked, known).collect()}
    assert got == {5: ("2026-01-02-v-arger", 9, "1.00"), None: ("2026-01-02-v-arger", None, "1.00")}
    with pytest.raises(Exception, match="no event 5"):
        records.requested(asked, known.limit(0)).collect()
