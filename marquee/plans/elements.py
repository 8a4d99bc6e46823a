"""Queries of pages made from the tables: list pages, object literals in scripts, JSON-LD, embedded states,
and all of these as registered sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import classify, payloads, records
from marquee.plans.registry import query
from marquee.sources import elements, pages
from marquee.sources.registry import Registry, Source
from marquee.sources.tables import Listings


def _cards(spark, sf_dir):
    """A page per order, a card per line of it in the order of their numbers."""
    lines = Listings(spark, sf_dir).raw("lineitem")

    def card(line):
        n, part, supplier = line["n"], line["l_partkey"].cast("string"), line["l_suppkey"].cast("string")
        return F.concat(
            F.lit('<div class="card x"><h2> Show  <b>'), part, F.lit("</b> &amp; more</h2><a class=t href="),
            F.when(n % 2 == 0, F.concat(F.lit('"https://tickets.example/'), supplier, F.lit('"'))).otherwise(F.lit('"/local"')), F.lit(">buy</a><p class=sub>Support: A"),
            supplier, F.lit("<br> <br/>ABGESAGT "), line["l_returnflag"], F.lit('</p><span class="flag'), F.when(n % 3 == 0, "").otherwise(" w-condition-invisible"), F.lit('">Sold-Out</span></div>'),
        )

    # cards are written where their page is: only what they are made of moves
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_returnflag")))
    # by number, so that adaptive execution does not put small partitions together: what follows takes time, not space
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = lines.repartition(n_tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("page_id")).agg(sorted_.alias("lines"))
    body = F.array_join(F.transform("lines", card), "\n")
    return found.select("page_id", F.concat(F.lit('<html><div class=card-list><h2>List</h2>'), body, F.lit("</div></html>")).alias("html"))


@query("cards_of_pages", """SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)::INT AS pos, 'Show ' || l_partkey || ' & more' AS title,
    CASE WHEN l_linenumber % 2 = 0 THEN 'https://tickets.example/' || l_suppkey END AS ticket_url, 'Support: A' || l_suppkey || chr(10) || 'ABGESAGT ' || l_returnflag AS lines, CASE WHEN l_linenumber % 3 = 0 THEN 'true' ELSE 'false' END AS sold_out FROM lineitem""")
def cards_of_pages(spark, sf_dir):
    """Rows of list pages: first text, absolute address, lines, and a flag that is not hidden."""
    fields = {"title": ("h2", "text"), "ticket_url": ("a.t", "href"), "lines": ("p.sub", "lines"), "sold_out": (".flag", "shown:sold-out")}
    return elements.picked(_cards(spark, sf_dir), "div.card", fields)


@query("script_members", "SELECT event_id AS page_id, 1 AS pos, event_type AS name, '}' || user_id::VARCHAR || '{' AS note FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 2, 'next', NULL FROM events WHERE event_id % 3 <> 0")
def script_members(spark, sf_dir):
    """The list in a script's object literal, whose strings hold braces; a page of three has none."""
    k = F.col("event_id")
    script = F.concat(F.lit('<script>let x = {a: 1};</script><script>start({node: {kind: "data", events: [{name: "'), F.col("event_type"), F.lit('", note: "}'), F.col("user_id").cast("string"), F.lit('{"}, {name: "next"}], n: {m: 2}}, end: 1});</script>'))
    made = Listings(spark, sf_dir).raw("events").select(k.alias("page_id"), F.when(k % 3 != 0, script).otherwise("<script>events()</script>").alias("html"))
    found = elements.members(made, "events").filter("error IS NULL")
    return found.select("page_id", "pos", F.get_json_object("member", "$.name").alias("name"), F.get_json_object("member", "$.note").alias("note"))


@query("json_ld_of_pages", "SELECT o_orderkey AS page_id, 'Night ' || o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start FROM orders WHERE o_orderkey % 4 <> 3")
def json_ld_of_pages(spark, sf_dir):
    """Events of JSON-LD blocks, inside a graph or not; broken blocks and other types have none."""
    k = F.col("o_orderkey")
    event = F.to_json(F.struct(F.lit("MusicEvent").alias("@type"), F.concat(F.lit("Night "), F.col("o_custkey").cast("string")).alias("name"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("startDate")))
    block = F.when(k % 4 == 3, '{"@type": "Event", ').when(k % 4 == 2, F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, '), event, F.lit("]}"))).otherwise(event)
    html = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    made = Listings(spark, sf_dir).raw("orders").select(k.alias("page_id"), html.alias("html"))
    found = pages.json_ld_rows(made)
    return found.select("page_id", F.get_json_object("object", "$.name").alias("name"), F.get_json_object("object", "$.startDate").alias("start"))


def _of(name):
    return lambda get: get(name)


#: Sources of different kinds: a list page, JSON-LD, the state that a page builder embeds, a script's object
#: literal and an API.
SOURCES = Registry(
    Source(
        "hall", "elements", ".prog-row:has(> .prog-date):not(.gone)", {"title": ("h3 > a, h4 > a", "text"), "day": (".prog-date", "text"), "ticket_url": ("a[href^=http][href*='/shop/']", "href"), "key": ("", "@data-id"), "lines": ("p.sub + p", "lines")},
        {"event_date": lambda get: classify.german_date(get("day")), "source_id": lambda get: F.concat(F.lit("hall:"), get("key")), "subtitle": lambda get: F.get(F.split(get("lines"), "\n"), F.lit(1)), "source_url": _of("url"), "event_type": lambda get: records.concert_type(get("title"))},
    ),
    Source(
        "club", "json_ld", "Event", {"title": "$.name", "start": "$.startDate", "url_": "$.url", "state": "$.eventStatus", "price_presale": "$.offers[0].price"},
        {"event_date": lambda get: records.iso_date(get("start")), "start_time": lambda get: records.iso_time(get("start")), "source_url": lambda get: payloads.resolved(get("url"), get("url_")), "source_id": lambda get: F.concat(F.lit("club:"), classify.url_slug(payloads.resolved(get("url"), get("url_")))), "status": lambda get: classify.status_of_schema(get("state"))},
    ),
    Source(
        "loft", "warmup", "", {"title": "$.title", "slug": "$.slug", "image_url": "$.mainImage.url"},
        {"event_date": lambda get: payloads.schedule(get(""))[0], "start_time": lambda get: payloads.schedule(get(""))[1], "source_id": lambda get: F.concat(F.lit("loft:"), get("slug")), "status": lambda get: payloads.embedded_status(get("")), "sold_out": lambda get: payloads.embedded_sold_out(get("")), "event_type": lambda get: F.lit("CONCERT")},
    ),
    Source(
        "kit", "script", "events", {"title": "$.title", "start": "$.start", "key": "$.id", "code": "$.eventStatus"},
        {"event_date": lambda get: records.real_date(get("start")), "source_id": lambda get: F.concat(F.lit("kit:"), get("key")), "genre": lambda get: F.array_join(payloads.texts_at(get(""), "$.genres"), ", "), "status": lambda get: F.when(F.lower(get("code")) == "r", "RELOCATED").when(F.lower(get("code")) == "p", "POSTPONED").otherwise("SCHEDULED")},
    ),
    Source("desk", "api", "data.items", {"title": "$.t", "day": "$.d", "source_id": "$.id", "free": "$.free"}, {"event_date": lambda get: records.iso_date(get("day")), "free": lambda get: get("free").try_cast("boolean")}),
)


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _source_pages(spark, sf_dir):
    """A page per order, of one of seven sources by its number; two of them are not known."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    hall = _text('<ul><li class="prog-row" data-id="', k, '"><span class=prog-date>', F.date_format("o_orderdate", "d.M.yyyy"), "</span><h4><a href=/x>Party ", F.col("o_custkey"), "</a></h4><p class=sub>a<p>one<br>Two ", F.col("o_orderstatus"), '</p><a href="/shop/1">no</a><a href="https://t.example/shop/', k, '">buy</a>',
                 '<li class="prog-row gone"><span class=prog-date>1.1.2000</span><h3><a>no</a></h3><li class=prog-row><b><span class=prog-date>2.2.2000</span></b><h3><a>no</a></h3></ul>')
    club = _text('<script type="application/ld+json">{"@graph": {"@type": "MusicEvent", "name": "A &amp; ', F.col("o_custkey"), '", "startDate": "', day, 'T20:30", "url": "/e/', k, '/", "eventStatus": "https://schema.org/EventPostponed", "offers": [{"price": "12.5"}]}}</script>')
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    event = _text('{"title": " Night ', F.col("o_custkey"), '", "slug": "n-', k, '", "status": ', k % 4, ', "mainImage": {"url": ', F.when(k % 2 == 0, '"https://i.example/1"').otherwise("null"), '}, "scheduling": {"config": {"startDate": "', day, "T", hour, ':15:00.000Z", "timeZoneId": "', F.when(k % 3 == 0, "America/New_York").otherwise("Nowhere/Land"), '"}}, "registration": {"type": ', k % 3 + 1, ', "ticketing": {"soldOut": true}}}')
    loft = _text('<script id="wix-warmup-data" type="application/json">{"appsWarmupData": {"', payloads.EVENTS_APP, '": {"z": {"events": {"events": {}}}, "w": {"events": {"events": [', event, ']}}, "a": {"events": {"events": []}}}, "other": {"w": {"events": {"events": [1, 2]}}}}}</script>')
    kit = _text("<script>var a = {b: 1}; // events: [\nstart({data: {c: {d: '}'}, events: [{id: ", k, ", title: 'It\\'s ", F.col("o_custkey"), "', start: \"", day, " 19:00:00.000Z\", genres: [' Rock ', null, \"\", 'Pop',], eventStatus: ", F.when(k % 2 == 0, "'R'").otherwise("undefined"), ",}, {id: 'x', title: null}]}});</script>")
    desk = _text('{"data": {"items": [{"t": "D', F.col("o_custkey"), '", "d": "', day, '", "id": "desk:', k, '", "free": ', F.when(k % 2 == 0, "true").otherwise("null"), "}]}}")
    broken = F.when(k % 11 == 0, _text("<script>f({events: [g()]})</script>")).otherwise(kit)
    name = F.get(F.array(*map(F.lit, ("hall", "club", "loft", "kit", "desk", "nowhere", None))), (k % 7).cast("int"))
    page = F.when(k % 7 == 0, hall).when(k % 7 == 1, club).when(k % 7 == 2, loft).when(k % 7 == 3, broken).otherwise(desk)
    return Listings(spark, sf_dir).raw("orders").select(name.alias("source"), _text("https://v.example/p/", k, "?q=1").alias("url"), page.alias("page"))


_LOCAL = "timezone(CASE WHEN k % 3 = 0 THEN 'America/New_York' ELSE 'Europe/Berlin' END, timezone('UTC', d::TIMESTAMP + to_hours(k % 24) + to_minutes(15)))"
_DAYS = "CASE k % 7 WHEN 2 THEN local::DATE ELSE d END"


@query("staged_of_sources", f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d, o_orderstatus AS s FROM orders), l AS (SELECT *, {_LOCAL} AS local FROM o),
    made AS (SELECT ['hall', 'club', 'loft', 'kit', 'desk', 'nowhere', NULL][k % 7 + 1] AS source, 'https://v.example/p/' || k || '?q=1' AS url, k % 7 = 3 AND k % 11 = 0 AS broken, * FROM l)
    SELECT source, url, CASE WHEN k % 7 >= 5 OR broken THEN 0 ELSE 1 END::INT AS pos, CASE WHEN NOT broken THEN CASE k % 7 WHEN 0 THEN 'Party ' || c WHEN 1 THEN 'A &amp; ' || c WHEN 2 THEN 'Night ' || c WHEN 3 THEN 'It''s ' || c WHEN 4 THEN 'D' || c END END AS title,
    CASE WHEN k % 7 = 0 THEN 'Two ' || s END AS subtitle, CASE k % 7 WHEN 0 THEN 'PARTY' WHEN 2 THEN 'CONCERT' END AS event_type, CASE WHEN k % 7 < 5 AND NOT broken THEN {_DAYS} END AS event_date,
    CASE k % 7 WHEN 1 THEN '20:30:00' WHEN 2 THEN strftime(local, '%H:%M:%S') END AS start_time, CASE WHEN k % 7 = 2 AND k % 2 = 0 THEN 'https://i.example/1' END AS image_url,
    CASE k % 7 WHEN 0 THEN 'https://v.example/p/' || k || '?q=1' WHEN 1 THEN 'https://v.example/e/' || k || '/' END AS source_url, CASE WHEN k % 7 < 5 AND NOT broken THEN source || ':' || CASE WHEN k % 7 = 2 THEN 'n-' ELSE '' END || k END AS source_id,
    CASE WHEN k % 7 = 0 THEN 'https://t.example/shop/' || k END AS ticket_url, CASE WHEN k % 7 = 3 AND NOT broken THEN 'Rock, Pop' END AS genre, CASE WHEN k % 7 = 1 THEN 12.5 END::DECIMAL(10,2) AS price_presale, CASE WHEN k % 7 = 2 THEN k % 3 + 1 = 2 END AS sold_out, CASE WHEN k % 7 = 4 AND k % 2 = 0 THEN true END AS free,
    CASE WHEN broken THEN NULL ELSE CASE k % 7 WHEN 1 THEN 'POSTPONED' WHEN 2 THEN CASE WHEN k % 4 = 3 THEN 'CANCELLED' ELSE 'SCHEDULED' END WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'RELOCATED' ELSE 'SCHEDULED' END END END AS status, CASE WHEN k % 7 >= 5 THEN 'unknown source' WHEN broken THEN 'unreadable' END AS error FROM made
    UNION ALL SELECT source, url, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'kit:x', NULL, '', NULL, NULL, NULL, 'SCHEDULED', 'no title' FROM made WHERE k % 7 = 3 AND NOT broken""")
def staged_of_sources(spark, sf_dir):
    """Pages of five sources and two unknown ones through one plan."""
    found = SOURCES.staged(_source_pages(spark, sf_dir))
    error = F.when(F.col("error").startswith("no value at"), "unreadable").otherwise(F.col("error"))
    return found.select(*[c for c in found.columns if c not in ("error", "description", "doors_time", "price_box_office", "price_note")], error.alias("error"))


@query("variant_fields", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'value' WHEN 1 THEN 'null' WHEN 2 THEN 'missing' WHEN 3 THEN 'value' ELSE 'missing' END AS presence,
    CASE event_id % 5 WHEN 0 THEN event_type END AS name, CASE WHEN event_id % 5 = 3 THEN event_type || '|' || user_id ELSE '' END AS names, event_id % 5 = 4 AS lost FROM events""")
def variant_fields(spark, sf_dir):
    """Records that have a value, a null, nothing or a list at a path, and what is no JSON."""
    k = F.col("event_id")
    name = F.to_json(F.struct(_text(" ", F.col("event_type"), " ").alias("n")))
    record = F.when(k % 5 == 0, name).when(k % 5 == 1, '{"n": null}').when(k % 5 == 2, '{"m": {"n": 1}}').when(k % 5 == 3, _text('{"n": ["', F.col("event_type"), ' ", null, " ", ', F.col("user_id"), "]}")).otherwise("{n")
    rows = Listings(spark, sf_dir).raw("events").select("event_id", F.try_parse_json(record).alias("r"))
    r = F.col("r")
    return rows.select("event_id", payloads.presence(r, "$.n").alias("presence"), payloads.text_at(r, "$.n").alias("name"), F.array_join(payloads.texts_at(r, "$.n"), "|").alias("names"), r.isNull().alias("lost"))


_STARTS = "timezone(CASE event_id % 3 WHEN 0 THEN 'Europe/London' WHEN 1 THEN 'America/New_York' ELSE 'Europe/Berlin' END, timezone('UTC', date_trunc('second', ts::TIMESTAMP)))"


@query("warmup_events", f"""SELECT 'w' || event_id AS id, CASE event_id % 4 WHEN 3 THEN 'CANCELLED' ELSE 'SCHEDULED' END AS status, event_type AS title, CASE WHEN event_id % 5 <> 4 THEN local::DATE END AS day, CASE WHEN event_id % 5 <> 4 THEN strftime(local, '%H:%M:%S') END AS time,
    event_id % 3 = 1 AS sold_out, CASE event_id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'null' ELSE 'missing' END AS slug FROM (SELECT *, {_STARTS} AS local FROM events WHERE event_id % 7 < 5)""")
def warmup_events(spark, sf_dir):
    """Events of the JSON that a page builder embeds: of its events application's widgets the first, in the page's order,
    that has a list; schedules on the clock of their zones. Pages without the application, or with broken JSON, have
    none."""
    k, at = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(k % 3 == 0, '"Europe/London"').when(k % 3 == 1, '"America/New_York"').otherwise("null")
    slug = F.when(k % 3 == 0, '"slug": "s", ').when(k % 3 == 1, '"slug": null, ').otherwise("")
    start = F.when(k % 5 == 4, '"scheduleTbd": true').otherwise(_text('"startDate": "', at, '.000Z"'))
    item = _text('{"id": "w', k, '", "title": " ', F.col("event_type"), ' ", ', slug, '"status": ', k % 4, ', "scheduling": {"config": {', start, ', "timeZoneId": ', zone, '}}, "registration": {"type": ', F.when(k % 3 == 1, "2").otherwise("3"), ', "ticketing": {"soldOut": true}}}')
    app = F.when(k % 7 == 5, "another").otherwise(payloads.EVENTS_APP)
    state = _text('{"platform": {"events": [1]}, "appsWarmupData": {"', app, '": {"z": {"other": 1}, "widget": {"events": {"events": [', item, ']}}, "a": {"events": {"events": [{"id": "no"}]}}}}', F.when(k % 7 == 6, "").otherwise("}"))
    made = Listings(spark, sf_dir).raw("events").select(k.alias("page_id"), _text('<html><script>var a;</script><script type="application/json" id="wix-warmup-data">', state, "</script></html>").alias("html"))
    states = elements.picked(made, payloads.WARMUP_SCRIPT, {"state": ("", "data")})
    e = F.col("e")
    rows = states.select(F.explode(payloads.embedded_events(F.col("state"))).alias("e"))
    day, time = payloads.schedule(e)
    return rows.select(payloads.text_at(e, "$.id").alias("id"), payloads.embedded_status(e).alias("status"), payloads.text_at(e, "$.title").alias("title"), day.alias("day"), time.alias("time"), payloads.embedded_sold_out(e).alias("sold_out"), payloads.presence(e, "$.slug").alias("slug"))
