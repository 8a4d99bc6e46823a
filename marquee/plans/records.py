"""Queries of scraped records: their fields, the rows they become, joins, headings and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import records
from marquee.plans.registry import query
from marquee.sources.tables import Listings, over_model

#: Titles as pages write them; every rule meets one that it changes and one that it leaves.
TITLES = (
    "-verlegt in den Frannz Club – CULTURE WARS", "Verlegt ins Bi Nuu – BRKN", "Iggi Kelly Nachholtermin vom 28.04.26-", "Luna Simao (verschoben aus 2026)", "Mitsing-Event (ausverkauft)",
    "Adventurous\u00a0 Juan  (DJ-Set)", "HOME\u200bCOMING", "The Adicts -", "Pub Quiz", "Summer Festival (abgesagt)", "Aftershow Party", "Konzert - Eintritt frei", "Lesung: Nacht", " - ",
    "Luna - (verschoben aus 2026)", "Foo - (ausverkauft)", "Ärzte – Øya, Straße", "Ein ausverkauftes Haus",
)
_ARRAY = "[" + ", ".join("'{}'".format(t.replace("'", "''")) for t in TITLES) + "]"
_CHARS = "[\\x{200B}-\\x{200D}\\x{FEFF}]", "[\\s\\x{00A0}\\x{202F}]+"
_PLAIN = "regexp_replace(trim(regexp_replace({0}, '%s', '', 'g')), '%s', ' ', 'g')" % _CHARS
_MOVED = f"coalesce(nullif(trim(regexp_replace(title, '{records.MOVED_BEFORE}', '')), ''), trim(title))"


def _clean(x: str) -> str:
    plain = _PLAIN.replace("{0}", x)
    return f"coalesce(nullif(trim(regexp_replace({plain}, '{records.NOTES_BEHIND}', '', 'g')), ''), {plain})"


_TYPE = """CASE WHEN lower(title) LIKE '%quiz%' THEN 'QUIZ' WHEN regexp_matches(lower(title), 'wrestling|burlesque|circus') THEN 'SHOW'
    WHEN regexp_matches(lower(title), 'public viewing|screening|world cup|\\bkino\\b') THEN 'SCREENING' WHEN regexp_matches(lower(title), 'lesung|lesedüne|\\bslam\\b') THEN 'READING'
    WHEN regexp_matches(lower(title), 'ausstellung|exhibition|vernissage') THEN 'EXHIBITION' WHEN lower(title) LIKE '%markt%' THEN 'OTHER' WHEN regexp_matches(lower(title), 'party|club ?night|karaoke|\\brave\\b') THEN 'PARTY' END"""
_RAW = f", raw AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, {_ARRAY}[o_orderkey % {len(TITLES)} + 1] AS title, [NULL, 'OTHER', 'CONCERT', 'PARTY'][o_orderkey % 4 + 1] AS kind FROM orders)"


def _raw(spark, sf_dir):
    id_ = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, (None, "OTHER", "CONCERT", "PARTY")))
    return Listings(spark, sf_dir).raw("orders").select(id_.alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.get(F.array(*map(F.lit, TITLES)), (id_ % len(TITLES)).cast("int")).alias("title"), F.get(kinds, (id_ % 4).cast("int")).alias("kind"))


@query("clean_title", over_model(f"{_RAW} SELECT id, {_MOVED} AS unmoved, {_clean('title')} AS clean FROM raw"))
def clean_title(spark, sf_dir):
    t = F.col("title")
    return _raw(spark, sf_dir).select("id", records.without_move(t).alias("unmoved"), records.clean_title(t).alias("clean"))


@query("infer_type", over_model(f"{_RAW}, k AS (SELECT *, {_TYPE} AS told FROM raw) SELECT id, coalesce(told, 'CONCERT') AS concert, coalesce(told, 'OTHER') AS unmarked, CASE WHEN kind IS NULL THEN coalesce(told, 'CONCERT') WHEN kind = 'OTHER' THEN coalesce(told, 'OTHER') ELSE kind END AS refined FROM k"))
def infer_type(spark, sf_dir):
    t = F.col("title")
    return _raw(spark, sf_dir).select("id", records.concert_type(t).alias("concert"), records.unmarked_type(t).alias("unmarked"), records.refined_type(F.col("kind"), t).alias("refined"))


_TIMES = "lpad((o_orderkey % 30)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 70)::VARCHAR, 2, '0')"
_STAMP = f"CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN o_orderdate::DATE::VARCHAR || 'T' || {_TIMES} WHEN 2 THEN 'soon' ELSE o_orderdate::DATE::VARCHAR || 'T' || {_TIMES} || ':00Z' END"
_REAL = f"' ' || o_orderdate::DATE::VARCHAR || ' ' || {_TIMES} || ':00 +0200'"


def _stamps(spark, sf_dir):
    id_, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.concat(F.lpad((id_ % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((id_ % 70).cast("string"), 2, "0"))
    stamp = F.when(id_ % 4 == 0, day).when(id_ % 4 == 1, F.concat(day, F.lit("T"), time)).when(id_ % 4 == 2, "soon").otherwise(F.concat(day, F.lit("T"), time, F.lit(":00Z")))
    return Listings(spark, sf_dir).raw("orders").select(id_.alias("id"), stamp.alias("stamp"), F.concat(F.lit(" "), time, F.lit(" ")).alias("time"), F.concat(F.lit(" "), day, F.lit(" "), time, F.lit(":00 +0200")).alias("real"))


def _sql_time(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN trim({x}) || ':00' END"


def _sql_day(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_strptime({x}, '%Y-%m-%d')::DATE END"


@query("parse_times", over_model(f""", s AS (SELECT o_orderkey AS id, {_STAMP} AS stamp, ' ' || {_TIMES} || ' ' AS time, {_REAL} AS real FROM orders)
    SELECT id, {_sql_time('time')} AS time, {_sql_day("split_part(stamp, 'T', 1)")} AS iso_day, {_sql_time("CASE WHEN contains(stamp, 'T') THEN substr(stamp, instr(stamp, 'T') + 1) ELSE '' END")} AS iso_time, {_sql_day("split_part(trim(real), ' ', 1)")} AS real_day FROM s"""))
def parse_times(spark, sf_dir):
    return _stamps(spark, sf_dir).select("id", records.time_of(F.col("time")).alias("time"), records.iso_date(F.col("stamp")).alias("iso_day"), records.iso_time(F.col("stamp")).alias("iso_time"), records.real_date(F.col("real")).alias("real_day"))


@query("doors_before_start", over_model("""SELECT id, CASE WHEN start_time IS NOT NULL AND doors IS NOT NULL THEN least(doors, start_time) ELSE doors END AS doors, CASE WHEN start_time IS NOT NULL AND doors IS NOT NULL THEN greatest(doors, start_time) ELSE start_time END AS start
    FROM (SELECT id, start_time, CASE WHEN id % 8 <> 0 THEN (id % 9 + 15)::VARCHAR || ':15:00' END AS doors FROM event)"""))
def doors_before_start(spark, sf_dir):
    events = Listings(spark, sf_dir).event
    doors, start = records.in_order(F.when(F.col("id") % 8 != 0, F.concat((F.col("id") % 9 + 15).cast("string"), F.lit(":15:00"))), F.col("start_time"))
    return events.select("id", doors.alias("doors"), start.alias("start"))


ZONES = ("Europe/Berlin", "Europe/London", "America/New_York", "UTC")


@query("local_times", """SELECT event_id, local::DATE AS day, strftime(local, '%H:%M') AS time FROM (SELECT event_id, timezone(CASE event_id % 5 WHEN 0 THEN 'Europe/London' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'UTC' ELSE 'Europe/Berlin' END, timezone('UTC', ts::TIMESTAMP)) AS local FROM events)""")
def local_times(spark, sf_dir):
    names = F.array(*map(F.lit, ("Europe/London", "America/New_York", "UTC", "Mars/Base", None)))
    events = Listings(spark, sf_dir).raw("events")
    local = records.local_time(F.col("ts").cast("timestamp"), F.get(names, (F.col("event_id") % 5).cast("int")), ZONES)
    return events.select("event_id", local.cast("date").alias("day"), F.date_format(local, "HH:mm").alias("time"))


@query("berlin_days", """SELECT event_id, d AS today, d + INTERVAL 1 DAY AS tomorrow FROM (SELECT event_id, timezone('Europe/Berlin', timezone('UTC', ts::TIMESTAMP + to_days((event_id % 400)::INT)))::DATE AS d FROM events)""".replace("d + INTERVAL 1 DAY", "(d + INTERVAL 1 DAY)::DATE"))
def berlin_days(spark, sf_dir):
    """Today and tomorrow in Berlin at instants over a whole year, changes of the clock included."""
    at = F.timestamp_add("DAY", (F.col("event_id") % 400).cast("int"), F.col("ts"))
    today, tomorrow = records.days_of(at)
    return Listings(spark, sf_dir).raw("events").select("event_id", today.alias("today"), tomorrow.alias("tomorrow"))


@query("presale_and_box_office", over_model(r""", p AS (SELECT o_orderkey AS id, [struct_pack(label := CASE o_orderkey % 3 WHEN 0 THEN 'Abendkasse' WHEN 1 THEN 'VVK' ELSE 'AK inkl.' END, text := (o_orderkey % 40)::VARCHAR || ',50 €'),
    struct_pack(label := CASE o_orderkey % 2 WHEN 0 THEN 'VVK' ELSE NULL END, text := CASE o_orderkey % 5 WHEN 0 THEN 'tba' ELSE (o_orderkey % 30)::VARCHAR || '€' END), struct_pack(label := 'AK', text := '99.90 €')] AS ps FROM orders),
    q AS (SELECT id, i, regexp_matches(lower(coalesce(x.label, '')), 'abendkasse|\bak\b') AS box, replace(nullif(regexp_extract(x.text, '(\d+(?:[.,]\d{1,2})?)\s*€', 1), ''), ',', '.')::DECIMAL(10,2) AS amount FROM (SELECT id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM p))
    SELECT id, arg_min(amount, i) FILTER (WHERE NOT box AND amount IS NOT NULL) AS presale, arg_min(amount, i) FILTER (WHERE box AND amount IS NOT NULL) AS box_office FROM q GROUP BY id"""))
def presale_and_box_office(spark, sf_dir):
    k = F.col("o_orderkey")

    def one(label, text):
        return F.struct(label.alias("label"), text.alias("text"))

    labelled = F.array(
        one(F.when(k % 3 == 0, "Abendkasse").when(k % 3 == 1, "VVK").otherwise("AK inkl."), F.concat((k % 40).cast("string"), F.lit(",50 €"))),
        one(F.when(k % 2 == 0, "VVK"), F.when(k % 5 == 0, "tba").otherwise(F.concat((k % 30).cast("string"), F.lit("€")))),
        one(F.lit("AK"), F.lit("99.90 €")),
    )
    presale, box = records.prices(labelled)
    return Listings(spark, sf_dir).raw("orders").select(k.alias("id"), presale.alias("presale"), box.alias("box_office"))


_STATUS = "[429, 403, 404, 500, 301, NULL, NULL, NULL, NULL, NULL][event_id % 10 + 1]"
_ERROR = "['', '', '', '', '', 'unknown_host', 'timeout', 'io', 'index', 'memory'][event_id % 10 + 1]"


@query("scrape_failures", f"""WITH f AS (SELECT event_type AS source, {_STATUS} AS s, {_ERROR} AS e FROM events WHERE user_id % 4 = 2)
    SELECT source, CASE WHEN s = 429 THEN 'http_rate_limited' WHEN s = 403 THEN 'http_forbidden' WHEN s BETWEEN 400 AND 499 THEN 'http_4xx' WHEN s BETWEEN 500 AND 599 THEN 'http_5xx' WHEN s IS NOT NULL THEN 'http_other' WHEN e = 'unknown_host' THEN 'dns'
    WHEN e = 'timeout' THEN 'timeout' WHEN e = 'io' THEN 'network' WHEN e IN ('state', 'argument', 'null', 'index') THEN 'parse' ELSE 'other' END AS reason, count(*) AS n FROM f GROUP BY 1, 2""")
def scrape_failures(spark, sf_dir):
    k = (F.col("event_id") % 10).cast("int")
    status = F.get(F.array(*[F.lit(x).cast("int") for x in (429, 403, 404, 500, 301, None, None, None, None, None)]), k)
    error = F.get(F.array(*map(F.lit, ("", "", "", "", "", "unknown_host", "timeout", "io", "index", "memory"))), k)
    runs = Listings(spark, sf_dir).raw("events").filter(F.col("user_id") % 4 == 2)
    return runs.groupBy(F.col("event_type").alias("source"), records.failure_reason(status, error).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("served_per_endpoint", "SELECT endpoint, count(event_id) AS n FROM (SELECT DISTINCT event_type AS endpoint FROM events UNION ALL SELECT 'calendar') LEFT JOIN events ON event_type = endpoint GROUP BY 1")
def served_per_endpoint(spark, sf_dir):
    """Counts by endpoint, of one that was never asked too."""
    events = Listings(spark, sf_dir).raw("events")
    known = events.select(F.col("event_type").alias("endpoint")).distinct().union(spark.createDataFrame([("calendar",)], "endpoint string"))
    served = events.groupBy(F.col("event_type").alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(served, "endpoint", "left").select("endpoint", F.coalesce("n", F.lit(0)).alias("n"))


@query("flag_sources", over_model("SELECT slug, enabled AND id IN (SELECT event_source_id FROM event WHERE status = 'CANCELLED' AND event_source_id % 3 = 0) AS flagged FROM event_source"))
def flag_sources(spark, sf_dir):
    """Flags set where there is a finding, and cleared elsewhere."""
    t = Listings(spark, sf_dir)
    found = t.event.filter("status = 'CANCELLED' AND event_source_id % 3 = 0").select(F.col("event_source_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return t.event_source.join(found, "id", "left").select("slug", (F.col("enabled") & F.coalesce("hit", F.lit(False))).alias("flagged"))


@query("carried_years", "SELECT page, line, year FROM (SELECT l_orderkey AS page, l_linenumber AS line, l_linenumber % 3 = 2 AS heading, last_value(CASE WHEN l_linenumber % 3 = 2 THEN year(l_shipdate) END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS year FROM lineitem) WHERE NOT heading")
def carried_years(spark, sf_dir):
    rows = Listings(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_shipdate")
    return records.carried(rows, "page", ["line", "l_partkey", "l_suppkey", "l_shipdate"], F.col("line") % 3 == 2, F.year("l_shipdate"), "year").select("page", "line", "year")


@query("rows_below_headings", "SELECT page, heading, count(*) AS n FROM (SELECT l_orderkey AS page, l_linenumber % 3 = 2 AS is_heading, max(CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS heading FROM lineitem) WHERE NOT is_heading AND heading IS NOT NULL GROUP BY 1, 2")
def rows_below_headings(spark, sf_dir):
    """How many rows stand between each heading and the next."""
    rows = Listings(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"))
    below = records.carried(rows, "page", ["line"], F.col("line") % 3 == 2, F.col("line"), "heading").filter("heading IS NOT NULL")
    return below.groupBy("page", "heading").agg(F.count(F.lit(1)).alias("n"))


@query("poster_urls", over_model("SELECT e.id, 'https://media.example/' || a.slug || '.jpg' AS poster FROM event e LEFT JOIN artist a ON a.id = e.id % 4000"))
def poster_urls(spark, sf_dir):
    """Events with the address of their media id, null where it names none."""
    t = Listings(spark, sf_dir)
    media = t.artist.select(F.col("id").alias("media_id"), F.concat(F.lit("https://media.example/"), "slug", F.lit(".jpg")).alias("poster"))
    return t.event.select("id", (F.col("id") % 4000).alias("media_id")).join(media, "media_id", "left").select("id", "poster")


@query("performance_records", over_model("SELECT a.l_orderkey AS event_id, a.l_linenumber AS line, a.l_partkey AS artist_id, b.l_suppkey AS promoter_id FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber % 2 = 0) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"))
def performance_records(spark, sf_dir):
    """Records of one table with those of another of the same event and performance."""
    lines = Listings(spark, sf_dir).raw("lineitem")
    one = lines.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("artist_id"))
    other = lines.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("promoter_id"))
    return one.join(other, ["event_id", "line"], "left")


@query("any_event", over_model("SELECT EXISTS (SELECT 1 FROM event) AS found, EXISTS (SELECT 1 FROM event WHERE status = 'LOST') AS lost"))
def any_event(spark, sf_dir):
    """Whether there is a row at all: one row is read, wherever the table's end is."""
    events = Listings(spark, sf_dir).event
    found, lost = (df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias(name)) for df, name in ((events, "found"), (events.filter("status = 'LOST'"), "lost")))
    return found.join(lost)


@query("date_presets", "SELECT o_orderkey AS id, d AS tonight, CASE WHEN isodow(d) < 5 THEN d + (5 - isodow(d))::INT ELSE d END AS weekend_from, d + (7 - isodow(d))::INT AS weekend_to, d + 6 AS week_to FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def date_presets(spark, sf_dir):
    rows = Listings(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("tonight"))
    first, last = records.weekend(F.col("tonight"))
    return rows.select("id", "tonight", first.alias("weekend_from"), last.alias("weekend_to"), F.date_add("tonight", 6).alias("week_to"))


_DISTRICTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in records.DISTRICTS.items()) + "}"
_SLUGS = [*records.DISTRICTS, "nowhere", None]


@query("labels", over_model(f"""SELECT e.id, coalesce(({_DISTRICTS})[d], d, '') AS district, upper(substr(w, 1, 1)) || substr(w, 2) AS kind, coalesce(t || ' @ ' || v.name, t, v.name, '') AS label, event_issue AS issue, e.source_id LIKE '%:%7' AND NOT e.source_id LIKE 'manual:%' AS sevens
    FROM (SELECT *, [{', '.join('NULL' if s is None else f"'{s}'" for s in _SLUGS)}][id % {len(_SLUGS)} + 1] AS d, lower(replace(event_type || '_NIGHT', '_', ' ')) AS w, CASE WHEN id % 3 <> 0 THEN title END AS t, ['missingStartTime', 'noPrice'][id % 2 + 1] AS event_issue FROM event) e LEFT JOIN venue v ON v.id = e.venue_id AND e.id % 5 <> 0"""))
def labels(spark, sf_dir):
    t = Listings(spark, sf_dir)
    venues = t.venue.select(F.col("id").alias("venue_id"), F.col("name").alias("venue"))
    id_ = F.col("id")
    slug = F.get(F.array(*map(F.lit, _SLUGS)), (id_ % len(_SLUGS)).cast("int"))
    issue = F.get(F.array(F.lit("MISSING_START_TIME"), F.lit("NO_PRICE")), (id_ % 2).cast("int"))
    return t.event.join(venues, "venue_id", "left").select(
        "id",
        records.district_label(slug).alias("district"),
        records.humanised(F.concat("event_type", F.lit("_NIGHT"))).alias("kind"),
        records.labelled(F.when(id_ % 3 != 0, F.col("title")), F.when(id_ % 5 != 0, F.col("venue"))).alias("label"),
        records.camel(issue).alias("issue"),
        (F.col("source_id").rlike(":.*7$") & ~F.col("source_id").startswith("manual:")).alias("sevens"),
    )


_LABEL = "['Konzert', 'Party', NULL, 'Sonstiges'][id % 4 + 1]"
_NEW = f"""{_RAW}, s AS (SELECT *, {_MOVED} AS unmoved, {_LABEL} AS label, CASE WHEN id % 8 <> 0 THEN lpad((id % 9 + 15)::VARCHAR, 2, '0') || ':15' END AS doors, CASE WHEN id % 7 <> 0 THEN (id % 6 + 18)::VARCHAR || ':30' END AS start, (id % 30)::DECIMAL(10,2) AS presale FROM raw),
    k AS (SELECT *, {_clean('unmoved')} AS clean, {_TYPE} AS told FROM s),
    m AS (SELECT *, CASE label WHEN 'Konzert' THEN 'CONCERT' WHEN 'Party' THEN 'PARTY' WHEN 'Sonstiges' THEN 'OTHER' END AS mapped FROM k),
    n AS (SELECT *, CASE WHEN mapped IS NULL THEN coalesce(told, 'CONCERT') WHEN mapped = 'OTHER' THEN coalesce(told, 'OTHER') ELSE mapped END AS refined FROM m),
    p AS (SELECT *, CASE WHEN doors IS NOT NULL AND start IS NOT NULL THEN least(doors, start) ELSE doors END || ':00' AS d, CASE WHEN doors IS NOT NULL AND start IS NOT NULL THEN greatest(doors, start) ELSE start END || ':00' AS st,
    trim(regexp_replace(lower(strip_accents(replace(replace(replace(day::VARCHAR || '-haus-' || id % 3 || '-' || clean, 'ß', 'ss'), 'ø', 'o'), 'Ø', 'O'))), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM n),
    made AS (SELECT CASE WHEN id % 4 = 0 THEN id END AS id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '1997-01-01' END AS created_at, 's:' || id::VARCHAR AS source_id, id % 3 AS venue_id, 7::BIGINT AS event_source_id, clean AS title,
    base || CASE WHEN count(*) OVER (PARTITION BY base) > 1 AND st IS NOT NULL THEN '-' || replace(substr(st, 1, 5), ':', '') ELSE '' END AS slug,
    CASE WHEN refined IN ('CONCERT', 'OTHER') AND regexp_matches(lower(clean), '\\b(festivaltickets?|festivals?)\\b') THEN 'FESTIVAL' ELSE refined END AS event_type,
    CASE WHEN title ILIKE '%abgesagt%' THEN 'CANCELLED' WHEN title ILIKE '%verschoben%' THEN 'POSTPONED' WHEN title ILIKE '%verlegt%' THEN 'RELOCATED' ELSE 'SCHEDULED' END AS status, day AS event_date, d AS doors_time, st AS start_time,
    NULL::VARCHAR AS subtitle, NULL::VARCHAR AS description, NULL::VARCHAR AS image_url, 'https://x.example/' || id AS source_url, NULL::VARCHAR AS ticket_url, NULL::VARCHAR AS genre, CASE WHEN id % 10 = 3 THEN 'Spende' END AS price_note,
    presale AS price_presale, CASE WHEN id % 3 = 0 THEN presale + 5 END::DECIMAL(10,2) AS price_box_office, 'EUR' AS price_currency, id % 6 = 1 AS sold_out, id % 9 = 2 OR presale = 0 OR contains(lower(clean), 'eintritt frei') AS free FROM p)"""


def _scraped(spark, sf_dir):
    """Staged records, their titles read as a scraper reads them."""
    id_, t = F.col("id"), F.col("title")
    labels_ = F.array(*map(F.lit, ("Konzert", "Party", None, "Sonstiges")))
    presale = (id_ % 30).cast("decimal(10,2)")
    none = F.lit(None).cast("string")
    kind = records.refined_type(records.classify.type_of_label(F.get(labels_, (id_ % 4).cast("int"))), t)
    doors = F.when(id_ % 8 != 0, F.concat((id_ % 9 + 15).cast("string"), F.lit(":15")))
    return _raw(spark, sf_dir).select(
        F.concat(F.lit("s:"), id_.cast("string")).alias("source_id"),
        (id_ % 3).alias("venue_id"),
        F.concat(F.lit("haus-"), (id_ % 3).cast("string")).alias("venue_slug"),
        F.lit(7).cast("long").alias("event_source_id"),
        records.clean_title(records.without_move(t)).alias("title"),
        F.lower(kind).alias("event_type"),
        records.classify.status_of(t).alias("status"),
        F.col("day").alias("event_date"),
        records.time_of(doors).alias("doors_time"),
        records.time_of(F.when(id_ % 7 != 0, F.concat((id_ % 6 + 18).cast("string"), F.lit(":30")))).alias("start_time"),
        *[none.alias(c) for c in ("subtitle", "description", "image_url", "ticket_url", "genre")],
        F.concat(F.lit("https://x.example/"), id_.cast("string")).alias("source_url"),
        F.when(id_ % 10 == 3, "Spende").alias("price_note"),
        presale.alias("price_presale"),
        F.when(id_ % 3 == 0, presale + 5).alias("price_box_office"),
        (id_ % 6 == 1).alias("sold_out"),
        (id_ % 9 == 2).alias("free"),
    )


@query("record_to_event", over_model(f"{_NEW} SELECT * FROM made"))
def record_to_event(spark, sf_dir):
    """Whole event rows of staged records; every fourth is known already."""
    scraped = _scraped(spark, sf_dir)
    known = scraped.select("source_id", F.substring_index("source_id", ":", -1).cast("long").alias("id")).filter("id % 4 = 0")
    return records.event_rows(scraped, known.withColumn("created_at", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")))


_EMPTY = ("subtitle", "description", "image_url", "source_url", "ticket_url", "genre", "price_note", "doors_time", "facebook_event_url")


@query("requested_events", over_model(f"""SELECT CASE WHEN id % 2 = 0 THEN id END AS id, venue_id, 'Neu: ' || title AS title, {', '.join(f'NULL::VARCHAR AS {c}' for c in _EMPTY)}, 'manual:' || id AS source_id, event_date, start_time, 'CHF' AS price_currency, sold_out, free, event_type, status,
    trim(regexp_replace(lower(event_date::VARCHAR || '-haus-' || venue_id % 4 || '-neu-' || title), '[^a-z0-9]+', '-', 'g'), '-') AS slug, price_presale, (id % 50 + 0.5)::DECIMAL(10,2) AS price_box_office, CASE WHEN id % 2 = 0 THEN event_source_id END AS event_source_id, CASE WHEN id % 2 = 0 THEN event_date::TIMESTAMP END AS created_at FROM event"""))
def requested_events(spark, sf_dir):
    """An editor's requests: every other one replaces an event, which keeps its source and creation."""
    events, id_ = Listings(spark, sf_dir).event, F.col("id")
    none = [F.lit(None).cast("string").alias(c) for c in _EMPTY]
    given = events.select(
        F.when(id_ % 2 == 0, id_).alias("id"), "venue_id", F.concat(F.lit("haus-"), (F.col("venue_id") % 4).cast("string")).alias("venue_slug"), F.concat(F.lit("Neu: "), "title").alias("title"), *none,
        F.concat(F.lit("manual:"), id_.cast("string")).alias("source_id"), "event_date", "start_time", F.lit("CHF").alias("price_currency"), "sold_out", "free", "event_type", "status", "price_presale", (id_ % 50 + 0.5).alias("price_box_office"),
    )
    return records.requested(given, events.select("id", "event_source_id", F.col("event_date").cast("timestamp_ntz").alias("created_at")))


@query("patch_events", over_model("SELECT e.id, coalesce(c.title, e.title) AS title, coalesce(c.start_time, e.start_time) AS start_time, e.source_id FROM event e LEFT JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 'New ' || title END AS title, CASE WHEN id % 4 = 0 THEN '17:00:00' END AS start_time FROM event WHERE id % 3 = 0) c USING (id)"))
def patch_events(spark, sf_dir):
    """A partial update: new values where given; id and source stay."""
    events = Listings(spark, sf_dir).event.select("id", "title", "start_time", "source_id")
    changes = events.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), "title")).alias("title"), F.when(F.col("id") % 4 == 0, F.lit("17:00:00")).alias("start_time"))
    return records.patched(events, changes, "id", ["title", "start_time"])


@query("admin_events", over_model("""SELECT e.id, e.title, coalesce((SELECT string_agg(x.artist_id::VARCHAR || CASE WHEN x.billing_order = 1 THEN ':headliner' ELSE ':support' END, ',' ORDER BY x.billing_order, x.artist_id) FROM event_artist x WHERE x.event_id = e.id), '') AS artists,
    coalesce((SELECT string_agg(p.promoter_id::VARCHAR, ',' ORDER BY p.promoter_id) FROM event_promoter p WHERE p.event_id = e.id), '') AS promoters FROM event e"""))
def admin_events(spark, sf_dir):
    """Events with their artists' ids and roles, and their promoters' ids."""
    t = Listings(spark, sf_dir)
    role = F.when(F.col("billing_order") == 1, ":headliner").otherwise(":support")
    artists = t.event_artist.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("billing_order", "artist_id", F.concat(F.col("artist_id").cast("string"), role).alias("t")))).alias("x"))
    hosts = t.event_promoter.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list("promoter_id")).alias("y"))
    both = t.event.select("id", "title").join(artists, "id", "left").join(hosts, "id", "left")
    joined = F.array_join(F.transform("x", lambda a: a["t"]), ","), F.array_join(F.transform("y", lambda p: p.cast("string")), ",")
    return both.select("id", "title", *[F.coalesce(j, F.lit("")).alias(n) for j, n in zip(joined, ("artists", "promoters"), strict=True)])
