"""Queries of text, date and page functions, and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import classify, genres, names
from marquee.plans.registry import query
from marquee.sources import pages
from marquee.sources.tables import AS_OF, Listings, over_model
from marquee.streaming import windows

#: Titles, states and notes made of orders, so that every rule fires.
_WORDS = ("Pub Quiz", "Circus Night", "Kino im Hof", "Poetry Slam", "Vernissage", "Flohmarkt", "Rave", "Summer Festival", "Konzert Abgesagt", "verschoben: Show", "Eintritt frei", "VVK 12,50 € AK 15€", "ab 9 €", "Verlegt - free")
_RAW = ", raw AS (SELECT o_orderkey AS id, [" + ", ".join(f"'{w}'" for w in _WORDS) + "][o_orderkey % 14 + 1] AS title FROM orders)"


def _raw(spark, sf_dir):
    return Listings(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, _WORDS)), (F.col("o_orderkey") % 14).cast("int")).alias("title"), "o_orderdate")


@query("classify_title", over_model(f"""{_RAW} SELECT id, CASE WHEN lower(title) LIKE '%quiz%' THEN 'QUIZ' WHEN regexp_matches(lower(title), 'wrestling|burlesque|circus') THEN 'SHOW'
    WHEN regexp_matches(lower(title), 'screening|public viewing|\\bkino\\b') THEN 'SCREENING' WHEN regexp_matches(lower(title), 'lesung|\\bslam\\b') THEN 'READING' WHEN regexp_matches(lower(title), 'ausstellung|exhibition|vernissage') THEN 'EXHIBITION'
    WHEN lower(title) LIKE '%markt%' THEN 'OTHER' WHEN regexp_matches(lower(title), 'party|karaoke|\\brave\\b') THEN 'PARTY' END AS kind, regexp_matches(lower(title), '\\bfestivals?\\b') AS festival FROM raw"""))
def classify_title(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", classify.type_of_title(F.col("title")).alias("kind"), F.col("title").rlike(classify.FESTIVAL).alias("festival"))


@query("classify_status", over_model(f"{_RAW} SELECT id, CASE WHEN title ILIKE '%abgesagt%' THEN 'CANCELLED' WHEN title ILIKE '%verschoben%' THEN 'POSTPONED' WHEN title ILIKE '%verlegt%' THEN 'RELOCATED' ELSE 'SCHEDULED' END AS status FROM raw"))
def classify_status(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", classify.status_of(F.col("title")).alias("status"))


@query("detect_free", over_model(f"{_RAW} SELECT id, regexp_matches(lower(title), '\\b(free|frei|gratis)\\b') AS free FROM raw"))
def detect_free(spark, sf_dir):
    none = F.lit(None).cast("decimal(10,2)")
    return _raw(spark, sf_dir).select("id", classify.is_free(none, none, F.col("title"), F.lit("")).alias("free"))


_PRICE_TEXTS = ["'VVK ' || n || ',50 € AK 15€'", "'ab ' || n || ' €'", "n || '.5€ / ermäßigt 3 €'", "'€ ' || n", "'Eintritt: ' || n || ',125 €'", "n || chr(160) || '€'", "'frei'", "'AK ' || n || ' EUR, 2.00 €'"]


@query("parse_price", rf"""SELECT id, replace(nullif(regexp_extract(text, '(\d+(?:[.,]\d{{1,2}})?)[\s\x{{00A0}}]*€', 1), ''), ',', '.')::DECIMAL(10,2) AS price FROM
    (SELECT id, [{', '.join(_PRICE_TEXTS)}][id % {len(_PRICE_TEXTS)} + 1] AS text FROM (SELECT o_orderkey AS id, (o_orderkey % 97)::VARCHAR AS n FROM orders))""")
def parse_price(spark, sf_dir):
    """First amounts in euros, in texts of several forms made of the orders' numbers."""
    rows = Listings(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).cast("string").alias("n"))
    texts = F.array(*[F.expr(x.replace("chr(160)", "' '")) for x in _PRICE_TEXTS])
    return rows.select("id", classify.price_of(F.get(texts, (F.col("id") % len(_PRICE_TEXTS)).cast("int"))).alias("price"))


@query("parse_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS day FROM orders")
def parse_dates(spark, sf_dir):
    text = F.when(F.col("id") % 5 == 0, "31.02.1999").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "d.M.yyyy")))
    return _raw(spark, sf_dir).select("id", classify.german_date(text).alias("day"))


@query("infer_year", f"""WITH c AS (SELECT o_orderkey AS id, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 7 + 1 AS wd, y, try_strptime(y::VARCHAR || '-' || month(o_orderdate)::VARCHAR || '-' || day(o_orderdate)::VARCHAR, '%Y-%m-%d')::DATE AS x FROM orders, range(1996, 2001) t(y))
    SELECT id, arg_min(x, (CASE WHEN isodow(x) = wd THEN 0 ELSE 1 END, abs(x - DATE '{AS_OF}'), x)) AS day FROM c WHERE x IS NOT NULL GROUP BY id""")
def infer_year(spark, sf_dir):
    o = Listings(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"))
    return o.distinct().select("id", classify.inferred_date(F.col("m"), F.col("d"), F.col("id") % 7 + 1, AS_OF).alias("day"))


@query("slugify_ascii", "SELECT doc_id, trim(regexp_replace(lower(coalesce(source, '') || ' ' || coalesce(lang, '') || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugify_ascii(spark, sf_dir):
    d = Listings(spark, sf_dir).raw("documents")
    return d.select("doc_id", classify.slug(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit("!"))).alias("slug"))


@query("normalized_key", "SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9äöüß]', '', 'g') AS key FROM part")
def normalized_key(spark, sf_dir):
    return Listings(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9äöüß]", "").alias("key"))


@query("url_slug", "SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE string_split(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/')[-1] END AS slug FROM pages")
def url_slug(spark, sf_dir):
    return Listings(spark, sf_dir).raw("pages").select("page_id", classify.url_slug(F.col("url")).alias("slug"))


_TAG = "(?s)<script.*?</script>|<style.*?</style>|<title>.*?</title>|<!--.*?-->|<![^>]*>"
_TEXT = "nullif(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_extract({0}, '(?s)<{1}>(.*?)</{1}>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '')"


@query("html_extract", f"""SELECT page_id, {_TEXT.format('html', 'title')} AS title, {_TEXT.format('html', 'h1')} AS heading, len(list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), lambda x: trim(x) <> ''))::INT AS n_links,
    len(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{_TAG}', '', 'g'), '</?(br|p|div|li|tr|h[1-6]|section|article)(\\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\\s]')))::INT AS n_lines FROM pages""")
def html_extract(spark, sf_dir):
    return pages.extracted(Listings(spark, sf_dir).raw("pages"))


@query("canonical_artist", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part")
def canonical_artist(spark, sf_dir):
    return Listings(spark, sf_dir).artist.select("id", names.artist_udf(F.upper("name")).alias("name"))


@query("canonical_promoter", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def canonical_promoter(spark, sf_dir):
    return Listings(spark, sf_dir).promoter.select("id", names.promoter_udf(F.concat("name", F.lit(" Concerts GmbH (DE)"))).alias("name"))


_SYNONYMS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(genres.SYNONYMS.items())) + ") k(word, tag)"


@query("normalize_genre", over_model(f""", parts AS (SELECT DISTINCT id, regexp_replace(lower(trim(part)), '[^a-z0-9&]', '', 'g') AS word FROM (SELECT id, unnest(string_split_regex(genre, '[,/]')) AS part FROM event))
    SELECT tag AS genre, count(*) AS n FROM (SELECT DISTINCT id, tag FROM parts JOIN {_SYNONYMS} USING (word)) GROUP BY 1"""))
def normalize_genre(spark, sf_dir):
    return Listings(spark, sf_dir).event.select("id", F.explode(genres.tags_udf("genre")).alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


@query("two_page_enrich", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'detail' END, CASE WHEN o_orderkey % 2 = 0 THEN 'overview' END) AS title, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS event_date FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0")
def two_page_enrich(spark, sf_dir):
    o = Listings(spark, sf_dir).event
    overview = o.select("id", F.when(F.col("id") % 2 == 0, "overview").alias("title"), F.when(F.col("id") % 5 != 0, F.col("event_date")).alias("event_date"))
    detail = o.filter("id % 3 = 0").select("id", F.lit("detail").alias("title"), "event_date")
    return pages.enriched(overview, detail, "id", ["title", "event_date"])


@query("paged_union_dedup", "SELECT source_id, min(page) AS page FROM (SELECT o_custkey % 200 AS source_id, o_orderkey % 7 AS page FROM orders) GROUP BY 1")
def paged_union_dedup(spark, sf_dir):
    o = Listings(spark, sf_dir).raw("orders").select((F.col("o_custkey") % 200).alias("source_id"), (F.col("o_orderkey") % 7).alias("page"), F.col("o_orderkey").alias("pos"))
    return pages.paged(o).select("source_id", "page")


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return windows.drained(windows.tumbling(windows.events_stream(spark, sf_dir), "1 day"), "complete")


@query("stream_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) - to_hours(i) for i in range(3)]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return windows.drained(windows.sliding(windows.events_stream(spark, sf_dir), "3 hours", "1 hour"), "complete")


@query("stream_sessions", """WITH a AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, user_id, count(*) AS n FROM b GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return windows.drained(windows.sessions(windows.events_stream(spark, sf_dir), "2 hours"), "complete")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    return windows.drained(windows.once(windows.events_stream(spark, sf_dir), ["event_id"]).select("event_id"), "append")
