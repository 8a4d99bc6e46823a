"""Queries of imports: dedup, stale rows, changes, associations, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators import quality, schedule, upsert
from marquee.plans.registry import query
from marquee.sources.tables import AS_OF, Listings, over_model

#: A scrape made of the events: every 8th is gone, every 10th dearer, every 12th listed twice.
_SCRAPED = """, scraped AS (SELECT * EXCLUDE (price_presale), CASE WHEN id % 10 = 0 THEN price_presale + 1 ELSE price_presale END::DECIMAL(10,2) AS price_presale, id AS pos FROM event WHERE id % 8 <> 0
    UNION ALL BY NAME SELECT * EXCLUDE (price_presale, title), CASE WHEN id % 10 = 0 THEN price_presale + 1 ELSE price_presale END::DECIMAL(10,2) AS price_presale, upper(title) AS title, id + 1000000000 AS pos FROM event WHERE id % 8 <> 0 AND id % 12 = 1)"""


def scraped(t: Listings):
    rows = t.event.filter("id % 8 <> 0").withColumn("price_presale", F.when(F.col("id") % 10 == 0, (F.col("price_presale") + 1).cast("decimal(10,2)")).otherwise(F.col("price_presale")))
    twice = rows.filter("id % 12 = 1").withColumn("title", F.upper("title")).withColumn("pos", F.col("id") + 1_000_000_000)
    return rows.withColumn("pos", F.col("id")).unionByName(twice)


_KEY = "event_date::VARCHAR || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '@' || coalesce(replace(substr(start_time, 1, 5), ':', ''), '')"
_DEDUP = f"""{_SCRAPED}, future AS (SELECT * FROM scraped WHERE event_date >= DATE '{AS_OF}'),
d1 AS (SELECT *, {_KEY} AS sitting FROM future QUALIFY row_number() OVER (PARTITION BY event_source_id, source_id ORDER BY pos) = 1),
fresh AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY event_source_id, sitting ORDER BY pos) = 1)"""


def fresh(t: Listings):
    return upsert.deduplicated(upsert.upcoming(scraped(t), AS_OF))


@query("upsert_dedup", over_model(f"{_DEDUP} SELECT source_id, title, pos FROM fresh"))
def upsert_dedup(spark, sf_dir):
    return fresh(Listings(spark, sf_dir)).select("source_id", "title", "pos")


@query("past_dropped", over_model(f"{_SCRAPED} SELECT event_date >= DATE '{AS_OF}' AS kept, count(*) AS n FROM scraped GROUP BY ALL"))
def past_dropped(spark, sf_dir):
    return scraped(Listings(spark, sf_dir)).groupBy((F.col("event_date") >= F.lit(AS_OF).cast("date")).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


_SLUGS = ", s AS (SELECT id, start_time, event_date::VARCHAR || '-' || lower(replace(title, ' ', '-')) AS slug FROM event)"


@query("slug_discriminators", over_model(f"{_SLUGS} SELECT id, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 AND start_time IS NOT NULL THEN slug || '-' || replace(substr(start_time, 1, 5), ':', '') ELSE slug END AS slug FROM s"))
def slug_discriminators(spark, sf_dir):
    rows = Listings(spark, sf_dir).event.select("id", "start_time", F.concat(F.col("event_date").cast("string"), F.lit("-"), F.lower(F.replace("title", F.lit(" "), F.lit("-")))).alias("slug"))
    return upsert.discriminated(rows).select("id", "slug")


_STALE = f""", reach AS (SELECT event_source_id, max(event_date) AS last FROM fresh GROUP BY 1),
stale AS (SELECT e.* FROM event e JOIN reach r ON r.event_source_id = e.event_source_id WHERE e.event_date > DATE '{AS_OF}' AND e.event_date <= r.last
    AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.event_source_id = e.event_source_id AND f.source_id = e.source_id))"""


@query("stale_rows", over_model(f"{_DEDUP}{_STALE} SELECT id, source_id FROM stale"))
def stale_rows(spark, sf_dir):
    t = Listings(spark, sf_dir)
    return upsert.stale(t.event, fresh(t), AS_OF).select("id", "source_id")


_COMPARED = ["title", "subtitle", "event_type", "status", "event_date", "start_time", "genre", "price_presale", "price_box_office", "price_note", "sold_out", "free"]
_OPS = f""", ops AS (SELECT f.source_id, CASE WHEN e.id IS NULL THEN 'INSERT' WHEN {' AND '.join(f'f.{c} IS NOT DISTINCT FROM e.{c}' for c in _COMPARED)} THEN 'SKIP' ELSE 'UPDATE' END AS op
    FROM fresh f LEFT JOIN (SELECT * FROM event WHERE id % 15 <> 2) e ON e.source_id = f.source_id)"""


def _changed(t: Listings):
    return upsert.changes(fresh(t), t.event.filter("id % 15 <> 2"), _COMPARED)


@query("upsert_changes", over_model(f"{_DEDUP}{_OPS} SELECT source_id, op FROM ops"))
def upsert_changes(spark, sf_dir):
    return _changed(Listings(spark, sf_dir)).select("source_id", "op")


@query("upsert_outcome", over_model(f"{_DEDUP}{_OPS} SELECT count(*) FILTER (WHERE op = 'INSERT') AS inserted, count(*) FILTER (WHERE op = 'UPDATE') AS updated, count(*) FILTER (WHERE op = 'SKIP') AS skipped, count(*) AS total FROM ops"))
def upsert_outcome(spark, sf_dir):
    return upsert.outcome(_changed(Listings(spark, sf_dir)))


@query("upsert_table", over_model(f"""{_DEDUP}{_STALE}, w AS (SELECT f.id, f.source_id, f.title, f.price_presale FROM fresh f JOIN event e ON e.source_id = f.source_id WHERE NOT ({' AND '.join(f'f.{c} IS NOT DISTINCT FROM e.{c}' for c in _COMPARED)}))
    SELECT id, source_id, title, price_presale FROM event WHERE source_id NOT IN (SELECT source_id FROM stale) AND source_id NOT IN (SELECT source_id FROM w) UNION ALL SELECT * FROM w"""))
def upsert_table(spark, sf_dir):
    t = Listings(spark, sf_dir)
    return upsert.upserted(t.event, scraped(t), _COMPARED, AS_OF).select("id", "source_id", "title", "price_presale")


def _diff(name, table, fk, attribute=None):
    """The links of a later import: some gone, some new, some moved on the bill."""
    moved = f", CASE WHEN event_id % 6 = 0 THEN {attribute} + 10 ELSE {attribute} END AS {attribute}" if attribute else ""
    plain = f", {attribute}" if attribute else ""
    added = f"SELECT event_id + 5 AS event_id, {fk}{plain} FROM {table} WHERE event_id % 13 = 0"
    want = f"SELECT event_id, {fk}{', min(' + attribute + ') AS ' + attribute if attribute else ''} FROM (SELECT event_id, {fk}{moved} FROM {table} WHERE event_id % 7 <> 0 UNION ALL {added}) GROUP BY event_id, {fk}"
    update = f"WHEN d.{attribute} <> e.{attribute} THEN 'UPDATE'" if attribute else ""
    out = f", coalesce(d.{attribute}, e.{attribute}) AS {attribute}" if attribute else ""
    sql = f"SELECT * FROM (SELECT coalesce(d.event_id, e.event_id) AS event_id, coalesce(d.{fk}, e.{fk}) AS {fk}, CASE WHEN e.event_id IS NULL THEN 'INSERT' WHEN d.event_id IS NULL THEN 'DELETE' {update} END AS op{out} FROM ({want}) d FULL JOIN {table} e ON d.event_id = e.event_id AND d.{fk} = e.{fk}) WHERE op IS NOT NULL"

    @query(name, over_model(sql))
    def run(spark, sf_dir):
        existing = getattr(Listings(spark, sf_dir), table)
        desired = existing.filter("event_id % 7 <> 0")
        if attribute:
            desired = desired.withColumn(attribute, F.when(F.col("event_id") % 6 == 0, F.col(attribute) + 10).otherwise(F.col(attribute)))
        desired = desired.unionByName(existing.filter("event_id % 13 = 0").withColumn("event_id", F.col("event_id") + 5))
        return upsert.association_diff(desired, existing, ["event_id", fk], [attribute] if attribute else [])


_diff("association_diff_artists", "event_artist", "artist_id", "billing_order")
_diff("association_diff_promoters", "event_promoter", "promoter_id")
_diff("association_diff_genres", "event_genre_tag", "genre_slug")


@query("resolve_or_create_dim", over_model("""SELECT c.slug, coalesce(a.name, c.name) AS name, a.id IS NULL AS created FROM
    (SELECT slug, min(name) AS name FROM (SELECT CASE WHEN id % 20 = 0 THEN 'new-' || slug ELSE slug END AS slug, upper(name) AS name FROM artist) GROUP BY slug) c LEFT JOIN artist a ON a.slug = c.slug"""))
def resolve_or_create_dim(spark, sf_dir):
    artists = Listings(spark, sf_dir).artist
    asked = artists.select(F.when(F.col("id") % 20 == 0, F.concat(F.lit("new-"), "slug")).otherwise(F.col("slug")).alias("slug"), F.upper("name").alias("name"))
    return upsert.resolved(asked, artists).select("slug", "name", "created")


@query("missing_references", over_model("SELECT DISTINCT artist_id + 40 AS artist_id FROM event_artist WHERE artist_id + 40 NOT IN (SELECT id FROM artist)"))
def missing_references(spark, sf_dir):
    t = Listings(spark, sf_dir)
    return upsert.missing(t.event_artist.select((F.col("artist_id") + 40).alias("artist_id")), t.artist.select(F.col("id").alias("artist_id")), "artist_id")


@query("cascade_delete", over_model("SELECT x.event_id, x.artist_id FROM event_artist x WHERE x.event_id NOT IN (SELECT id FROM event WHERE venue_id % 5 = 0)"))
def cascade_delete(spark, sf_dir):
    t = Listings(spark, sf_dir)
    gone = t.event.filter("venue_id % 5 = 0").select(F.col("id").alias("event_id"))
    return t.event_artist.join(gone, "event_id", "left_anti").select("event_id", "artist_id")


@query("orphan_to_manual", over_model("SELECT CASE WHEN event_source_id IS NULL OR event_source_id IN (SELECT id FROM event_source WHERE NOT enabled) THEN 'manual' ELSE 'source' END AS kind, count(*) AS n FROM event GROUP BY 1"))
def orphan_to_manual(spark, sf_dir):
    """Deleting a source leaves its events without one."""
    t = Listings(spark, sf_dir)
    gone = t.event_source.filter("NOT enabled").select(F.col("id").alias("event_source_id"), F.lit(True).alias("gone"))
    rows = t.event.join(gone, "event_source_id", "left")
    return rows.groupBy(F.when(F.col("event_source_id").isNull() | F.col("gone").isNotNull(), "manual").otherwise("source").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_PER = "SELECT event_source_id AS source, count(*) AS n FROM event WHERE {0} GROUP BY 1"


@query("snapshot_diff", over_model(f"""SELECT coalesce(b.source, a.source) AS source, b.n AS before, a.n AS after, CASE WHEN b.source IS NULL THEN 'new' WHEN a.source IS NULL THEN 'GONE' WHEN a.n < b.n THEN 'REGRESSION' WHEN a.n > b.n THEN 'grew' ELSE 'same' END AS verdict
    FROM ({_PER.format("event_source_id > 2 AND id % 2 = 0")}) b FULL JOIN ({_PER.format("event_source_id < 24 AND (id % 2 = 1 OR event_source_id = 9 AND id % 2 = 0)")}) a ON a.source = b.source"""))
def snapshot_diff(spark, sf_dir):
    def per(where):
        return Listings(spark, sf_dir).event.filter(where).groupBy(F.col("event_source_id").alias("source")).agg(F.count(F.lit(1)).alias("n"))

    return upsert.snapshot_diff(per("event_source_id > 2 AND id % 2 = 0"), per("event_source_id < 24 AND (id % 2 = 1 OR event_source_id = 9 AND id % 2 = 0)"))


@query("check_summary", over_model(f"SELECT event_source_id, min(event_date) AS first_date, max(event_date) AS last_date, count(*) AS total, count(*) FILTER (WHERE event_date < DATE '{AS_OF}') AS past FROM event GROUP BY 1"))
def check_summary(spark, sf_dir):
    return Listings(spark, sf_dir).event.groupBy("event_source_id").agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_date") < F.lit(AS_OF).cast("date")).alias("past"))


_GAPS = ["subtitle", "start_time", "price_presale", "price_box_office", "price_note", "genre", "event_source_id"]


@query("check_coverage", over_model("SELECT venue_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS no_{c}" for c in _GAPS) + " FROM event GROUP BY 1"))
def check_coverage(spark, sf_dir):
    return Listings(spark, sf_dir).event.groupBy("venue_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in _GAPS])


@query("check_types", over_model("SELECT event_type, status, count(*) AS n FROM event GROUP BY 1, 2"))
def check_types(spark, sf_dir):
    return Listings(spark, sf_dir).event.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type", "status")


@query("check_suspicious", over_model("SELECT id, title FROM event e WHERE EXISTS (SELECT 1 FROM event d WHERE d.event_source_id IS NOT DISTINCT FROM e.event_source_id AND d.event_date = e.event_date AND lower(d.title) = lower(e.title) AND d.id <> e.id)"))
def check_suspicious(spark, sf_dir):
    """Events that share source, date and title with another: one shuffle, and no self join."""
    same = Window.partitionBy("event_source_id", "event_date", F.lower("title"))
    rows = Listings(spark, sf_dir).event.withColumn("n", F.count(F.lit(1)).over(same))
    return rows.filter((F.col("n") > 1) | quality.placeholder(F.col("title"))).select("id", "title")


@query("check_sample", over_model(f"""SELECT e.id, e.event_date, (SELECT string_agg(a.name, ', ' ORDER BY x.billing_order, a.name) FROM event_artist x JOIN artist a ON a.id = x.artist_id WHERE x.event_id = e.id) AS acts
    FROM (SELECT * FROM event WHERE event_date >= DATE '{AS_OF}' ORDER BY event_date, start_time NULLS LAST, id LIMIT 5) e"""))
def check_sample(spark, sf_dir):
    t = Listings(spark, sf_dir)
    five = t.event.filter(F.col("event_date") >= F.lit(AS_OF).cast("date")).orderBy("event_date", F.col("start_time").asc_nulls_last(), "id").limit(5).select("id", "event_date")
    links = t.event_artist.join(five.select(F.col("id").alias("event_id")), "event_id").join(t.artist.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    acts = links.groupBy(F.col("event_id").alias("id")).agg(F.expr("array_join(transform(sort_array(collect_list(struct(billing_order, name))), x -> x.name), ', ')").alias("acts"))
    return five.join(acts, "id", "left")


@query("events_per_source_zero", over_model("SELECT s.slug, count(e.id) AS n FROM event_source s LEFT JOIN (SELECT * FROM event WHERE event_source_id % 5 <> 3) e ON e.event_source_id = s.id GROUP BY 1"))
def events_per_source_zero(spark, sf_dir):
    t = Listings(spark, sf_dir)
    counts = t.event.filter("event_source_id % 5 <> 3").groupBy(F.col("event_source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return t.event_source.join(counts, "id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


@query("festival_sibling_fix", over_model("SELECT id, CASE WHEN bool_or(event_type = 'FESTIVAL') OVER (PARTITION BY title, event_date) THEN 'FESTIVAL' ELSE event_type END AS event_type FROM event"))
def festival_sibling_fix(spark, sf_dir):
    any_ = F.bool_or(F.col("event_type") == "FESTIVAL").over(Window.partitionBy("title", "event_date"))
    return Listings(spark, sf_dir).event.select("id", F.when(any_, "FESTIVAL").otherwise(F.col("event_type")).alias("event_type"))


@query("preferred_duplicate", over_model("SELECT id, event_date, title FROM event QUALIFY row_number() OVER (PARTITION BY event_date, title ORDER BY price_presale IS NULL, id) = 1"))
def preferred_duplicate(spark, sf_dir):
    return upsert.first_of(Listings(spark, sf_dir).event, ["event_date", "title"], [F.col("price_presale").isNull(), "id"]).select("id", "event_date", "title")


@query("precedence_argmin", over_model("SELECT venue_id, arg_min(id, (CASE event_type WHEN 'FESTIVAL' THEN 0 WHEN 'CONCERT' THEN 1 ELSE 2 END) * 1000000000000 + id) AS id FROM event GROUP BY 1"))
def precedence_argmin(spark, sf_dir):
    rank = F.when(F.col("event_type") == "FESTIVAL", 0).when(F.col("event_type") == "CONCERT", 1).otherwise(2)
    return Listings(spark, sf_dir).event.groupBy("venue_id").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


@query("forward_fill_dates", over_model("SELECT id, last_value(CASE WHEN id % 3 = 0 THEN event_date END IGNORE NULLS) OVER (PARTITION BY venue_id ORDER BY id) AS seen FROM event"))
def forward_fill_dates(spark, sf_dir):
    rows = Listings(spark, sf_dir).event.select("id", "venue_id", F.when(F.col("id") % 3 == 0, F.col("event_date")).alias("seen"))
    return schedule.filled_forward(rows, "seen", ["venue_id"], ["id"]).select("id", "seen")


@query("segment_by_marker", over_model("SELECT id, sum((event_type = 'FESTIVAL')::INT) OVER (PARTITION BY venue_id ORDER BY id)::BIGINT AS segment FROM event"))
def segment_by_marker(spark, sf_dir):
    return schedule.segments(Listings(spark, sf_dir).event, F.col("event_type") == "FESTIVAL", ["venue_id"], ["id"]).select("id", "segment")


_NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"


@query("due_sources", over_model(f"""SELECT slug FROM event_source WHERE enabled AND status NOT IN ('RUNNING', 'MISCONFIGURED') AND (status <> 'FAILED' OR retry_count < max_retries)
    AND (last_import_at IS NULL OR status = 'IDLE' OR {_NOW} > last_import_at + to_minutes((import_interval_minutes * CASE WHEN status = 'FAILED' AND retry_count > 0 THEN 2 ** least(retry_count, 6) ELSE 1 END)::BIGINT))"""))
def due_sources(spark, sf_dir):
    return schedule.due(Listings(spark, sf_dir).event_source, f"{AS_OF} 00:00:00").select("slug")


_STUCK = f"status = 'RUNNING' AND last_import_at < {_NOW} - INTERVAL 30 MINUTE"


@query("stuck_sources", over_model(f"SELECT slug FROM event_source WHERE {_STUCK}"))
def stuck_sources(spark, sf_dir):
    return Listings(spark, sf_dir).event_source.filter(schedule.stuck(f"{AS_OF} 00:00:00")).select("slug")


@query("source_state_rewrite", over_model(f"SELECT slug, CASE WHEN {_STUCK} THEN 'FAILED' ELSE status END AS status, CASE WHEN {_STUCK} THEN retry_count + 1 ELSE retry_count END AS retry_count FROM event_source"))
def source_state_rewrite(spark, sf_dir):
    return schedule.reset_stuck(Listings(spark, sf_dir).event_source, f"{AS_OF} 00:00:00").select("slug", "status", "retry_count")


@query("weekly_recurrence", over_model(f""", d AS (SELECT id, unnest(generate_series(event_date::TIMESTAMP, TIMESTAMP '1998-09-01', to_days(CAST(7 * (1 + id % 3) AS INT))))::DATE AS day FROM event WHERE event_type = 'FESTIVAL' AND event_date <= DATE '1998-09-01'),
    k AS (SELECT id, day FROM d QUALIFY id % 2 = 0 OR row_number() OVER (PARTITION BY id ORDER BY day) <= 40) SELECT id, day FROM k WHERE day >= DATE '{AS_OF}' AND NOT (id % 5 = 0 AND day = (SELECT event_date FROM event e WHERE e.id = k.id) + 70)"""))
def weekly_recurrence(spark, sf_dir):
    e = Listings(spark, sf_dir).event.filter("event_type = 'FESTIVAL'")
    rules = e.select("id", F.col("event_date").alias("start"), (1 + F.col("id") % 3).cast("int").alias("weeks"), F.lit(None).cast("date").alias("last"), F.when(F.col("id") % 2 == 1, 40).alias("most"))
    excluded = e.filter("id % 5 = 0").select("id", F.date_add("event_date", 70).alias("day"))
    return schedule.recurring(rules, excluded, AS_OF, "1998-09-01")


@query("standing_weekly_night", over_model(f"SELECT id, day FROM (SELECT r_regionkey AS id, unnest([DATE '{AS_OF}' + CAST((r_regionkey + 7 - 0) % 7 + 7 * i AS INT) for i in range(8)]) AS day FROM region) WHERE id <> 2 OR day < DATE '1998-06-20'"))
def standing_weekly_night(spark, sf_dir):
    """Region 0 plays on Mondays (as the day itself is), 1 on Tuesdays and so on."""
    r = Listings(spark, sf_dir).raw("region")
    day = F.get(F.array(*map(F.lit, ("MON", "TUE", "WED", "THU", "FRI"))), F.col("r_regionkey"))
    return schedule.weekly_nights(r.select(F.col("r_regionkey").alias("id"), day.alias("weekday"), F.when(F.col("r_regionkey") == 2, F.lit("1998-06-20").cast("date")).alias("paused_from")), AS_OF)


_AGES = f", ages AS (SELECT slug, group_key, (epoch({_NOW}) - epoch(last_success_at)) / 60 AS age FROM event_source)"


def _ages(spark, sf_dir):
    return Listings(spark, sf_dir).event_source.select("slug", "group_key", schedule.age_minutes(F.col("last_success_at"), f"{AS_OF} 00:00:00").alias("age"))


@query("staleness_age", over_model(f"{_AGES} SELECT group_key, max(age)::DOUBLE AS worst FROM ages GROUP BY 1"))
def staleness_age(spark, sf_dir):
    return _ages(spark, sf_dir).groupBy("group_key").agg(F.max("age").alias("worst"))


@query("stale_count_over", over_model(f"{_AGES} SELECT count(*) FILTER (WHERE age > 7200) AS n FROM ages"))
def stale_count_over(spark, sf_dir):
    return _ages(spark, sf_dir).agg(F.count_if(F.col("age") > 7200).alias("n"))


@query("stalest_top20", over_model(f"{_AGES} SELECT slug, age::DOUBLE AS age FROM ages WHERE age IS NOT NULL ORDER BY age DESC, slug LIMIT 20"))
def stalest_top20(spark, sf_dir):
    return _ages(spark, sf_dir).select("slug", "age").filter("age IS NOT NULL").orderBy(F.desc("age"), "slug").limit(20)


_RUNS = ", runs AS (SELECT event_type AS source, CASE user_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'failed' ELSE 'skipped' END AS outcome, value::DECIMAL(18,4) AS seconds, ts FROM events)"


def _runs(spark, sf_dir):
    u = F.col("user_id") % 4
    return Listings(spark, sf_dir).raw("events").select(F.col("event_type").alias("source"), F.when(u == 0, "success").when(u == 1, "not_modified").when(u == 2, "failed").otherwise("skipped").alias("outcome"), F.col("value").cast("decimal(18,4)").alias("seconds"), "ts")


@query("run_outcomes", over_model(f"{_RUNS} SELECT source, outcome, count(*) AS n, sum(seconds)::DOUBLE AS total_s, max(seconds)::DOUBLE AS max_s FROM runs GROUP BY 1, 2"))
def run_outcomes(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").cast("double").alias("total_s"), F.max("seconds").cast("double").alias("max_s"))


@query("last_success", over_model(f"{_RUNS} SELECT source, max(ts) FILTER (WHERE outcome IN ('success', 'not_modified')) AS last_success_at FROM runs GROUP BY 1"))
def last_success(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("source").agg(F.max(F.when(F.col("outcome").isin("success", "not_modified"), F.col("ts"))).alias("last_success_at"))


@query("events_written", over_model(f"{_DEDUP}{_OPS} SELECT split_part(source_id, ':', 1) AS source, op, count(*) AS n FROM ops GROUP BY 1, 2"))
def events_written(spark, sf_dir):
    return _changed(Listings(spark, sf_dir)).groupBy(F.split_part("source_id", F.lit(":"), F.lit(1)).alias("source"), "op").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props(spark, sf_dir):
    return Listings(spark, sf_dir).raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))
