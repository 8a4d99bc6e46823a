"""Queries of data quality: reports, worklists, snapshots, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import billing
from marquee.operators import assemble, quality
from marquee.plans.registry import query
from marquee.sources.tables import AS_OF, Listings, over_model

_FLAGGED = """, flagged AS (SELECT e.*, s.slug AS source_slug, CASE WHEN event_source_id IS NULL THEN 'manual' ELSE coalesce(s.slug, 'unresolved-source-' || event_source_id::VARCHAR) END AS source,
    e.id IN (SELECT event_id FROM event_artist) AS has_artist, e.id IN (SELECT event_id FROM event_promoter) AS has_promoter FROM event e LEFT JOIN event_source s ON s.id = e.event_source_id)"""
_ISSUES = {
    "concerts_without_artist": "event_type = 'CONCERT' AND NOT has_artist",
    "events_typed_other": "event_type = 'OTHER'",
    "missing_genre": "coalesce(genre, '') = ''",
    "missing_promoter": "NOT has_promoter",
    "missing_price": "price_presale IS NULL AND price_box_office IS NULL AND NOT free AND price_note IS NULL",
    "missing_start_time": "start_time IS NULL",
}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _ISSUES.items())
_REPORT = f"{_FLAGGED}, report AS (SELECT source, count(*) AS total, {_COUNTS} FROM flagged GROUP BY source)"


@query("agg02_quality_report", over_model(f"{_REPORT} SELECT * FROM report"))
def agg02_quality_report(spark, sf_dir):
    return quality.report(Listings(spark, sf_dir))


@query("quality_report_sorted", over_model(f"{_REPORT} SELECT source, row_number() OVER (ORDER BY source) AS place FROM report"))
def quality_report_sorted(spark, sf_dir):
    """The report in the order of its labels, a row per source, with each row's place in it."""
    rows = quality.report(Listings(spark, sf_dir)).select("source").orderBy("source").collect()  # as many rows as sources
    return spark.createDataFrame([(r["source"], i) for i, r in enumerate(rows, 1)], "source string, place long")


_SUMS = ", ".join(f"sum({k})::BIGINT AS {k}" for k in _ISSUES)


@query("quality_overall", over_model(f"{_REPORT}, s AS (SELECT sum(total)::BIGINT AS total, {_SUMS} FROM report) SELECT *, " + ", ".join(f"CASE WHEN total = 0 THEN 0.0 ELSE round_even({k} * 1000.0::DOUBLE / total, 0) / 10.0::DOUBLE END AS {k}_pct" for k in _ISSUES) + " FROM s"))
def quality_overall(spark, sf_dir):
    return quality.overall(quality.report(Listings(spark, sf_dir)))


@query("quality_rollup", over_model(f"{_REPORT} SELECT source, total, {', '.join(_ISSUES)} FROM report UNION ALL SELECT 'overall', sum(total)::BIGINT, {_SUMS} FROM report"))
def quality_rollup(spark, sf_dir):
    return quality.with_total(Listings(spark, sf_dir))


def _worklist(name, issue, source=None, limit=50, offset=0):
    where = _ISSUES[issue] + (f" AND source = '{source}'" if source else "")

    @query(name, over_model(f"{_FLAGGED} SELECT id, title, event_date, source FROM flagged WHERE {where} ORDER BY event_date DESC, id DESC LIMIT {limit} OFFSET {offset}"))
    def run(spark, sf_dir):
        return quality.worklist(Listings(spark, sf_dir), issue, source, limit, offset)


for _k in _ISSUES:
    _worklist(f"worklist_{_k}", _k)
_worklist("worklist_manual", "missing_promoter", "manual", 500, 10)

_LONG = " UNION ALL ".join(f"SELECT DATE '{AS_OF}' AS snapshot_date, source AS source_slug, '{k}' AS metric, {k} AS metric_count, total AS total_events FROM report" for k in _ISSUES)


@query("quality_snapshot_long", over_model(f"{_REPORT} {_LONG}"))
def quality_snapshot_long(spark, sf_dir):
    return quality.snapshot(quality.report(Listings(spark, sf_dir)), AS_OF)


@query("quality_snapshot_rerun", over_model(f"{_REPORT} {_LONG}"))
def quality_snapshot_rerun(spark, sf_dir):
    """A second run on the same day replaces the first's rows."""
    new = quality.snapshot(quality.report(Listings(spark, sf_dir)), AS_OF)
    return quality.merged_snapshots(new.withColumn("metric_count", F.col("metric_count") + 1), new)


@query("suspect_artist_names", over_model("""SELECT source, count(*) AS n FROM (SELECT DISTINCT coalesce(event_source_id::VARCHAR, 'manual') AS source,
    CASE WHEN a.id % 10 = 0 THEN ' T.B.A.' WHEN a.id % 10 = 1 THEN 'N.N.' WHEN a.id % 10 = 2 THEN 'DJ-Set' ELSE a.name END AS name FROM event e JOIN event_artist x ON x.event_id = e.id JOIN artist a ON a.id = x.artist_id)
    WHERE lower(trim(replace(name, '.', ''))) IN ('tba', 'tbd', 'tbc', 'nn', 'na', 'null', '-', '') OR regexp_matches(lower(trim(name)), '^dj[- ]?sets?$') GROUP BY source"""))
def suspect_artist_names(spark, sf_dir):
    t = Listings(spark, sf_dir)
    name = F.when(F.col("artist_id") % 10 == 0, " T.B.A.").when(F.col("artist_id") % 10 == 1, "N.N.").when(F.col("artist_id") % 10 == 2, "DJ-Set").otherwise(F.col("name"))
    names = t.event.select(F.col("id").alias("event_id"), F.coalesce(F.col("event_source_id").cast("string"), F.lit("manual")).alias("source")).join(t.event_artist, "event_id").join(t.artist.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    return quality.suspects(names.select("source", name.alias("name")), billing.is_no_act_udf("name"))


_FIELDS = ("subtitle", "start_time", "price_presale", "price_box_office", "price_note", "genre")


@query("field_coverage_long", over_model("".join([", c AS (SELECT source, count(*) AS total, ", ", ".join(f"count({f}) AS {f}" for f in _FIELDS), f" FROM flagged GROUP BY source) UNPIVOT c ON {', '.join(_FIELDS)} INTO NAME field VALUE with_value"])).replace("\n, c AS", f"\n{_FLAGGED}, c AS"))
def field_coverage_long(spark, sf_dir):
    t = Listings(spark, sf_dir)
    names = t.event_source.select(F.col("id").alias("event_source_id"), F.col("slug").alias("x"))
    events = t.event.join(names, "event_source_id", "left").withColumn("source", quality.label(F.col("event_source_id"), F.col("x")))
    return quality.coverage(events, {c: F.col(c).isNotNull() for c in _FIELDS}, "source")


_TRACKED = {
    "subtitle": "subtitle IS NOT NULL", "description": "id % 3 = 0", "eventType": "id % 10 <> 1", "doorsTime": "id % 8 <> 0", "startTime": "start_time IS NOT NULL", "imageUrl": "false", "ticketUrl": "id % 2 = 0", "genre": "genre IS NOT NULL AND genre <> ''",
    "pricePresale": "price_presale IS NOT NULL", "priceBoxOffice": "price_box_office IS NOT NULL", "priceNote": "price_note IS NOT NULL", "priceAny": "price_presale IS NOT NULL OR price_box_office IS NOT NULL OR price_note IS NOT NULL",
    "artists": "id IN (SELECT event_id FROM event_artist)", "promoters": "id IN (SELECT event_id FROM event_promoter)",
}


@query("field_coverage_tracked", over_model(f", c AS (SELECT event_source_id AS source, count(*) AS total, {', '.join(f'count(*) FILTER ({w}) AS {n}' for n, w in _TRACKED.items())} FROM event GROUP BY 1) UNPIVOT c ON {', '.join(_TRACKED)} INTO NAME field VALUE with_value"))
def field_coverage_tracked(spark, sf_dir):
    """Coverage of all fields that an import watches, lists of artists and promoters among them."""
    t, id_ = Listings(spark, sf_dir), F.col("id")
    names = assemble.links(t, t.event, None, ("artists", "promoters"))
    blank = F.when(id_ % 2 == 0, " \n")
    staged = t.event.join(names, "id", "left").withColumns(
        {"description": F.when(id_ % 3 == 0, "Text").otherwise(blank), "event_type": F.when(id_ % 10 != 1, F.col("event_type")).otherwise(""), "doors_time": F.when(id_ % 8 != 0, "18:00"), "image_url": blank, "ticket_url": F.when(id_ % 2 == 0, "https://t.example")}
    )
    return quality.coverage(staged.withColumn("source", F.col("event_source_id")), quality.tracked(), "source")


_BASE = """, r AS (SELECT *, events_with_value / events_total AS ratio FROM run_stats), b AS (SELECT source, observed_at, events_total, ratio,
    CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(ratio, 0.5) OVER w END AS baseline, lag(ratio) OVER (PARTITION BY source ORDER BY observed_at) AS previous FROM r
    WINDOW w AS (PARTITION BY source ORDER BY observed_at ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


@query("coverage_baseline", over_model(f"{_BASE} SELECT source, observed_at, round(ratio, 9) AS ratio, round(baseline, 9) AS baseline, round(previous, 9) AS previous FROM b"))
def coverage_baseline(spark, sf_dir):
    b = quality.baselines(Listings(spark, sf_dir).run_stats, ["source"])
    return b.select("source", "observed_at", *[F.round(c, 9).alias(c) for c in ("ratio", "baseline", "previous")])


@query("coverage_findings", over_model(f"{_BASE} SELECT source, observed_at, round(ratio, 9) AS ratio FROM b WHERE events_total >= 10 AND ratio <= baseline * 0.97 AND baseline - ratio >= 0.001 AND previous <= baseline * 0.97 AND baseline - previous >= 0.001"))
def coverage_findings(spark, sf_dir):
    found = quality.findings(Listings(spark, sf_dir).run_stats, ["source"], 10, 0.97, 0.001)
    return found.select("source", "observed_at", F.round("ratio", 9).alias("ratio"))


@query("latest_runs_per_key", over_model("SELECT source, observed_at, events_total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY observed_at DESC) AS rn FROM run_stats) WHERE rn <= 3"))
def latest_runs_per_key(spark, sf_dir):
    return quality.latest(Listings(spark, sf_dir).run_stats, ["source"], 3).select("source", "observed_at", "events_total")
