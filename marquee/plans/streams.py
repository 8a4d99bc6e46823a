"""Queries of import sources: their states, by a stream and by a table of the same runs, and their gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators.versions import Table
from marquee.plans.registry import query
from marquee.sources.shared import shared_folder
from marquee.sources.tables import Listings
from marquee.streaming import gauges, runs, windows

_STUCK = runs.STUCK
_SQL = f"""WITH RECURSIVE r AS (SELECT 'source-' || (user_id % 10) AS source, epoch_us(ts::TIMESTAMP) AS at_us, CASE WHEN event_type IN ('view', 'purchase') THEN 'claim' WHEN event_type = 'click' THEN 'success' WHEN event_type = 'error' THEN 'failed'
    WHEN event_id % 3 = 0 THEN 'misconfigured' WHEN event_id % 3 = 1 THEN 'retry' ELSE 'not_modified' END AS kind, floor(value)::BIGINT AS n_events, CASE WHEN event_id % 4 <> 0 THEN 'error ' || event_id % 9 ELSE 'Unknown error during import' END AS error,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT source, 0::BIGINT AS n, NULL::BIGINT AS at_us, NULL::VARCHAR AS kind, NULL::BOOLEAN AS taken, 'IDLE' AS status, 0 AS retry_count, NULL::BIGINT AS last_import, NULL::BIGINT AS last_success, NULL::BIGINT AS last_event_count, NULL::VARCHAR AS last_error, false AS timed, NULL::BIGINT AS due, 0 AS due_retries FROM (SELECT DISTINCT source FROM r)
  UNION ALL
  SELECT source, n, at_us, kind, kind <> 'claim' OR now <> 'RUNNING', CASE kind WHEN 'claim' THEN 'RUNNING' WHEN 'success' THEN 'SUCCESS' WHEN 'not_modified' THEN 'SUCCESS' WHEN 'retry' THEN 'IDLE' ELSE upper(kind) END,
    CASE WHEN kind IN ('success', 'not_modified', 'retry') THEN 0 WHEN kind = 'failed' THEN retries + 1 ELSE retries END, CASE WHEN kind = 'retry' OR (kind = 'claim' AND now = 'RUNNING') THEN last_import ELSE at_us END,
    CASE WHEN kind IN ('success', 'not_modified') THEN at_us ELSE last_success END, CASE kind WHEN 'success' THEN n_events WHEN 'not_modified' THEN 0 ELSE last_event_count END,
    CASE WHEN kind IN ('failed', 'misconfigured') THEN error WHEN kind = 'claim' AND now = 'RUNNING' THEN last_error END, late, CASE WHEN late THEN last_import + {_STUCK} END, retries
  FROM (SELECT r.source, r.n, r.at_us, r.kind, r.n_events, r.error, w.last_import, w.last_success, w.last_event_count, w.last_error, w.status = 'RUNNING' AND r.at_us > w.last_import + {_STUCK} AS late,
    CASE WHEN w.status = 'RUNNING' AND r.at_us > w.last_import + {_STUCK} THEN 'FAILED' ELSE w.status END AS now, w.retry_count + (w.status = 'RUNNING' AND r.at_us > w.last_import + {_STUCK})::INT AS retries FROM w JOIN r ON r.source = w.source AND r.n = w.n + 1)),
ends AS (SELECT * FROM w QUALIFY n = max(n) OVER (PARTITION BY source))
SELECT source, at_us, kind, taken, status, retry_count, last_import, last_success, last_event_count, last_error FROM w WHERE n > 0
UNION ALL SELECT x.source, x.due, 'timeout', true, 'FAILED', x.due_retries, p.last_import, p.last_success, p.last_event_count, '{runs.TIMED_OUT}' FROM w x JOIN w p ON p.source = x.source AND p.n = x.n - 1 WHERE x.timed
UNION ALL SELECT source, last_import + {_STUCK}, 'timeout', true, 'FAILED', retry_count + 1, last_import, last_success, last_event_count, '{runs.TIMED_OUT}' FROM ends WHERE status = 'RUNNING' AND last_import + {_STUCK} <= (SELECT max(at_us) - 3600000000 FROM r)"""


@query("source_runs_streamed", _SQL)
def source_runs_streamed(spark, sf_dir):
    """All that happens to sources, time-outs by timers included, by a stream with state."""
    before = spark.conf.get(runs.PROVIDER, None)
    try:
        return windows.drained(runs.streamed(runs.runs_of(windows.events_stream(spark, sf_dir))), "append")
    finally:
        if before is None:
            spark.conf.unset(runs.PROVIDER)
        else:
            spark.conf.set(runs.PROVIDER, before)


@query("source_runs_replayed", _SQL)
def source_runs_replayed(spark, sf_dir):
    """The same from the table, up to where the stream's watermark ends."""
    rows = runs.runs_of(Listings(spark, sf_dir).raw("events"))
    last = rows.agg(F.max("at_us")).first()[0]
    return runs.replayed(rows, None if last is None else last - 3_600_000_000)


def _sources(spark, sf_dir):
    t = Listings(spark, sf_dir)
    regions = t.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return t.raw("nation").filter("n_nationkey < 20").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source"), "region")


@query("source_gauges", """SELECT coalesce(r_name, 'unknown') AS region, coalesce(n_name, 'unknown') AS source, count(*) AS events, count(*) FILTER (value > 50) AS valuable, max(epoch_us(ts::TIMESTAMP)) AS last
    FROM events LEFT JOIN nation ON n_nationkey = user_id % 25 AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def source_gauges(spark, sf_dir):
    """Gauges that a stream keeps in a versioned table."""
    path = shared_folder(spark, "gauges")
    table = Table(spark, f"{path}/gauges", gauges.SCHEMA, "region", ["source"])
    events = windows.events_stream(spark, sf_dir).select((F.col("user_id") % 25).cast("int").alias("source_id"), "value", "ts")
    gauges.keep(events, _sources(spark, sf_dir), table, "gauges", f"{path}/state").awaitTermination()
    return table.read()
