"""Queries of versioned tables: an import, its replay and a deletion; the counters of its writes; the TSV of a snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import versions
from marquee.plans.registry import query
from marquee.sources.shared import shared_folder
from marquee.sources.tables import Listings, over_model

_KEPT = ["id", "event_type", "source_id", "title", "event_date", "price_presale"]


def _imported(spark, sf_dir):
    """A table of three quarters of all events, an import of half of them, written twice, and a deletion: the table
    and the counters of each step."""
    events = Listings(spark, sf_dir).event.select(*_KEPT)
    id_ = F.col("id")
    table = versions.Table(spark, shared_folder(spark, "tables"), events.schema, "event_type", ["source_id"])
    counts = {"first": table.save(events.filter(id_ % 4 != 0), "first")}
    later = events.filter((id_ % 2 == 0) & (F.col("event_type") != "PARTY")).withColumn("title", F.when(id_ % 6 == 2, F.upper("title")).otherwise(F.col("title")))
    counts["second"] = table.save(later, "second")
    counts["again"] = table.save(later, "second")
    counts["third"] = table.delete(events.filter((id_ % 5 == 0) & (F.col("event_type") == "FESTIVAL")), "third")
    return table, counts


_AFTER = "id % 4 <> 0 OR (id % 2 = 0 AND event_type <> 'PARTY')"


@query("versioned_table", over_model(f"""SELECT id, event_type, source_id, CASE WHEN id % 6 = 2 AND event_type <> 'PARTY' THEN upper(title) ELSE title END AS title, event_date, price_presale FROM event
    WHERE ({_AFTER}) AND NOT (id % 5 = 0 AND event_type = 'FESTIVAL')"""))
def versioned_table(spark, sf_dir):
    return _imported(spark, sf_dir)[0].read()


@query("write_counters", over_model(f"""SELECT 'first' AS batch, 'inserted' AS name, count(*) FILTER (id % 4 <> 0) AS n FROM event UNION ALL SELECT 'first', 'updated', 0 UNION ALL SELECT 'first', 'skipped', 0
    UNION ALL SELECT 'second', 'inserted', count(*) FILTER (id % 4 = 0 AND event_type <> 'PARTY') FROM event UNION ALL SELECT 'second', 'updated', count(*) FILTER (id % 4 = 2 AND id % 6 = 2 AND event_type <> 'PARTY') FROM event
    UNION ALL SELECT 'second', 'skipped', count(*) FILTER (id % 4 = 2 AND id % 6 <> 2 AND event_type <> 'PARTY') FROM event
    UNION ALL SELECT 'third', 'deleted', count(*) FILTER (id % 5 = 0 AND event_type = 'FESTIVAL' AND ({_AFTER})) FROM event UNION ALL SELECT 'third', 'kept', count(*) FILTER (id % 5 <> 0 AND event_type = 'FESTIVAL' AND ({_AFTER})) FROM event"""))
def write_counters(spark, sf_dir):
    """Counters as the writes themselves observed them; a replay has none."""
    _, counts = _imported(spark, sf_dir)
    return spark.createDataFrame([(b, n, v) for b, c in counts.items() for n, v in c.items()], "batch string, name string, n long")


@query("split_counters", over_model("SELECT e.id, e.title, k.kept, k.dropped FROM event e, (SELECT count(*) FILTER (price_presale > 1000) AS kept, count(*) - count(*) FILTER (price_presale > 1000) AS dropped FROM event) k WHERE e.price_presale > 1000"))
def split_counters(spark, sf_dir):
    """One side of a split as it is written, and how large both sides were."""
    kept, seen = versions.split(Listings(spark, sf_dir).event, F.col("price_presale") > 1000)
    path = shared_folder(spark, "tables")
    kept.select("id", "title").write.parquet(path)
    return spark.read.schema("id long, title string").parquet(path).withColumns({n: F.lit(seen.get[n]) for n in ("kept", "dropped")})


@query("snapshot_tsv", over_model("SELECT s.slug || chr(9) || count(e.id) || chr(9) || coalesce(min(e.subtitle), '') AS line FROM event_source s LEFT JOIN event e ON e.event_source_id = s.id GROUP BY s.slug"))
def snapshot_tsv(spark, sf_dir):
    """Events per source, those without any too, as lines of a TSV file."""
    t = Listings(spark, sf_dir)
    per = t.event_source.select(F.col("id").alias("event_source_id"), "slug").join(t.event.select("event_source_id", "id", "subtitle"), "event_source_id", "left").groupBy("slug").agg(F.count("id").alias("n"), F.min("subtitle").alias("first"))
    path = shared_folder(spark, "tables")
    versions.export_tsv(per.orderBy("slug"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
