"""The listing model over the driver's star-schema tables: every property is a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day on which time-dependent queries stand.
AS_OF = "1998-06-01"

#: Columns of the tables, so that no file is opened to learn them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


class Listings:
    """Event listings below sf_dir. Nothing is read before an action; Catalyst prunes the columns
    that a query leaves out."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.tables = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        if name not in self.tables:
            read = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
            self.tables[name] = read.parquet(f"{self.dir}/{name}.parquet")
        return self.tables[name]

    @property
    def event(self) -> DataFrame:
        k = F.col("o_orderkey")
        price = F.col("o_totalprice").cast("decimal(10,2)")
        kind = F.substring("o_orderpriority", 1, 1)
        genres = F.array(*map(F.lit, ("Techno / House", "Pop Punk, Indie", "Jazz", "Alternative / Indie", "", None)))
        source = F.when(k % 17 == 0, None).otherwise(F.col("o_custkey") % 26)
        return self.raw("orders").select(
            k.alias("id"),
            F.col("o_custkey").alias("venue_id"),
            source.alias("event_source_id"),
            F.concat(F.lit("Night "), (k % 13).cast("string")).alias("title"),
            F.when(k % 4 == 0, F.concat(F.lit("with "), F.col("o_orderpriority"))).alias("subtitle"),
            F.when(kind == "2", "PARTY").when(kind == "3", "FESTIVAL").when(kind == "4", "OTHER").otherwise("CONCERT").alias("event_type"),
            F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("SCHEDULED").alias("status"),
            F.concat(F.lit("e-"), k.cast("string")).alias("slug"),
            F.col("o_orderdate").cast("date").alias("event_date"),
            F.when(k % 7 != 0, F.concat((k % 6 + 18).cast("string"), F.when(k % 2 == 0, ":00:00").otherwise(":30:00"))).alias("start_time"),
            F.when(k % 5 != 0, price).alias("price_presale"),
            F.when(k % 3 == 0, (price + 5).cast("decimal(10,2)")).alias("price_box_office"),
            F.when(k % 11 == 0, "Abendkasse").alias("price_note"),
            (k % 9 == 0).alias("sold_out"),
            (k % 29 == 0).alias("free"),
            F.get(genres, (k % 6).cast("int")).alias("genre"),
            F.concat(F.coalesce(source.cast("string"), F.lit("manual")), F.lit(":"), k.cast("string")).alias("source_id"),
        )

    @property
    def venue(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("c_mktsegment").alias("district"), F.lit("Berlin").alias("city"))

    @property
    def artist(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("a-"), F.col("p_partkey").cast("string")).alias("slug"))

    @property
    def event_artist(self) -> DataFrame:
        """One row per event and artist: the earliest place on the bill."""
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("artist_id")).agg(F.min("l_linenumber").alias("billing_order"))

    @property
    def promoter(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"))

    @property
    def event_promoter(self) -> DataFrame:
        return self.raw("lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("promoter_id")).distinct()

    @property
    def genre_tag(self) -> DataFrame:
        return self.raw("part").select(F.col("p_type").alias("name"), F.lower("p_type").alias("slug")).distinct()

    @property
    def genre_links(self) -> DataFrame:
        """(event_id, genre slug), from the first act of an event; links may repeat."""
        first = self.raw("lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("event_id"), "l_partkey")
        tags = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("genre_slug"))
        return first.join(tags, "l_partkey").select("event_id", "genre_slug")

    @property
    def event_genre_tag(self) -> DataFrame:
        return self.genre_links.distinct()

    def event_of(self, slug: str) -> DataFrame:
        """The event of a slug; the id in it prunes row groups and, through joins, links."""
        number = slug.removeprefix("e-")
        return self.event.filter((F.col("id") == int(number)) & (F.col("slug") == slug)) if number.isdecimal() else self.event.limit(0)

    @property
    def event_source(self) -> DataFrame:
        """Nations as sources, with the state of a scheduler."""
        k = F.col("n_nationkey")
        state = F.array(*map(F.lit, ("IDLE", "SUCCESS", "FAILED", "RUNNING", "MISCONFIGURED")))
        at = F.to_timestamp(F.lit(f"{AS_OF} 00:00:00"))
        return self.raw("nation").select(
            k.cast("long").alias("id"),
            F.lower("n_name").alias("slug"),
            (k % 8 != 7).alias("enabled"),
            F.get(state, k % 5).alias("status"),
            (k % 4).alias("retry_count"),
            F.lit(3).alias("max_retries"),
            F.lit(1440).alias("import_interval_minutes"),
            F.when(k % 6 != 5, F.timestamp_add("MINUTE", -k * 300, at)).alias("last_import_at"),
            F.when(k % 3 != 2, F.timestamp_add("HOUR", -k * 11, at)).alias("last_success_at"),
            F.col("n_regionkey").alias("group_key"),
        )

    @property
    def run_stats(self) -> DataFrame:
        """Coverage of one field by (source, run): the stream's types are sources, its days runs."""
        return self.raw("events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("observed_at")).agg(F.count(F.lit(1)).alias("events_total"), F.count_if(F.col("value") > 50).alias("events_with_value"))


#: The same model for DuckDB.
MODEL_SQL = f"""
event AS (SELECT o_orderkey AS id, o_custkey AS venue_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 26 END AS event_source_id,
    'Night ' || (o_orderkey % 13)::VARCHAR AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'with ' || o_orderpriority END AS subtitle,
    CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'PARTY' WHEN '3' THEN 'FESTIVAL' WHEN '4' THEN 'OTHER' ELSE 'CONCERT' END AS event_type,
    CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'SCHEDULED' END AS status, 'e-' || o_orderkey::VARCHAR AS slug, o_orderdate::DATE AS event_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 6 + 18)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN ':00:00' ELSE ':30:00' END END AS start_time,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice::DECIMAL(10,2) END AS price_presale,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice::DECIMAL(10,2) + 5)::DECIMAL(10,2) END AS price_box_office,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Abendkasse' END AS price_note, o_orderkey % 9 = 0 AS sold_out, o_orderkey % 29 = 0 AS free,
    ['Techno / House', 'Pop Punk, Indie', 'Jazz', 'Alternative / Indie', '', NULL][o_orderkey % 6 + 1] AS genre,
    coalesce((CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 26 END)::VARCHAR, 'manual') || ':' || o_orderkey::VARCHAR AS source_id FROM orders),
venue AS (SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '-')) AS slug, c_mktsegment AS district, 'Berlin' AS city FROM customer),
artist AS (SELECT p_partkey AS id, p_name AS name, 'a-' || p_partkey::VARCHAR AS slug FROM part),
event_artist AS (SELECT l_orderkey AS event_id, l_partkey AS artist_id, min(l_linenumber) AS billing_order FROM lineitem GROUP BY ALL),
promoter AS (SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug FROM supplier),
event_promoter AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS promoter_id FROM lineitem WHERE l_linenumber = 2),
genre_tag AS (SELECT DISTINCT p_type AS name, lower(p_type) AS slug FROM part),
event_genre_tag AS (SELECT DISTINCT l_orderkey AS event_id, lower(p_type) AS genre_slug FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1),
event_source AS (SELECT n_nationkey::BIGINT AS id, lower(n_name) AS slug, n_nationkey % 8 <> 7 AS enabled,
    ['IDLE', 'SUCCESS', 'FAILED', 'RUNNING', 'MISCONFIGURED'][n_nationkey % 5 + 1] AS status, n_nationkey % 4 AS retry_count, 3 AS max_retries, 1440 AS import_interval_minutes,
    CASE WHEN n_nationkey % 6 <> 5 THEN TIMESTAMP '{AS_OF}' - to_minutes(n_nationkey * 300) END AS last_import_at,
    CASE WHEN n_nationkey % 3 <> 2 THEN TIMESTAMP '{AS_OF}' - to_hours(n_nationkey * 11) END AS last_success_at, n_regionkey AS group_key FROM nation),
run_stats AS (SELECT event_type AS source, ts::DATE AS observed_at, count(*) AS events_total, count(*) FILTER (WHERE value > 50) AS events_with_value FROM events GROUP BY ALL)
"""


def over_model(sql: str) -> str:
    """DuckDB SQL over the model: sql is a SELECT, or CTEs (starting with a comma) and a SELECT."""
    return f"WITH {MODEL_SQL}{sql}"
