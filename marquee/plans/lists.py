"""Queries of lists, markup as text, counts for dashboards and replaced links."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import lists
from marquee.operators import upsert
from marquee.plans.registry import query
from marquee.sources.tables import AS_OF, Listings, over_model

_LINES = ", l AS (SELECT l_orderkey AS id, list(l_quantity::INT ORDER BY l_linenumber, l_quantity::INT) AS q FROM lineitem GROUP BY 1)"


@query("leading_lines", over_model(f"{_LINES} SELECT id, array_to_string(q[:n], ',') AS taken, array_to_string(q[n + 1:], ',') AS dropped FROM (SELECT id, q, coalesce(list_position(list_transform(q, lambda x: x > 15), false), len(q) + 1) - 1 AS n FROM l)"))
def leading_lines(spark, sf_dir):
    """Lines of an order up to the first small one, and from it on."""
    rows = Listings(spark, sf_dir).raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    q = F.transform("x", lambda x: x["q"])
    cut = lambda f: F.array_join(f(q, lambda x: x > 15).cast("array<string>"), ",")
    return rows.select("id", cut(lists.take_while).alias("taken"), cut(lists.drop_while).alias("dropped"))


@query("last_of_each_flag", over_model("SELECT l_orderkey AS id, string_agg(x, ',' ORDER BY l_linenumber, q, x) AS kept FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_returnflag || l_quantity::INT AS x FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_quantity::INT DESC) = 1) GROUP BY 1"))
def last_of_each_flag(spark, sf_dir):
    """Of an order's lines with one flag the last, in order."""
    member = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("flag"))
    rows = Listings(spark, sf_dir).raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(member)).alias("x"))
    kept = lists.last_by(F.col("x"), lambda m: m["flag"])
    return rows.select("id", F.array_join(F.transform(kept, lambda m: F.concat(m["flag"], m["q"].cast("string"))), ",").alias("kept"))


@query("markup_as_text", "SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN 'Tom & ' || event_type || ' <' || user_id || '> „ü' END AS text FROM events")
def markup_as_text(spark, sf_dir):
    """Character references, tags, breaks, scripts and blanks in markup."""
    k = F.col("event_id")
    markup = F.concat(F.lit("<p>Tom&nbsp;&amp;<script>no()</script>\n <b>"), "event_type", F.lit("</b><br>&lt;"), F.col("user_id").cast("string"), F.lit("&#62; &bdquo;&#xFC;</p>"))
    return Listings(spark, sf_dir).raw("events").select("event_id", lists.text_of(F.when(k % 6 != 5, markup)).alias("text"))


@query("source_counts", over_model("SELECT status, count(*) AS n, count(*) FILTER (enabled) AS enabled, max(last_success_at) AS last_success, min(last_import_at) AS first_import FROM event_source GROUP BY 1"))
def source_counts(spark, sf_dir):
    """Sources by state: all, enabled ones, the latest success and the earliest import."""
    sources = Listings(spark, sf_dir).event_source
    return sources.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("enabled"), F.max("last_success_at").cast("timestamp_ntz").alias("last_success"), F.min("last_import_at").cast("timestamp_ntz").alias("first_import"))


@query("event_counts", over_model(f"""SELECT h AS horizon, count(*) FILTER (event_date >= DATE '{AS_OF}' AND event_date < DATE '{AS_OF}' + h::INT) AS n, (SELECT count(*) FROM event WHERE event_date >= DATE '{AS_OF}') AS future, (SELECT count(*) FROM event) AS total
    FROM event, (SELECT unnest([1, 7, 30, 365]) AS h) GROUP BY 1"""))
def event_counts(spark, sf_dir):
    """Events within days from now, all to come and all there are, in one pass over the events."""
    today, day = F.lit(AS_OF).cast("date"), F.col("event_date")
    counts = {str(h): F.count_if((day >= today) & (day < F.date_add(today, h))).alias(str(h)) for h in (1, 7, 30, 365)}
    one = Listings(spark, sf_dir).event.agg(*counts.values(), F.count_if(day >= today).alias("future"), F.count(F.lit(1)).alias("total"))
    wide = F.explode(F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.col(f"`{h}`").alias("n")) for h in counts])).alias("x")
    return one.select(wide, "future", "total").select("x.horizon", "x.n", "future", "total")


@query("replaced_links", over_model("""SELECT event_id, artist_id, billing_order FROM event_artist WHERE event_id % 3 <> 0 UNION ALL SELECT DISTINCT event_id, artist_id + 1, 0 FROM event_artist WHERE event_id % 6 = 0"""))
def replaced_links(spark, sf_dir):
    """The links of the events that an editor saves, replaced as a whole; of some nothing is left."""
    links = Listings(spark, sf_dir).event_artist
    new = links.filter("event_id % 6 = 0").select("event_id", (F.col("artist_id") + 1).alias("artist_id"), F.lit(0).alias("billing_order")).distinct()
    return upsert.replaced(links, new, links.filter("event_id % 3 = 0").select("event_id"), ["event_id"])


@query("billing_order", """SELECT p_partkey AS id, (n - 1)::INT AS place, names[n] AS name, CASE WHEN n = 1 THEN 'HEADLINER' ELSE 'SUPPORT' END AS role FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS names, unnest(range(1, len(string_split(p_name || ' ' || p_type, ' ')) + 1)) AS n FROM part)""")
def billing_order(spark, sf_dir):
    """Members of a list by their place: the first leads the bill."""
    names = F.split(F.concat("p_name", F.lit(" "), "p_type"), " ")
    rows = Listings(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.posexplode(names).alias("place", "name"))
    return rows.withColumn("role", F.when(F.col("place") == 0, "HEADLINER").otherwise("SUPPORT"))
