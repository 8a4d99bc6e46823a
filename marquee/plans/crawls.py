"""Queries of archived crawls: pages in several charsets, and those that have changed since the last crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.plans.registry import query
from marquee.sources import elements, responses
from marquee.sources.shared import shared_folder
from marquee.sources.tables import Listings


def _crawl(orders, number):
    """A crawl of a page per order. In the second, some are not modified, some fail and some have new tags."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("<html><h1>Größe Nr. "), k.cast("string"), F.lit(f"</h1><p>Crawl {number}</p></html>"))
    meta = F.replace(text, F.lit("<html>"), F.lit('<html><meta charset="iso-8859-1">'))
    body = F.when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 1, F.encode(text, "ISO-8859-1")).when(k % 4 == 2, F.encode(text, "UTF-16")).otherwise(F.encode(meta, "ISO-8859-1"))
    second = number == 2
    status = F.when(F.lit(second) & (k % 10 == 9), 304).when(F.lit(second) & (k % 10 == 8), 503).otherwise(200)
    tag = F.when(k % 5 < 3, F.concat(F.lit('"'), (k % 100).cast("string"), F.when(F.lit(second) & (k % 7 == 0), "-new").otherwise(""), F.lit('"')))
    day = F.when(F.lit(second) & (k % 3 == 0), F.date_add(F.col("o_orderdate").cast("date"), 1)).otherwise(F.col("o_orderdate").cast("date"))
    return orders.filter(F.lit(second) | (k % 13 != 0)).select(
        F.concat(F.lit("https://v.example/"), k.cast("string")).alias("url"), status.cast("int").alias("status"), tag.alias("etag"), F.when(k % 5 != 4, day.cast("string")).alias("last_modified"),
        F.when(k % 4 == 1, "text/html; charset=ISO-8859-1").when(k % 4 != 3, "text/html").alias("content_type"), F.when(status == 200, body).alias("body"),
    )


def _archived(spark, sf_dir):
    path, orders = shared_folder(spark, "crawls"), Listings(spark, sf_dir).raw("orders")
    for number in (1, 2):
        responses.archive(_crawl(orders, number), path, number)
    return responses.read(spark, path)


@query("decoded_pages", "SELECT 'https://v.example/' || o_orderkey AS url, 'Größe Nr. ' || o_orderkey AS heading FROM orders WHERE o_orderkey % 13 <> 0")
def decoded_pages(spark, sf_dir):
    """Headings of archived pages in three charsets, told by header, mark, page or not at all."""
    pages = responses.with_text(_archived(spark, sf_dir).filter("crawl = 1"))
    return elements.picked(pages, "h1", {"heading": ("", "text")}, key="url", html="page").select("url", "heading")


@query("changed_pages", """SELECT 'https://v.example/' || k AS url, 'Crawl 2' AS said FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 10 NOT IN (8, 9)
    AND NOT (k % 13 <> 0 AND CASE WHEN k % 5 < 3 THEN k % 7 <> 0 WHEN k % 5 = 3 THEN k % 3 <> 0 ELSE false END)""")
def changed_pages(spark, sf_dir):
    """What a second crawl finds changed: new tags, later dates, neither of both, and addresses not known before."""
    found = _archived(spark, sf_dir)
    pages = responses.with_text(responses.changed(found.filter("crawl = 2"), found.filter("crawl = 1")))
    return elements.picked(pages, "p", {"said": ("", "text")}, key="url", html="page").select("url", "said")
