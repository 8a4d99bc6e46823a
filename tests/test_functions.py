"""Text functions and page readers by example, and laws of the import operators."""

import pytest
from comparing import differences
from pyspark.sql import functions as F

from marquee.functions import classify, genres, names
from marquee.operators import quality, search, upsert
from marquee.plans import catalog
from marquee.plans.importing import scraped
from marquee.plans.searching import TODAY
from marquee.sources import pages
from marquee.sources.tables import AS_OF, Listings


@pytest.mark.parametrize(("name", "want"), [("THE KNIFE", "The Knife"), ("DJ KOZE", "DJ Koze"), ("M", "M"), ("MC 900", "MC 900"), ("A.B.C", "A.B.C"), ("oxo 86", "Oxo 86"), ("  Moderat ", "Moderat"), ("ÄRZTE", "Ärzte")])
def test_artist(name, want):
    assert names.artist(name) == want


@pytest.mark.parametrize(("name", "want"), [("Trinty Concerts GmbH", "Trinity"), ("Landstreicher Booking", "Landstreicher"), ("LOFT (Berlin)", "Loft Concerts"), ("Concerts", "Concerts"), ("36 Concerts", "36 Concerts")])
def test_promoter(name, want):
    assert names.promoter(name) == want


def test_promoterless_names():
    assert names.is_no_promoter("Concerts GmbH") and names.is_no_promoter(" ") and not names.is_no_promoter("Loft GmbH")


def test_genres():
    assert genres.tags("Pop Punk, Indie, Karaoke") == ["Punk", "Indie", "Karaoke"]
    assert genres.tags("Alternative / Indie und indie etc.") == ["Alternative", "Indie"]


def test_slug():
    assert names.slug("Žižkov Straße: Smørrebrød!") == "zizkov-strasse-smorrebrod"


def test_names_on_spark(spark):
    rows = spark.createDataFrame([("THE KNIFE",), (None,), ("THE KNIFE",)], "name string")
    assert [r.n for r in rows.select(names.artist_udf("name").alias("n")).collect()] == ["The Knife", None, "The Knife"]


def test_columns(spark):
    one = spark.range(1).select(
        classify.price_of(F.lit("VVK: 12,5 €")).alias("p"), classify.price_of(F.lit("frei")).alias("q"), classify.german_date(F.lit("29.2.2023")).alias("d"), classify.german_date(F.lit("1.3.24"), True).alias("s"), classify.month_of(F.lit(" März.")).alias("m"),
        classify.inferred_date(F.lit(2), F.lit(29), F.lit(None).cast("int"), "1998-06-01").alias("leap"), classify.type_of_label(F.lit(" Konzert ")).alias("t"), classify.resolved_type(F.lit("CONCERT"), F.lit("Summer Festival"), F.lit(None).cast("string")).alias("r"),
        classify.status_of_schema(F.lit("https://schema.org/EventRescheduled")).alias("st"),
    ).first()
    assert (str(one.p), one.q, one.d, str(one.s), one.m, str(one.leap), one.t, one.r, one.st) == ("12.50", None, None, "2024-03-01", 3, "2000-02-29", "CONCERT", "FESTIVAL", "POSTPONED")


def test_pages():
    page = '<html><head><title> A &amp; B </title><script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "x"}]}</script><script type="application/ld+json">{broken</script></head><body><h1>Hi<br>there</h1><p>one</p><script>no</script><a href="/z">link</a></body></html>'
    assert pages.fields(page) == ("A & B", "Hithere", 1, 4)
    assert pages.fields(None) == (None, None, 0, 0)
    assert [x["name"] for x in pages.json_ld(page)] == ["x"]


def test_pages_match_sql(spark, tmp_path):
    """References without a semicolon, unknown and doubled ones, and blanks that HTML does not know."""
    odd = ["A &amp;&amp; B&amp", "&amp;lt; &lt;b&gt; &quot;", "&copy; &#65; &eacute;&", "\u00a0x\u00a0y\u3000", "&nbsp;", " \t ", "x\u000by\u001fz"]
    made = [(i, f'<html><title>{t}</title><h1>{t}</h1><p>{t}</p><a href="{t if i % 2 else ""}">l</a></html>') for i, t in enumerate(odd)]
    spark.createDataFrame(made, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    sql = catalog.ORACLES["html_extract"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert not differences(catalog.QUERIES["html_extract"](spark, str(tmp_path)), sql, str(tmp_path / "none"))


def test_import_twice_changes_nothing(spark, sf_dir):
    t = Listings(spark, sf_dir)
    columns = ["title", "event_date", "start_time", "price_presale", "sold_out"]
    once = upsert.upserted(t.event, scraped(t), columns, AS_OF)
    fresh = upsert.deduplicated(upsert.upcoming(scraped(t), AS_OF))
    assert upsert.changes(fresh, once, columns).filter("op <> 'SKIP'").count() == 0
    assert upsert.stale(once, fresh, AS_OF).count() == 0


def test_guards(spark, sf_dir):
    t = Listings(spark, sf_dir)
    with pytest.raises(ValueError, match="before"):
        search.calendar(t, TODAY, TODAY.replace(year=1997))
    with pytest.raises(ValueError, match="92"):
        search.calendar(t, TODAY, TODAY.replace(month=9))
    with pytest.raises(ValueError, match="unknown issue"):
        quality.worklist(t, "nonsense")


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    t = Listings(spark, sf_dir)
    plan = search.search(t, search.Facets(genre="economy"), TODAY).select("id", "title")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]
    plan = search.page(search.search(t, search.Facets(), TODAY).select("id", "event_date", "start_time"), search.ordering())._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
