"""Line-ups, genre tags and documents by example."""

import json

import pytest
from pyspark.sql import functions as F

from marquee.functions import billing, genres
from marquee.operators import documents


@pytest.mark.parametrize("name", ["TBA", "t.b.a.", "N.N.", "+ more", "more tba", "and many more", "Special Guest", "Support", "ACID AFTERSHOW", "Aftershow Party", "SHRED FEST", "36 Jahre Keller - Hoffest", "DJ-Set / late", "Guests", "Bohème Sauvage N°141", "GrooveJet Berlin"])
def test_no_acts(name):
    assert billing.is_no_act(name)


@pytest.mark.parametrize("name", ["More", "Green Lung", "AFTERHOURS", "Manifest", "Special Guest Foo", "Isolation Berlin", "Sommerfest", ""])
def test_acts(name):
    assert not billing.is_no_act(name)


@pytest.mark.parametrize(("name", "want"), [("HGICH.T LIVE", "HGICH.T"), ("THE BUTLERS - 40 YEARS, SKA -", "THE BUTLERS"), ("Avangelic (DJ-Set)", "Avangelic"), ("Acid Arab DJ-Set", "Acid Arab"), ("OCT (On Company Time) – Hochverlegung", "OCT (On Company Time)"), ("Tex singt Leonard Cohen", "Tex"), ("Hawt Coco Album Release", "Hawt Coco"), ("Sickboyrari (Black Kray)", "Sickboyrari (Black Kray)"), ("Live", "Live"), ("DZ - DEATHRAY", "DZ - DEATHRAY"), ("BAD COMPANY LEGACY - Dave Colwell", "BAD COMPANY LEGACY - Dave Colwell"), ("Ein Abend mit Anna", "Anna")])
def test_undecorated(name, want):
    assert billing.undecorated(name) == want


def test_splits():
    assert billing.support_acts("A & B, C and the D / E + F") == ["A", "B", "C and the D", "E", "F"]
    assert billing.conjoined("A (x & y) und B") == ["A (x & y)", "B"]
    assert billing.cut_title("A (x / y) / B") == ["A (x / y)", "B"] and billing.cut_title("A / B", slash=False) == ["A / B"]
    assert billing.supports_of("Opener: A + Special Guest: B") == ["A", "B"] and billing.supports_of("Tour 2026") == [] and billing.supports_of(None) == []


def test_lineups():
    names = lambda acts: [(a["name"], a["role"]) for a in acts]
    assert names(billing.headliners("Series #3: A + Support: B")) == [("A", "HEADLINER"), ("B", "SUPPORT")]
    assert names(billing.headliners("Night w/ A, B and many more", unpack_with=True)) == [("A", "HEADLINER"), ("B", "HEADLINER")]
    assert billing.headliners("aufnahme + wiedergabe - Fünfzehn Jahre") == []
    assert billing.lineup("A", "Support: B", "PARTY") == [] and billing.lineup("A", None, "SHOW") == [] and len(billing.lineup("A", "Support: B", "SHOW")) == 2


@pytest.mark.parametrize(("text", "want"), [("Pop Punk, Indie, Karaoke", ["Punk", "Indie", "Karaoke"]), ("Alternative / Indie", ["Alternative", "Indie"]), ("drum and bass", ["Drum & Bass"]), ("All kinds of Metal", ["Metal"]), ("from somewhere", []), ("Comedy", []), ("Techno disco floor", ["Techno"]), ("Schlager etc.", ["Schlager"]), ("Soul und Funk", ["Soul", "Funk"])])
def test_genre_tags(text, want):
    assert genres.tags(text) == want


def test_udfs_keep_nulls(spark):
    rows = spark.createDataFrame([("A & B", None), (None, None), ("", "Support: C")], "t string, s string")
    got = rows.select(billing.lineup_udf("t", "s", F.lit("CONCERT"))["name"].alias("a"), billing.is_no_act_udf("t").alias("n"), genres.tags_udf("t").alias("g")).collect()
    assert [r.a for r in got][:2] == [["A", "B"], []] and got[1].n is None and got[1].g is None


def test_documents(spark):
    rows = spark.sql("SELECT 1L AS id, 'a' AS slug, 'T \"x\"' AS title, NULL AS subtitle, 'READING' AS event_type, 'RELOCATED' AS status, DATE '2024-07-01' AS event_date, '20:00:00' AS start_time, CAST(NULL AS DECIMAL(10,2)) AS price_presale, CAST(NULL AS DECIMAL(10,2)) AS price_box_office, false AS free, false AS sold_out, 'V' AS venue_name, array('P') AS artists, cast(array() AS array<string>) AS promoters")
    doc = json.loads(documents.event_documents(rows, "https://x.org").first().document)
    assert doc["@type"] == "Event" and doc["name"] == 'T "x"' and doc["startDate"] == "2024-07-01T20:00:00+02:00" and doc["performer"][0]["name"] == "P"
    assert not {"offers", "organizer", "eventStatus", "description"} & set(doc)
    assert documents.event_documents(rows.withColumn("venue_name", F.lit(None).cast("string")), "x").first().document is None
