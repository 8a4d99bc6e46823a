"""Fields of scraped records by example, and what edge values give."""

from pyspark.sql import functions as F

from marquee.functions import records
from marquee.streaming import windows


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles(spark):
    clean = {
        "Iggi Kelly Nachholtermin vom 28.04.26-": "Iggi Kelly", "Luna Simao (verschoben aus 2026)": "Luna Simao", "Singalong -Das Mitsing-Event (ausverkauft)": "Singalong -Das Mitsing-Event",
        "Adventurous Juan  (DJ-Set)": "Adventurous Juan (DJ-Set)", "Wer singt dann Lieder?": "Wer singt dann Lieder?", "The Adicts": "The Adicts", " ​-": "-", "": "",
    }
    assert {k: first(spark, records.clean_title(F.lit(k))) for k in clean} == clean
    moved = {"-verlegt in den Frannz Club – CULTURE WARS": "CULTURE WARS", "Verlegt ins Bi Nuu – BRKN": "BRKN", "HOUSE OF PROTECTION": "HOUSE OF PROTECTION", "verlegt ins Bi Nuu – ": "verlegt ins Bi Nuu –"}
    assert {k: first(spark, records.without_move(F.lit(k))) for k in moved} == moved


def test_times(spark):
    assert [first(spark, records.time_of(F.lit(x))) for x in (" 19:00 ", "24:00", "9:00", "TBA", None)] == ["19:00:00", None, None, None, None]
    assert [str(first(spark, records.iso_date(F.lit(x)))) for x in ("2026-05-16T20:00", "2026-05-16", "2026-02-30", "invalid")] == ["2026-05-16", "2026-05-16", "None", "None"]
    assert [first(spark, records.iso_time(F.lit(x))) for x in ("2026-05-16T20:00", "2026-05-16", "2026-05-16T20:00:00")] == ["20:00:00", None, None]
    assert str(first(spark, records.real_date(F.lit("2026-07-08 19:00:00 +0200")))) == "2026-07-08"
    for doors, start in (("19:30", "19:00"), ("19:00", "19:30")):
        assert tuple(first(spark, x) for x in records.in_order(F.lit(doors), F.lit(start))) == ("19:00", "19:30")
    assert tuple(first(spark, x) for x in records.in_order(F.lit(None).cast("string"), F.lit("20:00"))) == (None, "20:00")


def test_weekends(spark):
    days = {"2026-11-25": ("2026-11-27", "2026-11-29"), "2026-11-27": ("2026-11-27", "2026-11-29"), "2026-11-29": ("2026-11-29", "2026-11-29")}
    for day, want in days.items():
        assert tuple(str(first(spark, x)) for x in records.weekend(F.lit(day).cast("date"))) == want


def test_labels(spark):
    assert first(spark, records.humanised(F.lit("CLUB_NIGHT"))) == "Club night" and first(spark, records.camel(F.lit("MISSING_START_TIME"))) == "missingStartTime"
    assert [first(spark, records.labelled(F.lit(t), F.lit(v))) for t, v in (("A", "B"), ("A", None), ("", "B"), (None, None))] == ["A @ B", "A", "B", ""]
    assert [first(spark, records.district_label(F.lit(x))) for x in ("neukoelln", "elsewhere", None)] == ["Neukölln", "elsewhere", ""]


def test_replayed_batches_do_not_repeat(spark, tmp_path):
    """A batch that is written again, as after a failure, leaves its rows once."""
    append, complete = windows.writer(f"{tmp_path}/a", "append"), windows.writer(f"{tmp_path}/c", "complete")
    for number, rows in ((0, 5), (1, 3), (1, 3)):
        append(spark.range(rows), number)
        complete(spark.range(rows), number)
    assert spark.read.parquet(f"{tmp_path}/a/rows").count() == 8 and spark.read.parquet(f"{tmp_path}/c/rows").count() == 3
