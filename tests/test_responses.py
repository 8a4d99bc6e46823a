"""Archived responses: round trips, crawls that failed, streams over restarts, charsets, changes."""

import os

from pyspark.sql import functions as F

from marquee.sources import elements, responses

COLUMNS = "url string, status int, etag string, last_modified string, content_type string, body binary"


def rows_of(df):
    return sorted(((r.crawl, r.url, r.status, r.etag, r.last_modified, r.content_type, None if r.body is None else bytes(r.body)) for r in df.collect()), key=repr)


def crawl(n):
    return [(f"u{i}", [200, 304, None][i % 3], [None, f'"{i}"'][i % 2], [None, "Mon, 1"][i % 2], [None, "text/html"][i % 2], [None, b"", b"\n{}\n" * (i % 5), os.urandom(70_000 * (i % 2))][i % 4]) for i in range(n)]


def test_round_trip(spark, tmp_path):
    path, rows = f"file://{tmp_path}/a", {1: crawl(23), 2: crawl(5), 3: []}
    for number, found in rows.items():
        responses.archive(spark.createDataFrame(found, COLUMNS).repartition(4), path, number)
    # what a task that failed has left is named by no manifest
    (tmp_path / "a" / "2-dead.segment").write_bytes(b"{")
    want = sorted(((number, *r) for number, found in rows.items() for r in found), key=repr)
    assert rows_of(responses.read(spark, path)) == want
    responses.archive(spark.createDataFrame(rows[2][:2], COLUMNS), path, 2)  # written again
    assert responses.read(spark, path).filter("crawl = 2").count() == 2
    assert responses.read(spark, f"file://{tmp_path}/none").count() == 0


def test_stream_takes_each_crawl_once(spark, tmp_path):
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("a", "out", "state"))
    want = []
    for number in (1, 2, 3):
        found = crawl(4 * number)
        responses.archive(spark.createDataFrame(found, COLUMNS), path, number)
        want += [(number, *r) for r in found]
        responses.read(spark, path, stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert rows_of(spark.read.schema(responses.SCHEMA).parquet(out)) == sorted(want, key=repr)


def test_changes(spark):
    known = spark.createDataFrame([("a", '"1"', None), ("b", None, "Mon"), ("c", '"1"', "Mon"), ("d", None, None), ("e", '"1"', "Mon")], "url string, etag string, last_modified string")
    found = [("a", 200, '"1"', "Tue"), ("b", 200, None, "Mon"), ("c", 200, '"2"', "Mon"), ("d", 200, None, None), ("e", 200, None, "Mon"), ("f", 200, None, None), ("a", 304, None, None), ("a", 500, None, None), (None, 200, None, None)]
    got = responses.changed(spark.createDataFrame(found, "url string, status int, etag string, last_modified string"), known).collect()
    assert sorted(r.url or "" for r in got) == ["", "c", "d", "f"]


def test_texts(spark):
    word = "Größe €"
    cases = [(word.encode("utf-8-sig"), "text/html; charset=ISO-8859-1"), (word.encode("utf-16"), None), (word.encode("cp1252"), "text/html; charset=windows-1252"), (b'<meta charset="windows-1252">' + word.encode("cp1252"), ""), (word.encode(), "charset=nonsense"), (b"", None), (None, None), (b"\xff\xfe", None)]
    found = responses.with_text(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, body binary, content_type string")).orderBy("i")
    assert [(r.page or "").removeprefix('<meta charset="windows-1252">') if r.page is not None else None for r in found.collect()] == [word, word, word, word, word, "", None, ""]
    assert elements.decoded(word.encode("utf-16-be"), "text/html; charset=utf-16be") == word
    assert found.filter(F.col("page").isNull()).count() == 1
