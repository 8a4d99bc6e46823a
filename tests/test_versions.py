"""Versioned tables: replays, failures, conflicts, odd partitions; observed splits."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import versions

SCHEMA = "part string, id long, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return versions.Table(spark, f"file://{tmp_path}/t", SCHEMA, "part", ["id"])


def test_saves_and_replays(spark, table):
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert table.version() == 0 and table.read().count() == 0 and table.read().columns == ["part", "id", "v"]
    assert table.save(frame(("a", 1, "x"), ("a", 2, None), ("b/ü=", 1, "y"), (None, None, "z")), "1") == {"inserted": 4, "updated": 0, "skipped": 0}
    before = table.manifest()["parts"]
    assert table.save(frame(("a", 1, "x"), ("a", 2, "new"), ("a", 3, "w"), ("", None, "z")), "2") == {"inserted": 1, "updated": 1, "skipped": 2}
    want = [("", None, "z"), ("a", 1, "x"), ("a", 2, "new"), ("a", 3, "w"), ("b/ü=", 1, "y")]
    assert rows_of(table.read()) == want and rows_of(table.read(only=["b/ü="])) == [("b/ü=", 1, "y")]
    # a replay changes nothing, and partitions that no row touched keep their folders
    assert table.save(frame(("a", 1, "other")), "2") == {} and table.version() == 2 and rows_of(table.read()) == want
    assert table.manifest()["parts"]["b/ü="] == before["b/ü="] and table.manifest()["parts"]["a"] != before["a"]
    assert rows_of(table.read(1)) == [("", None, "z"), ("a", 1, "x"), ("a", 2, None), ("b/ü=", 1, "y")]
    assert table.delete(frame(("a", 1, None), ("a", 9, None), ("b/ü=", 1, None)), "3") == {"deleted": 2, "kept": 2}
    assert rows_of(table.read()) == [("", None, "z"), ("a", 2, "new"), ("a", 3, "w")] and sorted(table.manifest()["parts"]) == ["", "a"]
    assert table.save(frame(), "4") == {"inserted": 0, "updated": 0, "skipped": 0} and table.version() == 4


def test_a_failed_write_leaves_the_old_version(spark, table):
    table.save(spark.createDataFrame([("a", 1, "x")], SCHEMA), "1")
    broken = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z")], SCHEMA).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.save(broken, "2")
    assert table.version() == 1 and rows_of(table.read()) == [("a", 1, "x")]
    assert table.save(spark.createDataFrame([("a", 2, "y")], SCHEMA), "2")["inserted"] == 1
    assert rows_of(table.read()) == [("a", 1, "x"), ("a", 2, "y")]


def test_of_two_writers_one_wins(spark, table, monkeypatch):
    table.save(spark.createDataFrame([("a", 1, "x")], SCHEMA), "1")
    other = versions.Table(spark, table.path, SCHEMA, "part", ["id"])
    publish = table._publish

    def late(manifest, version):
        other.save(spark.createDataFrame([("a", 2, "y")], SCHEMA), "other")
        publish(manifest, version)

    monkeypatch.setattr(table, "_publish", late)
    with pytest.raises(versions.Conflict):
        table.save(spark.createDataFrame([("a", 1, "lost")], SCHEMA), "2")
    assert rows_of(other.read()) == [("a", 1, "x"), ("a", 2, "y")]


def test_splits_are_counted_once(spark, tmp_path):
    rows = spark.range(100).withColumn("odd", F.when(F.col("id") < 90, F.col("id") % 2 == 1))
    kept, seen = versions.split(rows, F.col("odd"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1
    kept.write.parquet(f"{tmp_path}/kept")
    assert seen.get == {"kept": 45, "dropped": 55} and spark.read.parquet(f"{tmp_path}/kept").count() == 45


def test_tsv(spark, tmp_path):
    versions.export_tsv(spark.createDataFrame([("a b", 1, None), ("ü\"q", None, ""), ("c", 2, "x")], "a string, b int, c string").coalesce(1), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["a b\t1\t", '"ü\\"q"\t\t', "c\t2\tx"]
