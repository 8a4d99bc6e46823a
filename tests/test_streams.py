"""Import sources' states: the stream against a replay of the same runs, over batches and restarts."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.operators.versions import Table
from marquee.streaming import gauges, runs

MINUTE = 60_000_000


def drawn_runs(seed, n=400, sources=7):
    rng = random.Random(seed)
    at, rows = 1_700_000_000_000_000, []
    for i in range(n):
        at += rng.choice([0, 1, rng.randrange(20 * MINUTE)])
        rows.append((f"s{rng.randrange(sources)}", at, i, rng.choice(["claim", "claim", *runs.KINDS]), rng.randrange(9), rng.choice([None, "x" * 2_000, "broken"])))
    return rows


RUNS = "source string, at_us long, seq long, kind string, n_events long, error string"


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(rows, until):
    """The machine by plain dictionaries."""
    out, states = [], {}
    for source, at, _, kind, n, error in sorted(rows, key=lambda r: r[1:3]):
        s = states.setdefault(source, {"status": "IDLE", "retry": 0, "import": None, "success": None, "count": None, "error": None})
        late(out, source, s, at - 1)
        taken = not (kind == "claim" and s["status"] == "RUNNING")
        if kind == "claim" and taken:
            s |= {"status": "RUNNING", "import": at, "error": None}
        elif kind in ("success", "not_modified"):
            s |= {"status": "SUCCESS", "retry": 0, "import": at, "success": at, "count": n if kind == "success" else 0, "error": None}
        elif kind in ("failed", "misconfigured"):
            s |= {"status": kind.upper(), "retry": s["retry"] + (kind == "failed"), "import": at, "error": (error or "Unknown error during import")[:1000]}
        elif kind == "retry":
            s |= {"status": "IDLE", "retry": 0, "error": None}
        out.append((source, at, kind, taken, *s.values()))
    for source, s in states.items():
        late(out, source, s, until)
    return sorted(out, key=repr)


def late(out, source, s, now):
    if s["status"] == "RUNNING" and s["import"] + 30 * MINUTE <= now:
        s |= {"status": "FAILED", "retry": s["retry"] + 1, "error": runs.TIMED_OUT}
        out.append((source, s["import"] + 30 * MINUTE, "timeout", True, *s.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_replay(spark, seed):
    rows = drawn_runs(seed)
    until = rows[-1][1] - 10 * MINUTE
    assert told(runs.replayed(spark.createDataFrame(rows, RUNS).repartition(5), until)) == plain(rows, until)


def test_replay_of_odd_tables(spark):
    assert runs.replayed(spark.createDataFrame([], RUNS)).count() == 0
    with pytest.raises(Exception, match="no such kind"):
        runs.replayed(spark.createDataFrame([("a", 1, 1, "pause", None, None)], RUNS)).collect()


def test_stream_over_restarts(spark, tmp_path):
    """Four files, the stream stopped and started anew between them: the same as one replay, up to the
    watermark."""
    rows = drawn_runs(3)
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    before = spark.conf.get(runs.PROVIDER, None)
    schema = spark.createDataFrame([], RUNS).schema
    try:
        for i in range(4):
            part = rows[i * 100 : i * 100 + 100]
            random.Random(i).shuffle(part)
            spark.createDataFrame(part, RUNS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_micros("at_us")).withWatermark("ts", "10 minutes")
            runs.streamed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(runs.PROVIDER)
        else:
            spark.conf.set(runs.PROVIDER, before)
    # the watermark counts milliseconds
    until = (rows[-1][1] // 1_000 - 600_000) * 1_000
    assert told(spark.read.parquet(out)) == plain(rows, until)


def test_rows_of_a_source_are_sorted_in_parts(monkeypatch):
    """The same order from files as from memory, and never more than a part of the rows at a time."""
    rng = random.Random(9)
    rows = [(rng.randrange(50), rng.choice([1, 2]), rng.choice(runs.KINDS), rng.choice([None, i]), rng.choice([None, f"e{i}"])) for i in range(997)]
    frames = [pd.DataFrame(rows[i : i + 10], columns=["at_us", "seq", "kind", "n_events", "error"]) for i in range(0, 997, 10)]
    want = [(at, kind, n, error) for at, _, kind, n, error in sorted(rows, key=lambda r: r[:2])]
    assert list(runs.in_order(iter(frames))) == want and list(runs.in_order([])) == []
    most, concat = [], pd.concat
    monkeypatch.setattr(runs, "SORTED", 100)
    monkeypatch.setattr(runs, "CHUNK", 7)
    monkeypatch.setattr(runs.pd, "concat", lambda x: most.append(sum(map(len, x := list(x)))) or concat(x))
    assert list(runs.in_order(iter(frames))) == want and max(most) == 100


def test_gauges_after_each_batch(spark, tmp_path):
    """Several micro-batches over restarts, and a batch that is merged again."""
    rng = random.Random(5)
    path = f"file://{tmp_path}"
    table = Table(spark, f"{path}/table", gauges.SCHEMA, "region", ["source"])
    sources = spark.createDataFrame([(i, f"s{i}", ("north", "south")[i % 2]) for i in range(6)], "source_id int, source string, region string")
    schema, rows = "source_id int, value double, ts timestamp", []
    for n in range(3):
        new = [(rng.choice([None, *range(8)]), rng.choice([None, rng.random() * 100]), datetime.datetime(2026, 1, 1 + n, rng.randrange(24))) for _ in range(40 if n else 3)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        gauges.keep(stream, sources, table, "g", f"{path}/state").awaitTermination()
        want = gauges.gauges(spark.createDataFrame(rows, schema), sources)
        assert told(table.read()) == told(want.select(*table.columns))
    before = table.version()
    gauges.merger(table, "g")(table.read().withColumn("events", F.lit(0).cast("long")), 0)
    assert table.version() == before and told(table.read()) == told(want.select(*table.columns))
