"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a hash of its id. A source of S words with a target of T takes each document
floor(T / S) times, and once more those whose hashes lie below a threshold that spends the rest
of the budget. The threshold is found from histograms of words by source and leading hash
digits: the bucket in which the running sum crosses the budget is refined by the next digits,
and within it the last digits decide. Thresholds nest: a larger budget keeps all that a smaller
one took. No document is sorted, and no source is gathered in one task: all keys hold the
leading digits beside the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import WORD, cut, fresh, tuned, with_columns

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken so many times at most.
REPEATS = 3
#: Hexadecimal digits of a hash, and of the two histograms' buckets.
DIGITS, FIRST, SECOND = 16, 3, 6


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with target, times (whole repeats) and rest (words beyond them).

    The words of all sources are shared out by weight; a source whose share exceeds repeats
    times its size stops there, and what it leaves is shared anew among the others. Sources in
    the order of size / weight make the stopped ones a prefix, so one pass of running sums finds
    them.
    """
    base = 1
    for w in set(weights):
        base *= w
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    ratio = F.expr(f"source_size * ({base} div weight)")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap", F.col("source_size") * repeats)
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("stopped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left"))
    everything = Window.partitionBy()
    left = F.col("total") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything)
    left_weight = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)
    share = (left * F.col("weight")).cast("double") / left_weight.cast("double")
    s = s.withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(share))
    s = s.withColumn("times", F.when(F.col("stopped"), repeats).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("rest", F.when(F.col("stopped"), 0.0).otherwise(F.col("target") - F.col("times") * F.col("source_size")))
    return s.select("source", "source_size", "target", "times", "rest")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """docs with size, source_size, target and taken added.

    size is the number of words (null text: 0); a null source is a source, the last. taken is
    size times the repeats the mix takes. Of the words that whole repeats leave, a source takes
    documents in the order of their hashes while the middle of a document lies below the
    budget, which ends within half a document of it. Rows that share an id share a hash and are
    taken alike; the result depends on ids, sizes and sources only, so reruns agree. An empty
    table gives an empty result; sources without words have target 0. Columns of docs that bear
    the new names give way.
    """
    spark = tuned(docs.sparkSession)
    size, src, h = (fresh(docs, c) for c in ("x_size", "x_source", "x_hash"))
    digest = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, DIGITS)
    sized = docs.select("*", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias(size), F.col(source_col).alias(src), digest.alias(h))
    # the words are counted once; later passes read three narrow columns
    base = cut(sized.select(F.col(src).alias("source"), F.col(size).alias("size"), F.col(h).alias("h"), F.substring(h, 1, FIRST).alias("b1")), "sizes")
    hist = cut(base.groupBy("source", "b1").agg(F.sum("size").alias("t")), "histogram")
    goal = targets(hist.groupBy("source").agg(F.sum("t").alias("source_size")), weights, repeats)

    # first histogram: each bucket's place in the running sum
    g, t = goal.alias("g"), hist.alias("t")
    first = t.join(g, F.expr("t.source <=> g.source")).select("t.source", "t.b1", "t.t", "source_size", "target", "times", "rest")
    order = Window.partitionBy("source").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("t").over(order), F.lit(0)))
    first = cut(first.withColumn("split", (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("t"))), "thresholds")

    # second histogram: the next digits, of the boundary buckets' rows only
    edge = first.filter("split").select("source", "b1", "before", "rest").alias("e")
    inner = base.alias("d").join(edge, F.expr("d.source <=> e.source AND d.b1 = e.b1")).select("d.source", "d.size", "d.h", "e.before", "e.rest")
    inner = inner.withColumn("b2", F.substring("h", 1, SECOND))
    order2 = Window.partitionBy("source").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    second = inner.groupBy("source", "b2", "before", "rest").agg(F.sum("size").alias("t")).withColumn("at", F.col("before") + F.coalesce(F.sum("t").over(order2), F.lit(0)))
    second = second.filter("at < rest AND rest < at + t").select("source", "b2", "at", "rest").alias("s")
    # last digits: within one second-level bucket of each source, by distinct hash
    order3 = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    last = inner.alias("i").join(second, F.expr("i.source <=> s.source AND i.b2 = s.b2")).groupBy("i.source", "i.h", "s.b2", "s.at", "s.rest").agg(F.sum("i.size").alias("t"))
    last = last.withColumn("seen", F.col("at") + F.coalesce(F.sum("t").over(order3), F.lit(0)))
    exact = last.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("seen") + F.col("t") / 2 < F.col("rest"), F.col("h"))), F.max("b2")).alias("limit"))
    # where no second-level bucket is split, the running sum meets the budget between two of them
    coarse = inner.groupBy("source", "b2", "before", "rest").agg(F.sum("size").alias("t")).withColumn("at", F.col("before") + F.coalesce(F.sum("t").over(order2), F.lit(0)))
    coarse = coarse.groupBy("source").agg(F.min(F.when(F.col("at") >= F.col("rest"), F.col("b2"))).alias("coarse"))

    e, c, f = exact.alias("e"), coarse.alias("c"), first.alias("f")
    limits = c.join(e, F.expr("c.source <=> e.source"), "left").select("c.source", F.coalesce("e.limit", "c.coarse", F.lit("g")).alias("limit")).alias("l")
    # one threshold for each source and first bucket: no key holds a whole source
    rule = f.join(limits, F.expr("f.source <=> l.source AND f.split"), "left").select(
        F.col("f.source").alias("r_source"), F.col("f.b1").alias("r_b1"), F.col("source_size").alias("r_size"), F.col("target").alias("r_target"), F.col("times").alias("r_times"),
        F.when(F.col("f.split"), F.col("l.limit")).when(F.col("before") < F.col("rest"), "g").otherwise("").alias("r_limit"),
    )
    b1 = fresh(docs, "x_b1")
    rows = sized.withColumn(b1, F.substring(h, 1, FIRST))
    out = rows.join(rule, rows[src].eqNullSafe(rule["r_source"]) & (rows[b1] == rule["r_b1"]))
    taken = F.col(size) * (F.col("r_times") + (F.col(h) <= F.col("r_limit")).cast("long"))
    new = {"size": F.col(size), "source_size": F.col("r_size"), "target": F.col("r_target"), "taken": taken}
    return with_columns(out, new, drop=(src, h, b1, size, "r_source", "r_b1", "r_size", "r_target", "r_times", "r_limit"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(3 * source_size) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights
    FROM s WINDOW w AS (ORDER BY source_size * (10 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (all_weight - weights) <= weight * (total - caps) AS stopped FROM o),
k AS (SELECT *, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE
    ((total - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()) * weight)::DOUBLE
    / (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
q AS (SELECT source, source_size, target, CASE WHEN stopped THEN 3 WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times, stopped FROM k),
r AS (SELECT *, CASE WHEN stopped THEN 0.0::DOUBLE ELSE target - times * source_size END AS rest FROM q),
g AS (SELECT source, h, sum(size) AS t FROM d GROUP BY source, h),
a AS (SELECT source, h, t, coalesce(sum(t) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM g)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (r.times + CASE WHEN a.seen + a.t / 2 < r.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN a ON d.source IS NOT DISTINCT FROM a.source AND d.h = a.h
"""


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
