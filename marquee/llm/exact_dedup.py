"""Exact duplicates through an extendible-hash index on shared files.

A row's slot is the 64-bit hash of its text. The directory maps the leading bits of a slot to a
bucket: it starts with one bucket and doubles whenever a bucket that holds too many slots is as
deep as the directory itself; a shallower bucket merely splits. Each bucket is a range of keys, and
owner tasks are dealt buckets by their numbers, one each. The owner walks its sorted keys and keeps
a chain of different texts for each key, comparing bytes, so that texts whose hashes collide stay
apart. Its entries are written to shared files, one folder per bucket.

Only keys that occur more than once travel with their texts: a first pass counts keys without
texts. Copies are merged where they are read, before they move (at most SALTS rows of each text
reach its owner), so a text that fills a third of the table costs its owner a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import attach, cut, fresh, shared_dir, tuned, with_columns

#: Slots that a bucket may hold before it splits, the fewest bits by which slots are counted, and
#: the rows of one text that may reach its owner.
CAPACITY, BITS, SALTS = 20_000, 12, 8


def build_directory(loads: dict[int, int], capacity: int = CAPACITY, max_depth: int = BITS) -> tuple[int, list[tuple[int, int]]]:
    """Depth and entries of the directory for loads, the number of slots by their leading
    max_depth bits. Entry i names the bucket of slots that start with the bits of i: its prefix
    and its own depth, at most the directory's. A bucket as deep as max_depth stays overfull."""
    below = list(accumulate((loads.get(x, 0) for x in range(1 << max_depth)), initial=0))

    def load(prefix: int, depth: int) -> int:
        width = max_depth - depth
        return below[(prefix + 1) << width] - below[prefix << width]

    depth, entries = 0, [(0, 0)]
    todo = [(0, 0)]
    while todo:
        prefix, own = todo.pop()
        if own >= max_depth or load(prefix, own) <= capacity:
            continue
        if own == depth:
            depth, entries = depth + 1, [e for e in entries for _ in range(2)]
        halves = [(prefix << 1, own + 1), (prefix << 1 | 1, own + 1)]
        for half, deep in halves:
            width = depth - deep
            entries[half << width : (half + 1) << width] = [(half, deep)] * (1 << width)
        todo += halves
    return depth, entries


def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The owner's work on rows (bucket, key, sha, text, top, n) sorted by key: one entry per
    different text of a key, with its place in the key's chain."""
    key, chain = None, []

    def entries() -> list[tuple]:
        return [(bucket, key, i, sha, top, n) for i, (_, bucket, sha, top, n) in enumerate(chain)]

    columns = ["bucket", "key", "place", "sha", "top", "n"]
    for batch in batches:
        done = []
        for bucket, k, sha, text, top, n in zip(batch["bucket"], batch["key"], batch["sha"], batch["text"], batch["top"], batch["n"], strict=True):
            top = None if pd.isna(top) else int(top)
            if k != key:
                done += entries()
                key, chain = k, []
            for link in chain:
                if link[0] == text:
                    link[3] = top if link[3] is None else link[3] if top is None else max(link[3], top)
                    link[4] += n
                    break
            else:
                chain.append([text, bucket, sha, top, n])
        yield pd.DataFrame(done, columns=columns).astype({"top": "Int64"})
    yield pd.DataFrame(entries(), columns=columns).astype({"top": "Int64"})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the
    largest id is kept; null ids count as smallest, and a text of which every id is null keeps
    all its rows, with keep_id null. Rows that repeat both id and text share one verdict, so all
    copies of the largest id stay. Columns of docs that bear the new names give way. An empty
    table gives an empty result. key_bits below 64 weakens the hash, to provoke collisions.
    """
    spark = tuned(docs.sparkSession)
    text, key, sha = (fresh(docs, c) for c in ("x_text", "x_key", "x_sha"))
    free = 64 - key_bits
    slot = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), free), free) if free else F.xxhash64(text)
    keyed = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(key, slot).withColumn(sha, F.sha2(text, 256))

    slots = cut(keyed.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")), "slots")
    # so many bits that an even share of the slots would split four times over; 16 numbers or so
    # for each bucket reach the driver
    bits = max(BITS, (slots.count() // capacity).bit_length() + 3)
    head = F.shiftrightunsigned("key", 64 - bits)
    loads = {r[0]: r[1] for r in slots.groupBy(head.alias("head")).count().collect()}
    depth, entries = build_directory(loads, capacity, bits)
    # buckets numbered in key order
    numbers = {e: i for i, e in enumerate(dict.fromkeys(entries))}
    directory = spark.createDataFrame([(i, numbers[e]) for i, e in enumerate(entries)], "slot_head long, bucket int")

    shared = slots.filter("n > 1").select(F.col("key").alias(key))
    members = attach(keyed, shared, [key], "left_semi")
    merged = members.groupBy(F.col(key).alias("key"), F.col(sha).alias("sha"), F.col(text).alias("text"), (F.spark_partition_id() % SALTS).alias("salt")).agg(F.max(id_col).cast("long").alias("top"), F.count(F.lit(1)).alias("n"))
    slot_head = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    owned = attach(merged.withColumn("slot_head", slot_head), directory, ["slot_head"], "inner", len(entries)).select("bucket", "key", "sha", "text", "top", "n")
    index = owned.repartitionById(len(numbers), F.col("bucket")).sortWithinPartitions("bucket", "key").mapInPandas(chains, "bucket int, key long, place int, sha string, top long, n long")
    path = shared_dir(spark, "buckets")
    index.write.partitionBy("bucket").parquet(path)
    found = spark.read.schema("key long, place int, sha string, top long, n long, bucket int").parquet(path)

    top, n = fresh(docs, "x_top"), fresh(docs, "x_n")
    table = found.select(F.col("key").alias(key), F.col("sha").alias(sha), F.col("top").alias(top), F.col("n").alias(n))
    out = attach(keyed, table, [key, sha])
    keep = F.when(F.col(n).isNull(), F.col(id_col)).otherwise(F.col(top))
    new = {"keep_id": keep, "group_size": F.coalesce(F.col(n), F.lit(1).cast("long")), "kept": F.coalesce(keep == F.col(id_col), keep.isNull()), "text_sha256": F.col(sha)}
    return with_columns(out, new, drop=(text, key, sha, top, n))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that exact_dedup drops, with the columns of docs."""
    # numbered names, so that none clashes with exact_dedup's
    names = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    found = exact_dedup(docs.toDF(*names.values()), names[id_col.lower()], names[text_col.lower()])
    return found.filter("kept").select(*names.values()).toDF(*docs.columns)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
