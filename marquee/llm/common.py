"""Helpers that the corpus operators share: shared tables, size-checked joins, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 400_000
#: Arrow batches hold at most so many rows and about so many bytes, so that one batch of the
#: longest texts still fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 4_000, 4 << 20

#: ASCII lower-casing, as all word operators define it.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that reach Python workers and turns adaptive execution on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a session in one process (as in tests) takes a folder under the
    system's temporary folder; on a cluster no such folder is shared, and this raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it reread: lineage ends here, on files that
    outlive any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, new: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """df with the columns of new; columns of df with these names (in any case) give way."""
    gone = {c.lower() for c in (*new, *drop)}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone], *[v.alias(k) for k, v in new.items()])


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", count: int | None = None) -> DataFrame:
    """rows joined with table, whose keys `on` are unique and never null.

    The table is counted first: up to BROADCAST_ROWS rows it is broadcast, and nothing of rows
    moves. A larger one is joined by shuffle, where adaptive execution splits partitions that
    a hot key has swollen.
    """
    n = table.count() if count is None else count
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, list(on), how)


def fold(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def text_hashes(text: str) -> list[Column]:
    """128 bits of a text's hash as columns h1 and h2; null hashes as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased: bytes.lower and bytes.split know ASCII only, and
    split at exactly 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def shingles(tokens: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, one hash of the
    whole sequence; none without words."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens)
    width, rows = (k, n - k + 1) if n >= k else (n, 1)
    with np.errstate(over="ignore"):
        out = np.full(rows, width, np.uint64)
        for i in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + rows])
    return np.unique(out)
