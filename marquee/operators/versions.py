"""A table whose writes are whole versions: staged first, then published by one atomic step.

Data lies in folders, one for each partition and write. A manifest names, for every partition, the
folder that counts; its number is the table's version. A write stages the partitions that it touches,
others keep their folders, and publishes the next manifest under its number, which succeeds for one
writer only. A write that fails before that leaves the old version as it was; one that is repeated
finds its batch among those written and changes nothing. Counters come from the write itself,
by observation, not from a second pass.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.operators.upsert import side_by_side

#: Batches that a manifest remembers.
REMEMBERED = 1_000


class Conflict(RuntimeError):
    """Another writer has published a version in the meantime."""


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows that count, as they are read by whatever comes next, how many meet each condition."""
    seen = Observation()
    return rows.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]), seen


def split(rows: DataFrame, condition: Column) -> tuple[DataFrame, Observation]:
    """The rows that meet a condition, and an observation that has, once they are written, the numbers
    of both sides: kept and dropped. An unknown condition drops."""
    met = F.coalesce(condition, F.lit(False))
    told, seen = counted(rows, kept=met, dropped=~met)
    return told.filter(met), seen


class Table:
    """A table at a path, partitioned by a column (text, few values), its rows named by key within a partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, partition: str, key: Sequence[str]):
        self.spark, self.path, self.partition, self.key = spark, path.rstrip("/"), partition, list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return jvm, place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last version; 0 before the first write."""
        _, place, files = self._files()
        if not files.exists(place):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(place) if f.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"parts": {}, "batches": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{n:010d}.json").collect()))

    def read(self, version: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its partitions."""
        parts = self.manifest(version)["parts"]
        folders = [f"{self.path}/data/{f}" for p, f in sorted(parts.items()) if only is None or p in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders).select(*self.columns)

    def _publish(self, manifest: dict, version: int) -> None:
        jvm, place, files = self._files()
        files.mkdirs(place)
        draft = jvm.org.apache.hadoop.fs.Path(place, f"{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(place, f"{version:010d}.json")
        # a rename to a name that is taken fails, for all writers but the first
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise Conflict(f"version {version} exists")

    def _write(self, rows: DataFrame, touched: Sequence[str], manifest: dict, batch: str, version: int) -> None:
        folder = f"{version:010d}-{uuid.uuid4().hex}"
        # the partition is kept inside the files too: folders are named by its hash, whatever it holds
        rows.withColumn("x_part", F.sha1(F.coalesce(F.col(self.partition), F.lit("")))).write.partitionBy("x_part").parquet(f"{self.path}/data/{folder}")
        _, _, files = self._files()
        parts = dict(manifest["parts"])
        for p in touched:
            name = f"{folder}/x_part={hashlib.sha1(p.encode()).hexdigest()}"
            if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}")):
                parts[p] = name
            else:  # nothing is left there
                parts.pop(p, None)
        self._publish({"parts": parts, "batches": [*manifest["batches"], batch][-REMEMBERED:]}, version)

    def save(self, rows: DataFrame, batch: str) -> dict[str, int]:
        """Inserts or replaces rows by key, as one version; returns how many were inserted, updated and skipped
        (equal in all columns; nulls are values). A batch that is written already is passed over: no
        counts. Partitions without new rows are not read. Of rows that repeat a key any one counts, so
        deduplicate before; null partitions count as the empty text."""
        version = self.version()
        manifest = self.manifest(version)
        if batch in manifest["batches"]:
            return {}
        part = F.coalesce(F.col(self.partition), F.lit(""))
        new = rows.select(*[part.alias(c) if c == self.partition else F.col(c) for c in self.columns])
        touched = sorted(r[0] for r in new.select(self.partition).distinct().collect())  # few by contract
        old = self.read(version, touched)
        names = [self.partition, *[k for k in self.key if k != self.partition]]
        both = side_by_side(old, new, names)
        fresh, known = F.col("n").isNotNull(), F.col("o").isNotNull()
        same = reduce(lambda a, c: a & F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")), self.columns, F.lit(True))
        told, seen = counted(both, inserted=fresh & ~known, updated=fresh & known & ~same, skipped=fresh & known & same)
        self._write(told.select(F.coalesce("n", "o").alias("r")).select("r.*"), touched, manifest, batch, version + 1)
        return dict(seen.get)

    def delete(self, keys: DataFrame, batch: str) -> dict[str, int]:
        """Deletes rows by partition and key, as one version; returns how many were deleted and kept in the
        partitions that were touched."""
        version = self.version()
        manifest = self.manifest(version)
        if batch in manifest["batches"]:
            return {}
        names = [self.partition, *[k for k in self.key if k != self.partition]]
        part = F.coalesce(F.col(self.partition), F.lit(""))
        gone = keys.select(*[part.alias(c) if c == self.partition else F.col(c) for c in names])
        touched = sorted(r[0] for r in gone.select(self.partition).distinct().collect())
        marked = side_by_side(self.read(version, touched), gone, names).filter("o IS NOT NULL")
        kept, seen = split(marked, F.col("n").isNull())
        self._write(kept.select("o.*"), touched, manifest, batch, version + 1)
        return {"deleted": seen.get["dropped"], "kept": seen.get["kept"]}


def export_tsv(rows: DataFrame, path: str) -> None:
    """Rows as lines of values between tabs, without a heading; null is nothing. Order within files is the
    rows' own."""
    rows.write.mode("overwrite").option("sep", "\t").option("emptyValue", "").option("nullValue", "").csv(path)
