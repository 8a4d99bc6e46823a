"""Archived HTTP responses as a data source of Spark, for tables and for streams.

A crawl writes its responses to segments, a file per task, and then a manifest that names the segments
that count; a segment of a task that failed is named by none. Readers take the segments of whole
crawls, a partition each; a stream's offset is the number of the last crawl it has read. A
segment holds, one after the other, a line of JSON (address, status, headers, length of the body)
and the body's bytes, so a reader streams through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marquee.sources.elements import decoded

SCHEMA = "crawl long, url string, status int, etag string, last_modified string, content_type string, body binary"
#: Columns of a response that is archived.
WRITTEN = ("url", "status", "etag", "last_modified", "content_type", "body")


def manifests(path: str) -> list[tuple[int, str]]:
    """(crawl, file) of whole crawls, in order."""
    files, base = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((int(f.base_name.split(".")[0]), f.path) for f in found if f.base_name.endswith(".crawl"))


def segments(path: str, after: int, to: int) -> list[tuple[int, str]]:
    """(crawl, segment) of the crawls behind `after`, up to `to`."""
    files, base = fs.FileSystem.from_uri(path)
    out = []
    for crawl, name in manifests(path):
        if after < crawl <= to:
            with files.open_input_stream(name) as f:
                out += [(crawl, f"{base}/{s}") for s in json.loads(f.read())]
    return out


@dataclass
class Segment(InputPartition):
    crawl: int
    file: str


def responses_in(path: str, segment: Segment) -> Iterator[tuple]:
    files, _ = fs.FileSystem.from_uri(path)
    with files.open_input_stream(segment.file) as raw:
        rest = b""
        while True:
            while b"\n" not in rest and (more := raw.read(1 << 16)):
                rest += more
            if not rest:
                return
            line, _, rest = rest.partition(b"\n")
            head = json.loads(line)
            parts, have = [rest], len(rest)
            while have < head["length"]:
                more = raw.read(max(1 << 16, head["length"] - have))
                if not more:
                    raise OSError(f"{segment.file} ends within a body")
                parts.append(more)
                have += len(more)
            whole = b"".join(parts)
            body, rest = whole[: head["length"]], whole[head["length"] :]
            h = head["headers"]
            yield segment.crawl, head["url"], head["status"], h.get("ETag"), h.get("Last-Modified"), h.get("Content-Type"), None if head["none"] else body


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        found = segments(self.path, -1, 1 << 62)
        return [Segment(*s) for s in found] or [Segment(-1, "")]

    def read(self, partition):
        return responses_in(self.path, partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]

    def initialOffset(self):
        return {"crawl": -1}

    def latestOffset(self):
        return {"crawl": max((c for c, _ in manifests(self.path)), default=-1)}

    def partitions(self, start, end):
        return [Segment(*s) for s in segments(self.path, start["crawl"], end["crawl"])]

    def read(self, partition):
        return responses_in(self.path, partition)

    def commit(self, end):
        pass


class Responses(DataSource):
    """spark.read.format("responses").load(path), and readStream alike."""

    @classmethod
    def name(cls):
        return "responses"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def read(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The responses of all crawls, or a stream of them, a crawl at a time as they are finished."""
    spark.dataSource.register(Responses)
    return (spark.readStream if stream else spark.read).format("responses").load(path)


def archive(responses: DataFrame, path: str, crawl: int) -> None:
    """Writes responses (WRITTEN) as a crawl. The manifest comes last, by a rename: a crawl is there wholly or not at
    all, and one that is written again, as after a failure, takes the place of what was there."""
    files, base = fs.FileSystem.from_uri(path)
    files.create_dir(base, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n = f"{crawl}-{uuid.uuid4().hex}.segment", 0
        store, folder = fs.FileSystem.from_uri(path)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
            for b in batches:
                for url, status, etag, modified, kind, body in zip(*(b[c] for c in WRITTEN), strict=True):
                    headers = {k: v for k, v in (("ETag", etag), ("Last-Modified", modified), ("Content-Type", kind)) if v is not None}
                    head = {"url": url, "status": None if pd.isna(status) else int(status), "headers": headers, "length": len(body or b""), "none": body is None}
                    f.write(json.dumps(head).encode() + b"\n" + (body or b""))
                    n += 1
        yield pd.DataFrame({"name": [name], "n": [n]})

    # a name for each task
    written = responses.select(*WRITTEN).mapInPandas(run, "name string, n long").filter("n > 0").collect()
    draft = f"{base}/{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft, compression=None) as f:
        f.write(json.dumps(sorted(r["name"] for r in written)).encode())
    files.move(draft, f"{base}/{crawl}.crawl")


def unchanged(response_etag: Column, response_modified: Column, known_etag: Column, known_modified: Column) -> Column:
    """Whether a page is as it was: by its tag where both have one, else by its date."""
    both = response_etag.isNotNull() & known_etag.isNotNull()
    return F.coalesce(F.when(both, response_etag == known_etag).otherwise(response_modified == known_modified), F.lit(False))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """The good responses (status under 300) whose page is new or differs from what is known of its address (url,
    etag, last_modified, an address once). 304 says itself that nothing changed; errors are left to failures."""
    k = known.select(F.col("url").alias("k_url"), F.col("etag").alias("k_etag"), F.col("last_modified").alias("k_modified"))
    same = (F.col("url") == F.col("k_url")) & unchanged(F.col("etag"), F.col("last_modified"), F.col("k_etag"), F.col("k_modified"))
    return found.filter("status < 300").join(k, same, "left_anti")


def with_text(found: DataFrame, body: str = "body", content_type: str = "content_type", name: str = "page") -> DataFrame:
    """found with its bodies as text: by a byte order mark, the charset of the header, the page's own, or UTF-8."""

    @F.pandas_udf("string")
    def text(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([decoded(b, h) for b, h in zip(bodies, headers, strict=True)], dtype=object)

    return found.withColumn(name, text(body, content_type))
