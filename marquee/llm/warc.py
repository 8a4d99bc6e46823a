"""Web archives: WARC files written by tasks, an index first, and coalesced range reads.

Payload digests are computed without moving payloads, and decide for each page whether its
record is a response or a revisit. Each task then writes one archive of gzip members, a member
per record, to the shared folder, and returns an index row per record: file, offset, length,
URL and digest. The index is written before anything is read back, and names only files of
attempts that succeeded, so a lost executor costs its tasks alone. Readers sort the selected
index rows by file and offset, join neighbouring ranges into one read, and parse the records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import attach, cut, shared_dir, tuned

#: Smaller payloads are never revisits.
LEAST_BYTES = 100
#: Ranges of one file at most so many bytes apart are read together, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Bytes of archives that a task reads.
TASK_BYTES = 64 << 20
#: Compression of the members.
LEVEL = 3

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record, with an id of its own, and the page's id in a header. A revisit has no
    payload; its headers keep the payload's digest and length and the page it refers to. Line
    breaks in a URL are percent-encoded."""
    name = "null" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"X-Page-ID: {name}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def writer(folder: str) -> Callable:
    """Rows (page_id, url, html, digest, record_type, refers_to, size) to index rows; the records go
    to a file of this attempt's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, kind, refers, size in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "record_type", "refers_to", "size")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                member = gzip.compress(record(page_id, url, payload, size, digest, kind, refers), LEVEL, mtime=0)
                out.write(member)
                rows.append((page_id, url, digest, kind, refers, name, offset, len(member)))
                offset += len(member)
            frame = pd.DataFrame(rows, columns=["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return run


def spans(offsets: list[int], lengths: list[int], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of sorted records that one read serves."""
    i = 0
    for j in range(1, len(offsets) + 1):
        if j == len(offsets) or offsets[j] > offsets[j - 1] + lengths[j - 1] + gap or offsets[j] + lengths[j] > offsets[i] + most:
            yield i, j
            i = j


def reader(folder: str, with_html: bool) -> Callable:
    """Index rows sorted by file and offset to records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, part in batch.groupby("file", sort=False):
                offsets, lengths = part["offset"].tolist(), part["length"].tolist()
                with files.open_input_file(f"{path}/{name}") as source:
                    for i, j in spans(offsets, lengths):
                        data = source.read_at(offsets[j - 1] + lengths[j - 1] - offsets[i], offsets[i])
                        rows = []
                        for k in range(i, j):
                            at = offsets[k] - offsets[i]
                            headers, payload = parse(zlib.decompress(data[at : at + lengths[k]], 31))
                            kind = headers["WARC-Type"]
                            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name} at {offsets[k]}: the payload doesn't match its digest")
                            ids = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID", "")
                            size = len(payload) if kind == "response" else int(headers["WARC-Payload-Length"])
                            rows.append((None if ids[0] == "null" else int(ids[0]), headers["WARC-Target-URI"], size, digest, kind, int(ids[1]) if ids[1] else None, payload.decode("utf-8", "surrogatepass") if with_html and kind == "response" else None))
                        frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
                        yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def write_archives(pages: DataFrame) -> tuple[str, DataFrame]:
    """The folder of the archives of pages (page_id, url, html), and their index.

    Of equal payloads of LEAST_BYTES or more, the row with the smallest page_id is the response
    and the others revisit it; where ids repeat, one row of that id is the response only if its
    copies have other ids, so all rows of the smallest id are responses. A null html is an empty
    payload; a row with a null id revisits like any other, and payloads all of whose ids are
    null are all responses. Other columns of pages are not read; an empty table gives an empty
    index.
    """
    spark = tuned(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    body = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.sha2(body.cast("binary"), 256)).withColumn("size", F.octet_length(body))
    first = rows.filter(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = cut(first.filter("copies > 1 AND first IS NOT NULL").select("digest", "first"), "payloads")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = attach(rows, first, ["digest"])
    told = told.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), "size")
    folder = shared_dir(spark, "warc")
    return folder, cut(told.mapInPandas(writer(folder), INDEX), "warc-index")


def read_archives(folder: str, index: DataFrame, with_html: bool = False) -> DataFrame:
    """The records that the rows of index name, read from folder: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and html with with_html (null for revisits).

    Ranges of neighbouring records go to one task each, as many as the archives' bytes ask for.
    """
    spark = index.sparkSession
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    ordered = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(reader(folder, with_html), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def read_pages(folder: str, index: DataFrame) -> DataFrame:
    """read_archives with html of revisits too, which is that of the response they refer to."""
    records = read_archives(folder, index, with_html=True)
    asked = index.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "digest").distinct()
    of = attach(index.filter("record_type = 'response'"), asked, ["page_id", "digest"], "left_semi").dropDuplicates(["page_id", "digest"])
    payloads = cut(read_archives(folder, of, with_html=True).select(F.col("payload_digest").alias("digest"), F.col("html").alias("payload")), "payloads")
    again = F.col("record_type") == "revisit"
    # responses keep a digest of their own, so that they do not meet the payloads
    keyed = records.withColumn("digest", F.when(again, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), "payload_digest")))
    return keyed.join(payloads, "digest", "left").withColumn("html", F.coalesce("html", "payload")).drop("digest", "payload")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder, index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
