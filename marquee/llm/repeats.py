"""Long repeated passages by suffix arrays over shards of induced sorting.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Equal strings must
meet in one shard, so shards are dealt by content: of the grams of GRAM bytes in each window of
LENGTH bytes the one with the smallest hash names the window, as equal windows agree on it. Windows
in a row that one gram names form a segment, some 170 windows and 570 bytes on average, and its
gram's hash is the key. Segments whose key occurs once in the corpus hold nothing repeated. Equal
segments are merged and counted before anything else moves: a segment alone with its key that
occurs twice or more repeats in all its windows. For what is left, different segments with one key,
a task concatenates whole keys to a shard, sorts its suffixes by induction (classified, their
leftmost-smaller substrings sorted recursively, the rest induced linearly) and computes permuted
common prefixes; a window repeats if its suffix shares LENGTH bytes with a neighbour. A segment that
agrees with no other of its key on so many bytes about the gram as equal windows must is left out of
the shard: half of all bytes, as many texts share a line shorter than a window.

A key whose different segments exceed CROWD bytes, as in a passage that a third of all documents
share in different surroundings, is cut finer and dealt anew: pieces of fewer windows, keyed by
all bytes that these have in common, and at last single windows, which are their own keys. Pieces
are merged and counted like segments, so what they share is one piece however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import attach, cut, fresh, mix, text_hashes, tuned, with_columns
from marquee.llm.suffixes import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated, and of the grams that name windows.
LENGTH, GRAM = 400, 64
#: Bytes of a shard's segments, above which a key is crowded, and that are hashed at a time.
SHARD, CROWD, CHUNK = 1 << 20, 4 << 20, 4 << 20
#: Windows in a piece of a crowded key, at each step of cutting finer.
FINER = (16, 1)
#: Bands of a window's bytes, by which segments that share no window are told.
BANDS = 10

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 23) - 1)


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size (a power of two) bytes, by doubling."""
    h, factor, width = _TABLE[data], 0xD6E8FEB86659FD93, 1
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return mix(h)


def _minima(v: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each run of size values, by doubling."""
    width = 1
    while 2 * width <= size:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (size - width)], v[size - width :]) if size > width else v


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie end to end in data, text i up to ends[i]: (text, first window, one
    past the last, place of the naming gram, key), places counted in data. Windows stay within
    their text."""
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    with np.errstate(over="ignore"):
        h = _rolling(data, gram)
    # the leftmost of equal hashes wins: a place is behind the hash's upper bits
    named = (_minima(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
    window = np.arange(len(named))
    text = np.searchsorted(ends, window, "right")
    inside = window + length <= ends[np.minimum(text, len(ends) - 1)]
    fresh_run = np.ones(len(named), bool)
    fresh_run[1:] = (named[1:] != named[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh_run & inside)
    stops = np.flatnonzero(np.append((fresh_run | ~inside)[1:], True)) + 1
    last = stops[np.searchsorted(stops, first, "right")] if len(first) else first
    return text[first], first, last, named[first], h[named[first]].view(np.int64)


def batches_of(texts: list[bytes], size: int, length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[int]]]:
    """Texts, end to end, in pieces of about size bytes: (numbers of texts, bytes, ends, offsets of the
    pieces in their texts). A longer text comes in pieces that overlap by length - 1 bytes, so
    that every window is in one piece."""
    which, parts, offsets, total = [], [], [], 0
    for i, b in enumerate(texts):
        for o in range(0, max(1, len(b) - length + 1), size):
            piece = b[o : o + size + length - 1]
            if total and total + len(piece) > size:
                yield which, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), offsets
                which, parts, offsets, total = [], [], [], 0
            which.append(i)
            parts.append(piece)
            offsets.append(o)
            total += len(piece)
    if parts:
        yield which, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), offsets


def digests(pieces: list) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each piece's hash as two numbers."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in pieces), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def find_segments(length: int, gram: int, chunk: int) -> Callable:
    """Rows (h1, h2, body) to a row for each segment: start and stop its windows, at the place of its
    gram behind start, d1 and d2 its bytes' hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
            for which, data, ends, offsets in batches_of(list(batch["body"]), chunk, length):
                text, first, last, at, key = segments(data, ends, length, gram)
                if not len(text):
                    continue
                buffer = memoryview(data)
                d1, d2 = digests([buffer[a:b] for a, b in zip(first.tolist(), (last + length - 1).tolist(), strict=True)])
                row = np.array(which)[text]
                shift = np.array(offsets)[text] - np.concatenate([[0], ends[:-1]])[text]
                yield pd.DataFrame({"h1": h1[row], "h2": h2[row], "start": first + shift, "stop": last + shift, "at": at - first, "key": key, "d1": d1, "d2": d2})

    return run


def read_segments(length: int) -> Callable:
    """Rows (body, asked), asked of (start, stop, at, key, d1, d2, n), to segments with their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(a["key"], a["d1"], a["d2"], a["n"], a["at"], body[a["start"] : a["stop"] + length - 1]) for body, asked in zip(batch["body"], batch["asked"], strict=True) for a in asked]
            yield pd.DataFrame(out, columns=["key", "d1", "d2", "n", "at", "body"])

    return run


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Which windows of each body also stand in another place of the bodies."""
    sizes = np.array([len(b) for b in bodies])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    t = np.zeros(int((sizes + 1).sum()), np.int64)  # a 0 behind each body, which no window holds
    for s, b in zip(starts.tolist(), bodies, strict=True):
        t[s : s + len(b)] = np.frombuffer(b, np.uint8).astype(np.int64) + 1
    prefix, before = permuted_prefixes(t, suffix_array(t, 257), length)
    hit = np.zeros(len(t), bool)
    long = np.flatnonzero(prefix >= length)
    hit[long] = True
    hit[before[long]] = True
    return [hit[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs_of(flags: np.ndarray) -> list[dict]:
    """Runs of true flags as (a, b), b exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


def partnered(ats: list[int], bodies: list[bytes], length: int) -> list[bool]:
    """Which of a key's segments, their gram at ats, may share a window with another one. Equal windows hold
    the gram at one place; those that hold it in one band of places also share what is common to all windows
    of the band. So a segment that shares no band's bytes shares no window; one that does is still to be judged."""
    found = [False] * len(bodies)
    edges = np.unique(np.linspace(0, length, BANDS + 1).astype(int)).tolist()
    for a, b in pairwise(edges):
        seen: dict[int, int] = {}
        for i, (at, body) in enumerate(zip(ats, bodies, strict=True)):
            first, end = at - a, at - b + 1 + length
            if first >= 0 and end <= len(body):
                j = seen.setdefault(xxhash.xxh3_64_intdigest(body[first:end]), i)
                if j != i:
                    found[i] = found[j] = True
    return found


def sort_shards(length: int, shard: int) -> Callable:
    """Segments (key, d1, d2, n, at, body) sorted by key to (d1, d2, runs): the runs of windows that
    repeat, of segments that have any. A shard is as many whole keys, without segments that share no
    window, as reach shard bytes."""

    def done(rows: list[tuple], out: list[tuple]) -> pd.DataFrame:
        found = repeated_windows([r[5] for r in rows], length) if rows else []
        runs = [runs_of(np.ones(len(f), bool) if r[3] > 1 else f) for r, f in zip(rows, found, strict=True)]
        return pd.DataFrame(out + [(r[1], r[2], x) for r, x in zip(rows, runs, strict=True) if x], columns=["d1", "d2", "runs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, out, total = [], [], 0
        each = (row for batch in batches for row in zip(*(batch[c] for c in ("key", "d1", "d2", "n", "at", "body")), strict=True))
        for _, of_key in groupby(each, itemgetter(0)):
            of_key = list(of_key)
            for row, shares in zip(of_key, partnered([r[4] for r in of_key], [r[5] for r in of_key], length), strict=True):
                if shares:
                    rows.append(row)
                    total += len(row[5])
                elif row[3] > 1:  # what occurs twice as it is needs no other segment
                    out.append((row[1], row[2], [{"a": 0, "b": len(row[5]) - length + 1}]))
            if total >= shard or len(out) >= 4_000:
                yield done(rows, out)
                rows, out, total = [], [], 0
        yield done(rows, out)

    return run


def cut_finer(length: int, windows: int) -> Callable:
    """Segments (d1, d2, n, at, body) to pieces of so many windows: (p1, p2 of the segment, offset,
    key, d1, d2, n, at, body). Pieces are counted from the segment's gram, so equal windows lie alike
    in theirs, and keyed by their place before it and the bytes that all windows there share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d1, d2, n, at, body in zip(batch["d1"], batch["d2"], batch["n"], batch["at"], batch["body"], strict=True):
                last = len(body) - length + 1
                # window i lies at - i before the gram; pieces are the multiples of windows there
                for place in range((at - last + 1) // windows, at // windows + 1):
                    full = at - (place + 1) * windows + 1  # where a whole piece would begin
                    first, end = max(0, full), min(last, full + windows)
                    # what all windows of a whole piece share, also where the segment cuts it short
                    shared = body[full + windows - 1 : full + length]
                    out.append((d1, d2, first, place, shared, n, at - first, body[first : end + length - 1]))
            if out:
                d = digests([x[7] for x in out])
                keys = np.array([xxhash.xxh3_64_intdigest(x[4], seed=x[3]) for x in out], np.uint64).view(np.int64)
                frame = pd.DataFrame([(x[0], x[1], x[2], x[5], x[6], x[7]) for x in out], columns=["p1", "p2", "offset", "n", "at", "body"])
                yield frame.assign(key=keys, d1=d[0], d2=d[1])

    return run


_RUNS = "array<struct<a:int,b:int>>"


def whole_runs(size) -> F.Column:
    return F.array(F.struct(F.lit(0).alias("a"), size.cast("int").alias("b"))).cast(_RUNS)


def verdicts(rows: DataFrame, length: int, shard: int, crowd: int, finer: tuple[int, ...]) -> DataFrame:
    """(d1, d2, runs) for the different segments rows (key, d1, d2, n, at, body), all that share a key
    among them: the runs of windows that repeat, where there are any."""
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("body")).alias("bytes"))
    crowded = cut(stats.filter((F.col("bytes") > crowd) & (F.col("m") > 1)).select("key"), "crowded") if finer else None
    there = 0 if crowded is None else crowded.count()
    calm = attach(rows, crowded, ["key"], "left_anti", there) if there else rows
    found = calm.repartition("key").sortWithinPartitions("key").mapInPandas(sort_shards(length, shard), f"d1 long, d2 long, runs {_RUNS}")
    if not there:
        return found
    windows, *rest = finer
    pieces = cut(attach(rows, crowded, ["key"], "left_semi", there).mapInPandas(cut_finer(length, windows), "p1 long, p2 long, offset int, n long, at int, body binary, key long, d1 long, d2 long"), "pieces")
    merged = pieces.groupBy("key", "d1", "d2").agg(F.sum("n").alias("n"), F.first("at").alias("at"), F.first("body").alias("body"))
    fine = _judged(cut(merged, "merged"), length, shard, crowd, tuple(rest))
    back = pieces.select("p1", "p2", "offset", "d1", "d2").join(fine, ["d1", "d2"])
    shifted = F.transform("runs", lambda r: F.struct((r["a"] + F.col("offset")).alias("a"), (r["b"] + F.col("offset")).alias("b")))
    whole = back.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.flatten(F.collect_list(shifted)).cast(_RUNS).alias("runs"))
    return found.unionByName(whole)


def _judged(rows: DataFrame, length: int, shard: int, crowd: int, finer: tuple[int, ...]) -> DataFrame:
    """verdicts where keys may have one segment alone, which repeats wholly if it occurs twice."""
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    both = rows.join(stats, "key")
    alone = both.filter("m = 1 AND n > 1").select("d1", "d2", whole_runs(F.length("body") - length + 1).alias("runs"))
    return alone.unionByName(verdicts(cut(both.filter("m > 1").drop("m"), "shared"), length, shard, crowd, finer))


def merged_runs(found: pd.Series) -> pd.Series:
    """Overlapping and adjoining runs as one, in order."""

    def merged(runs) -> list[dict]:
        ab = np.array(sorted((r["a"], r["b"]) for r in runs), np.int64)
        reach = np.maximum.accumulate(ab[:, 1])
        first = np.flatnonzero(np.concatenate([[True], ab[1:, 0] > reach[:-1]]))
        last = np.append(first[1:], len(ab)) - 1
        return [{"a": int(a), "b": int(b)} for a, b in zip(ab[first, 0], reach[last], strict=True)]

    return found.map(merged)


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, crowd: int = CROWD, finer: tuple[int, ...] = FINER, chunk: int = CHUNK) -> DataFrame:
    """docs with n_bytes, spans (array of a and b, b exclusive: the maximal runs of bytes to remove, in
    order) and kept (binary: the bytes that remain, end to end) added.

    Bytes are those of the text in UTF-8. A byte is removed if it lies in a string of length bytes that
    starts anywhere else too, in this text or another; strings are judged on the input alone, and
    none reaches over the end of a text. Rows that repeat a text lose all of it if it has length bytes;
    so ties need no rule. Null texts count as empty, shorter ones than length stay whole. Columns of
    docs that bear the new names give way; an empty table gives an empty result.
    """
    tuned(docs.sparkSession)
    names = fresh(docs, "x_h1"), fresh(docs, "x_h2")
    hashed = text_hashes(text_col)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    long = docs.filter(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) >= length)
    bodies = long.select(*hashed, body.alias("body"))
    found = cut(bodies.mapInPandas(find_segments(length, gram, chunk), "h1 long, h2 long, start int, stop int, at int, key long, d1 long, d2 long"), "segments")
    keys = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "keys")
    shared = cut(attach(found, keys, ["key"], "left_semi"), "shared")

    # different segments, each with one place where its bytes can be read
    place = F.struct("h1", "h2", "start", "stop", "at")
    different = cut(shared.groupBy("key", "d1", "d2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")), "different")
    several = different.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = cut(several.select("key"), "several")
    n = several.count()
    alone = attach(different, several, ["key"], "left_anti", n).select("d1", "d2", whole_runs(F.col("place.stop") - F.col("place.start")).alias("runs"))
    asked = attach(different, several, ["key"], "left_semi", n).select("place.h1", "place.h2", F.struct("place.start", "place.stop", "place.at", "key", "d1", "d2", "n").alias("asked"))
    asked = cut(asked.groupBy("h1", "h2").agg(F.collect_list("asked").alias("asked")), "asked")
    read = attach(bodies, asked, ["h1", "h2"], "inner").select("body", "asked").mapInPandas(read_segments(length), "key long, d1 long, d2 long, n long, at int, body binary")
    # copies of a text have all brought the same segments
    rows = cut(read.groupBy("key", "d1", "d2").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("body").alias("body")), "bodies")
    judged = cut(alone.unionByName(verdicts(rows, length, shard, crowd, finer)), "verdicts")

    places = shared.select("h1", "h2", "start", "d1", "d2").distinct()
    hit = attach(places, judged, ["d1", "d2"], "inner")
    spans = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start") + F.lit(length - 1)).cast("int").alias("b")))
    # runs come from windows of one text: no more than it has bytes
    per_text = hit.groupBy("h1", "h2").agg(F.flatten(F.collect_list(spans)).alias("runs")).select(F.col("h1").alias(names[0]), F.col("h2").alias(names[1]), F.pandas_udf(merged_runs, _RUNS)("runs").alias(fresh(docs, "x_spans")))
    per_text = cut(per_text, "spans")
    out = attach(docs.select("*", *[h.alias(n) for h, n in zip(hashed, names, strict=True)]), per_text, list(names))
    spans = F.coalesce(F.col(per_text.columns[2]), F.array().cast(_RUNS))
    size = F.octet_length(body)
    # what stays: before each span, and behind the last
    from_ = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"]))
    to = F.concat(F.transform(spans, lambda s: s["a"]), F.array(size))
    pieces = F.zip_with(from_, to, lambda a, b: F.substring(F.hex(body), 2 * a + 1, 2 * (b - a)))
    kept = F.when(F.size(spans) == 0, body).otherwise(F.unhex(F.array_join(pieces, "")))
    return with_columns(out, {"n_bytes": size.cast("long"), "spans": spans, "kept": kept}, drop=(*names, per_text.columns[2]))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, r, octet_length(b) AS n, lower(hex(b)) AS x FROM d),
w AS (SELECT r, p, md5_number(substr(x, (2 * p + 1)::BIGINT, 800)) AS m FROM (SELECT r, x, unnest(range(n - 399)) AS p FROM h WHERE n >= 400)),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, p FROM w SEMI JOIN again USING (m)),
runs AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM hit)),
spans AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY r, g),
cuts AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM spans GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(unhex(x)) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(la) + 2),
    lambda i: substr(x, (2 * (CASE WHEN i = 1 THEN 0 ELSE lb[i - 1] END) + 1)::BIGINT, (2 * ((CASE WHEN i > len(la) THEN n ELSE la[i] END) - (CASE WHEN i = 1 THEN 0 ELSE lb[i - 1] END)))::BIGINT)), ''))) END AS kept_sha256
FROM h LEFT JOIN cuts USING (r)
"""


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
