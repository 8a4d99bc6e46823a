"""Benchmark decontamination: q-gram lemma filtering, then verification by banded alignment.

Every benchmark item is cut into overlapping segments. A text that holds a segment with at most
k edits shares at least (length - Q + 1) - k * Q of the segment's character q-grams, on diagonals
at most k apart. Shared q-grams are counted in bands of diagonals that overlap, so that each such
set of diagonals lies in one band; regions that reach the bound are aligned within their band,
and those that need no more edits than the budget count.

Items of a few characters, which have no q-grams to count, are looked for as they are, between
word borders.

The benchmark is indexed by tasks, BLOCK characters or one longer item at a time, into files of
the shared folder, which those who read texts map into memory: one pass over the texts serves a
benchmark of any size, and verdicts come with the rows that they are about, whatever their ids.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.arrays import load, save
from marquee.llm.common import fresh, mix, shared_dir, tuned

#: Length of q-grams, of segments and their distance, and edits allowed per character.
Q, SEGMENT, STEP, EDITS = 8, 100, 50, 0.1
#: Shorter items have no segments: they must occur between word borders, and those shorter than a
#: q-gram must be a whole text.
LEAST = 20
#: Characters of the benchmark in one file of the index.
BLOCK = 2_000_000
#: Between texts: so many of a private code point, that no q-gram of a text is that of two.
GAP, _GAP = Q, 0xE000
#: Characters of texts that are looked up at once, and shared q-grams above which a longer stretch
#: is halved.
STRETCH, HITS = 1 << 18, 4_000_000


def normalised(text: str | None) -> str:
    """Lower case, and single blanks between words."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams of code points, q a power of two, by doubling."""
    with np.errstate(over="ignore"):
        h, n = mix(c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        while n < q:
            h = (h[:-n] * np.uint64(0xD6E8FEB86659FD93) + h[n:]) if len(h) > n else h[:0]
            h = h ^ (h >> np.uint64(32))
            n *= 2
    return h


class Index:
    """Segments of items and their q-grams, sorted by hash; arrays, which may be memory-mapped."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.keys, self.runs, self.segs, self.places, self.items, self.begins, self.codes = (parts[x] for x in ("keys", "runs", "segs", "places", "items", "begins", "codes"))
        length = np.diff(self.begins)
        self.budget = np.where(length >= 4 * Q, (length * EDITS).astype(np.int64), 0)
        self.need = length - Q + 1 - self.budget * Q
        # bits of hashes that occur: eight for each q-gram, a power of two
        self.seen = parts["seen"]
        self.mask = np.uint64(len(self.seen) - 1)

    @staticmethod
    def build(items: list[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
        """items: places of items and their code points, LEAST at least."""
        segments, of, keys, segs, places = [], [], [], [], []
        for item, c in items:
            starts = [0] if len(c) <= SEGMENT else [*range(0, len(c) - SEGMENT, STEP), len(c) - SEGMENT]
            for s in starts:
                part = c[s : s + SEGMENT]
                h = qgrams(part)
                segs.append(np.full(len(h), len(segments), np.int32))
                keys.append(h)
                places.append(np.arange(len(h), dtype=np.int32))
                segments.append(part)
                of.append(item)
        none = [np.empty(0, np.int32)]
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        different, runs = np.unique(keys, return_counts=True)
        seen = np.zeros(1 << max(16, (8 * len(keys)).bit_length()), bool)
        seen[(keys & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        return {
            "keys": different,
            "runs": np.r_[0, np.cumsum(runs)],
            "segs": np.concatenate(segs or none)[order],
            "places": np.concatenate(places or none)[order],
            "items": np.array(of, np.int64),
            "begins": np.cumsum([0, *map(len, segments)]),
            "codes": np.concatenate(segments).astype(np.uint32) if segments else np.empty(0, np.uint32),
            "seen": seen,
        }

    def segment(self, i: int) -> np.ndarray:
        return self.codes[self.begins[i] : self.begins[i + 1]]

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hashes h that occur: their places, and where their rows begin and how many they are."""
        at = np.flatnonzero(self.seen[(h & self.mask).astype(np.int64)])
        if not len(at):
            return at, at, at
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        some = self.keys[place] == h[at]
        at, place = at[some], place[some]
        return at, self.runs[place], self.runs[place + 1] - self.runs[place]

    def hits(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text places, segments and segment places of all shared q-grams."""
        row = np.repeat(lo - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())
        return np.repeat(at, n), self.segs[row].astype(np.int64), self.places[row].astype(np.int64)


def edits(segment: np.ndarray, region: np.ndarray, most: int) -> int:
    """Fewest edits between segment and any part of region; most + 1 if more than most. One row
    of the alignment per character of the segment; a row is a vector operation."""
    cols = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for ch in segment:
        step = np.empty_like(row)
        step[0] = row[0] + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != ch))
        # insertions: the smallest value to the left plus its distance
        row = np.minimum.accumulate(step - cols) + cols
        if row.min() > most:
            return most + 1
    return int(row.min())


def whole(segment: np.ndarray, region: np.ndarray) -> bool:
    """Whether region holds segment unedited."""
    found, text = segment.tobytes(), region.tobytes()
    at = text.find(found)
    while at > 0 and at % segment.itemsize:
        at = text.find(found, at + 1)
    return at >= 0


def matches(c: np.ndarray, index: Index, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, place in c, segment, edits) of regions of texts that hold a segment within its
    budget. Texts begin in c at begins, each with GAP code points behind it. The texts are taken
    in stretches that overlap by more than any region, each with at most HITS shared q-grams
    unless it is as short as four segments; a region in two stretches may come twice."""
    at, lo, n = index.shared(qgrams(c))
    before = np.r_[0, np.cumsum(n)]
    todo = [(0, len(c))]
    while todo:
        a, b = todo.pop()
        i, j = np.searchsorted(at, (a, b))
        if before[j] - before[i] > HITS and b - a > 4 * SEGMENT:
            middle = (a + b) // 2
            todo += [(a, middle + SEGMENT), (middle - SEGMENT, b)]
        elif i < j:
            yield from regions(c, index, begins, *index.hits(at[i:j], lo[i:j], n[i:j]))


def regions(c: np.ndarray, index: Index, begins: np.ndarray, at: np.ndarray, seg: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    ends = np.r_[begins[1:], len(c)] - GAP
    text = np.searchsorted(begins, at, "right") - 1
    diagonal = at - place + SEGMENT
    found = set()
    size = len(c) + 4 * SEGMENT
    for shift in (0, 1):
        # bands twice as wide as the budget's diagonals, shifted by half: one holds any k + 1 of them
        width = 2 * (index.budget[seg] + 1)
        band = (diagonal + shift * (width // 2)) // width
        # shared q-grams count for the text they lie in; a place of the segment counts once,
        # however often the text repeats its q-gram
        key = seg * size + band
        if len(index.items) * size * len(begins) * SEGMENT < 1 << 63:
            packed = np.sort((key * len(begins) + text) * SEGMENT + place)
            packed = packed[np.r_[True, packed[1:] != packed[:-1]]] // SEGMENT
            key, own = packed // len(begins), packed % len(begins)
        else:
            order = np.lexsort((place, text, key))
            new = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(text[order]) != 0) | (np.diff(place[order]) != 0)]
            key, own = key[order][new], text[order][new]
        starts = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(own) != 0)])
        n = np.diff(np.r_[starts, len(key)])
        enough = starts[n >= index.need[key[starts] // size]]
        for k, t in zip(key[enough].tolist(), own[enough].tolist(), strict=True):
            one = k // size
            w = 2 * (int(index.budget[one]) + 1)
            found.add((one, t, k % size * w - shift * (w // 2) - SEGMENT, w))
    done = {}
    for one, t, start, w in sorted(found):
        if any(abs(start - x) <= w for x in done.get((one, t), ())):
            continue
        segment, most = index.segment(one), int(index.budget[one])
        # the region ends where its text does
        lo, hi = max(int(begins[t]), start - most), min(int(ends[t]), start + w + len(segment) + most)
        e = 0 if whole(segment, c[lo:hi]) else edits(segment, c[lo:hi], most)
        if e <= most:
            done.setdefault((one, t), []).append(start)
            yield t, max(int(begins[t]), start), one, e


def indexer(folder: str) -> Callable:
    """Rows (item_id, text) to the files that hold them: (uri, n), for BLOCK characters each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            segmented = [(i, c) for i, (_, c) in enumerate(held) if len(c) >= LEAST]
            short = [(i, c) for i, (_, c) in enumerate(held) if 0 < len(c) < LEAST]
            ids = np.array([0 if pd.isna(x) else int(x) for x, _ in held], np.int64)
            more = {
                "ids": ids,
                "null": np.array([bool(pd.isna(x)) for x, _ in held], bool),
                "short": np.array([i for i, _ in short], np.int64),
                "ends": np.cumsum([0, *(len(c) for _, c in short)]),
                "short_codes": np.concatenate([c for _, c in short]).astype(np.uint32) if short else np.empty(0, np.uint32),
            }
            uri = f"{folder}/{uuid.uuid4().hex}"  # of this attempt
            save(Index.build(segmented) | more, uri)
            return pd.DataFrame({"uri": [uri], "n": [len(held)]})

        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                c = codes(normalised(text))
                if held and size + len(c) > BLOCK:
                    yield out()
                    held, size = [], 0
                held.append((item, c))
                size += len(c)
        if held:
            yield out()

    return run


def short_items(parts: dict[str, np.ndarray]) -> tuple[re.Pattern | None, dict[str, list[int]]]:
    """A pattern of the short items, and the items of each."""
    of: dict[str, list[int]] = {}
    ends = parts["ends"]
    for k, item in enumerate(parts["short"].tolist()):
        of.setdefault(parts["short_codes"][ends[k] : ends[k + 1]].tobytes().decode("utf-32-le", "surrogatepass"), []).append(item)
    long = sorted((x for x in of if len(x) >= Q), key=len, reverse=True)
    # found at every word, so that none hides another; of items with one beginning all are asked for
    return (re.compile(r"(?<!\w)(?=(?:" + "|".join(map(re.escape, long)) + r")(?!\w))") if long else None), of


def short_matches(text: str, pattern: re.Pattern | None, of: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
    """(item, place) of the short items that a normalised text holds."""
    if text in of and len(text) < Q:
        yield from ((item, 0) for item in of[text])
    for m in pattern.finditer(text) if pattern else ():
        for end in range(m.start() + Q, min(len(text), m.start() + LEAST - 1) + 1):
            if (found := of.get(text[m.start() : end])) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                yield from ((item, m.start()) for item in found)


FOUND = "array<struct<item_id: long, start: long, edits: long>>"


def finder(files: list[str]) -> Callable:
    """A pandas UDF's work: texts to the places of segments and short items in them."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        blocks = []
        for uri in files:
            parts = load(uri)
            blocks.append((Index(parts), parts["ids"], parts["null"], *short_items(parts)))
        gap = np.full(GAP, _GAP, np.uint32)
        for batch in batches:
            texts = [normalised(t) for t in batch]
            out: list[list[dict]] = [[] for _ in texts]
            at = 0
            while at < len(texts):
                parts, begins, size, first = [], [], 0, at
                while at < len(texts) and (size < STRETCH or at == first):
                    c = codes(texts[at])
                    begins.append(size)
                    parts += [c, gap]
                    size += len(c) + GAP
                    at += 1
                c, begins = np.concatenate(parts), np.array(begins)
                for index, ids, null, pattern, of in blocks:
                    found = {(t, place - int(begins[t]), int(index.items[seg]), e) for t, place, seg, e in matches(c, index, begins)}
                    if of:
                        found |= {(t, place, item, 0) for t in range(at - first) for item, place in short_matches(texts[first + t], pattern, of)}
                    for t, place, item, e in sorted(found):
                        out[first + t].append({"item_id": None if null[item] else int(ids[item]), "start": place, "edits": e})
            yield pd.Series(out)

    return run


def index_files(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str) -> list[str]:
    """The files of the benchmark's index, written by tasks; one path for BLOCK characters."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = rows.repartition(1 + size // BLOCK, F.xxhash64("item_id", "text"))
    return sorted(r[0] for r in rows.mapInPandas(indexer(shared_dir(spark, "benchmark")), "uri string, n long").collect())


def found_in(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Column:
    """A column over docs of what each row's text holds of the benchmark."""
    spark = tuned(docs.sparkSession)
    run = finder(index_files(spark, benchmark, item_col, item_text_col))

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    return F.pandas_udf(find, FOUND)(F.col(text_col))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_regions, fewest_edits): for each row of docs the items that it holds.

    A document holds an item if, both in lower case with single blanks, some part of it matches
    a segment of the item (SEGMENT characters, or the whole item) with at most EDITS edits per
    character; items under 4 * Q characters must match unedited, those under LEAST besides
    between word borders, and those under Q as the whole text. Null and empty texts and items match
    nothing; repeated items match alike; each row is judged by its own text, whatever its id.
    No documents or no items: an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", found_in(rows, benchmark, "text", item_col, item_text_col).alias("found"))
    one = F.transform(F.array_distinct(F.transform("found", lambda x: x["item_id"])), lambda i: F.struct(i.alias("item_id"), F.filter("found", lambda x: x["item_id"].eqNullSafe(i)).alias("own")))
    rows = found.select("doc_id", F.explode(one).alias("x"))
    return rows.select("doc_id", "x.item_id", F.size("x.own").cast("long").alias("n_regions"), F.array_min(F.transform("x.own", lambda x: x["edits"])).alias("fewest_edits"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, first_item, fewest_edits) for every row of docs: how many
    items it holds as told at leaks, the smallest of them, and the fewest edits of any match (both
    null if none)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", found_in(rows, benchmark, "text", item_col, item_text_col).alias("found"))
    items = F.array_distinct(F.transform("found", lambda x: x["item_id"]))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_min(items).alias("first_item"), F.array_min(F.transform("found", lambda x: x["edits"])).alias("fewest_edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item as told at leaks, with the columns of docs."""
    name = fresh(docs, "x_found")
    rows = docs.withColumn(name, F.size(found_in(docs, benchmark, text_col, "item_id", "text")))
    return rows.filter(F.col(name) == 0).select(*[docs[f"`{c}`"] for c in docs.columns])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
