"""Language-model scoring with an Elias-Fano trie.

Counts cover all training tokens and are exact. The trie lists every word, and every bigram and
trigram that occurs at least LISTED times, at any size of the corpus. It lies in the shared folder
as shards, whose number grows with the tokens: words by ranges of their hashes, n-grams by ranges
of their contexts. Each shard is built and written by one task and memory-mapped by those that
need it; the driver knows the shards' paths and sizes only.

A word is named by its place among all words, an n-gram by its place in its level. Tasks count
n-grams of about BUFFER tokens at a time and hand them on as packed arrays, dealt by a hash of
the n-gram, so that no context is hot; what is listed then goes to the shard of its context. A
trigram's two bigrams are at least as frequent, so only trigrams of listed bigrams are counted.

Probabilities: an n-gram has its discounted relative frequency; others back off, with weights
that make probabilities sum to one before they are quantised. Single words are smoothed by
adding 0.1 to every count, with one word more for all unknown ones, and are not quantised.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrays import load, save
from marquee.llm.common import cut, mix, shared_dir, tuned, word_hashes, words
from marquee.llm.elias_fano import Level

#: Occurrences from which an n-gram is listed, and the part of each count that is set aside.
LISTED, DISCOUNT = 2, 0.75
#: Tokens of training for each shard of a level, and the fewest shards.
SHARD_TOKENS, SHARDS = 4_000_000, 16
#: Tokens that a task counts before it hands counts on.
BUFFER = 2_000_000
#: The token that ends a document, and stands before its first word.
END = word_hashes([b""])[0]


def sequences(batches: Iterator[pd.DataFrame], tokens: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of about so many tokens at a time: the rows' ids (where batches have them), their word
    hashes, an END before and behind each text, and the places where texts begin."""
    edge = np.array([END], np.uint64)
    ids, hashes, size = [], [], 0

    def out():
        return ids, np.concatenate(hashes), np.cumsum([0] + [len(x) for x in hashes[:-1]])

    for batch in batches:
        for key, text in zip(batch["id"] if "id" in batch else batch.index, batch["text"], strict=True):
            hashes.append(np.concatenate([edge, word_hashes(words(text)), edge]))
            ids.append(key)
            size += len(hashes[-1])
            if size >= tokens:
                yield out()
                ids, hashes, size = [], [], 0
    if hashes:
        yield out()


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, h, begins in sequences(batches, BUFFER):
        keep = np.ones(len(h), bool)
        keep[begins] = False
        key, n = np.unique(h[keep], return_counts=True)
        yield pd.DataFrame({"key": key.view(np.int64), "n": n})


class Words:
    """The words' shards (path, size): sorted hashes with counts."""

    def __init__(self, files: list[tuple[str | None, int]]):
        self.files, self.begins = files, np.cumsum([0] + [n for _, n in files])
        self.size = int(self.begins[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of sorted hashes; -1 and 0 where absent."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(33)).astype(np.int64) * len(self.files) >> 31
        for i, part in runs(shard, len(self.files)):
            if self.files[i][1]:
                data = load(self.files[i][0])
                at = np.minimum(np.searchsorted(data["words"], hashes[part]), self.files[i][1] - 1)
                hit = data["words"][at] == hashes[part]
                ids[part] = np.where(hit, self.begins[i] + at, -1)
                counts[part] = np.where(hit, data["counts"][at], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by place, in any order."""
        ids, inverse = np.unique(ids, return_inverse=True)
        out = np.zeros(len(ids), np.int64)
        for i, part in runs(np.searchsorted(self.begins, ids, "right") - 1, len(self.files)):
            out[part] = load(self.files[i][0])["counts"][ids[part] - self.begins[i]]
        return out[inverse]


class Grams:
    """A level's shards (path, size). contexts: how many there are; width: that of words."""

    def __init__(self, files: list[tuple[str | None, int]], contexts: int, width: int):
        self.files, self.begins = files, np.cumsum([0] + [n for _, n in files])
        self.size, self.contexts, self.width = int(self.begins[-1]), max(contexts, 1), max(width, 1)

    def low(self, shard: int) -> int:
        """The first context of a shard. A group's key is a NumPy int of 32 bits, in which the product
        would overflow."""
        return -(-int(shard) * self.contexts // len(self.files))

    def shard(self, context: np.ndarray) -> np.ndarray:
        return context * len(self.files) // self.contexts

    def find(self, keys: np.ndarray, kind: str = "p") -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys (context * width + word), -1 where absent; their log10
        probabilities (or for kind n counts), 0 where absent."""
        places, values = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        for i, part in runs(self.shard(keys // self.width), len(self.files)):
            if self.files[i][1]:
                level = Level(load(self.files[i][0]))
                at = level.find(keys[part] - self.low(i) * self.width, self.width)
                places[part] = np.where(at >= 0, self.begins[i] + at, -1)
                values[part] = np.where(at >= 0, level.counts[at] if kind == "n" else level.value("p", at), 0)
        return places, values

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """log10 weights of sorted contexts."""
        out = np.zeros(len(contexts))
        for i, part in runs(self.shard(contexts), len(self.files)):
            if self.files[i][1]:
                out[part] = Level(load(self.files[i][0])).value("b", contexts[part] - self.low(i))
        return out

    def grams(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words and counts of the n-grams at sorted places."""
        last, n = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for i, part in runs(np.searchsorted(self.begins, places, "right") - 1, len(self.files)):
            level = Level(load(self.files[i][0]))
            at = places[part] - self.begins[i]
            last[part], n[part] = level.keys(self.width)[at] % self.width, level.counts[at]
        return last, n


def runs(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Shards that occur among sorted ones, and where."""
    ends = np.searchsorted(shard, np.arange(shards + 1))
    for i in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(i), slice(int(ends[i]), int(ends[i + 1]))


def pack(shard: np.ndarray, keys: np.ndarray, n: np.ndarray, shards: int) -> pd.DataFrame:
    """A row for each shard: its sorted keys by their differences, and their counts. shard is sorted."""
    rows = [(i, np.diff(keys[x], prepend=0).tobytes(), n[x].tobytes()) for i, x in runs(shard, shards)]
    return pd.DataFrame(rows, columns=["shard", "keys", "n"])


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of the rows, sorted, and the sums of their counts."""
    keys = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in rows["keys"]])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["n"]])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(n, starts)


def after(values: np.ndarray, first: np.ndarray, empty=-1) -> np.ndarray:
    """The value before each token; empty where a text begins."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = empty
    return out


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and each key's place among them."""
    codes, unique = pd.factorize(keys)
    order = np.argsort(unique)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return unique[order], rank[codes]


def spread(valid: np.ndarray, inverse: np.ndarray, *found: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Of (values of distinct keys, what stands elsewhere): the values of the tokens that are valid."""
    out = [np.full(len(valid), empty) for _, empty in found]
    for x, (values, _) in zip(out, found, strict=True):
        x[valid] = values[inverse]
    return out


def weighed(grams: Grams, places: np.ndarray) -> np.ndarray:
    """grams.weights of sorted places, 0 where they are -1."""
    out = np.zeros(len(places))
    out[places >= 0] = grams.weights(places[places >= 0])
    return out


def count_grams(words: Words, two: Grams | None, shards: int) -> Callable:
    """Packed counts of bigrams, or with two of trigrams whose bigrams it lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, h, begins in sequences(batches, BUFFER):
            unique, inverse = ranked(h)
            ids = words.find(unique)[0][inverse]
            first = np.zeros(len(ids), bool)
            first[begins] = True
            context = after(ids, first)
            listed = (context >= 0) & (ids >= 0)
            if two:
                unique, inverse = ranked(context[listed] * words.size + ids[listed])
                (at,) = spread(listed, inverse, (two.find(unique)[0], -1))
                context = after(at, first)
                listed = (context >= 0) & (at >= 0)
            keys, n = np.unique(context[listed] * words.size + ids[listed], return_counts=True)
            shard = (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            yield pack(shard[order], keys[order], n[order].astype(np.int64), shards)

    return run


def train(docs: DataFrame) -> tuple[Words, Grams, Grams, int, int]:
    """Trains on the rows of docs (text): the trie's levels, the number of tokens and that of
    different ones."""
    spark = docs.sparkSession
    texts = docs.select("text")
    unigrams = cut(texts.mapInPandas(count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "unigrams")
    total, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    shards = max(SHARDS, total // SHARD_TOKENS)
    folder, built, packed = shared_dir(spark, "trie"), "shard int, size long, uri string", "shard int, keys binary, n binary"

    def files(df: DataFrame) -> list[tuple[str | None, int]]:
        found = {r["shard"]: (r["uri"], r["size"]) for r in df.collect()}  # a row for each shard
        return [found.get(i, (None, 0)) for i in range(shards)]

    def written(shard: int, size: int, parts: dict[str, np.ndarray]) -> pd.DataFrame:
        uri = f"{folder}/{uuid.uuid4().hex}"  # of this attempt
        save(parts, uri)
        return pd.DataFrame({"shard": [shard], "size": [size], "uri": [uri]})

    def write_words(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        return written(shard[0], len(h), {"words": h[order], "counts": rows["n"].to_numpy(np.int64)[order]})

    shard = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(shards), 31).cast("int")
    words = Words(files(unigrams.groupBy(shard.alias("shard")).applyInPandas(write_words, built)))

    def level(two: Grams | None) -> Grams:
        plan = Grams([(None, 0)] * shards, two.size if two else words.size, words.size)

        def listed(rows: pd.DataFrame) -> pd.DataFrame:
            keys, n = unpacked(rows)
            keys, n = keys[n >= LISTED], n[n >= LISTED]
            return pack(plan.shard(keys // plan.width), keys, n, shards)

        def write(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            keys, n = unpacked(rows)
            context, word = keys // plan.width, keys % plan.width
            one, inverse = np.unique(context, return_inverse=True)
            if two:
                middle, total_n = two.grams(one)
                middle = middle[inverse]
                lower, at = np.unique(middle * plan.width + word, return_inverse=True)
                below = (two.find(lower, "n")[1][at] - DISCOUNT) / words.counts(middle)
            else:
                total_n = words.counts(one)
                below = (words.counts(word) + 0.1) / (total + 0.1 * (distinct + 1))
            p = (n - DISCOUNT) / total_n[inverse]
            low = plan.low(shard[0])
            size = plan.low(shard[0] + 1) - low
            weight = (1 - np.bincount(context - low, p, size)) / (1 - np.bincount(context - low, below, size))
            return written(shard[0], len(keys), Level.build(context - low, word, n, p, weight))

        counted = texts.mapInPandas(count_grams(words, two, shards), packed).groupBy("shard").applyInPandas(listed, packed)
        return Grams(files(counted.groupBy("shard").applyInPandas(write, built)), plan.contexts, plan.width)

    two = level(None)
    return words, two, level(two), total, distinct


def scorer(words: Words, two: Grams, three: Grams, total: int, distinct: int) -> Callable:
    """Rows (id, text) to their scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.log10(total + 0.1 * (distinct + 1))
        for keys, h, begins in sequences(batches, BUFFER // 2):
            unique, inverse = ranked(h)
            ids, n = words.find(unique)
            weight = weighed(two, ids)[inverse]
            ids, n = ids[inverse], n[inverse]
            first = np.zeros(len(ids), bool)
            first[begins] = True
            known = (ids >= 0) & ~first
            base = np.where(first, 0.0, np.log10(n + 0.1) - floor)
            logs, at = base, ids
            for grams in (two, three):
                # words after the first level, places of bigrams after the second
                logs = logs + after(weight, first, 0.0)
                context = after(at, first)
                listed = (context >= 0) & (ids >= 0 if grams is two else at >= 0)
                unique, inverse = ranked(context[listed] * grams.width + ids[listed])
                places, p = grams.find(unique)
                more = weighed(three, places) if grams is two else np.zeros(len(places))
                at, p, weight = spread(listed, inverse, (places, -1), (p, 0.0), (more, 0.0))
                logs = np.where(at >= 0, p, logs)
            logs[first] = 0
            ends = np.r_[begins[1:], len(h)]
            yield pd.DataFrame({
                "id": pd.array([None if pd.isna(k) else k for k in keys], "Int64"),
                "n_tokens": ends - begins - 1,
                "n_known": np.add.reduceat(known.astype(np.int64), begins),
                "base": np.add.reduceat(base, begins),
                "score": np.add.reduceat(logs, begins),
            })

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Training rows are those whose crc32 of the id as text is not divisible by held_out_mod
    (null ids count as empty text and are held out). Null and empty texts have one token, the
    end. Without training rows every count is 0, and unknown words share all probability.
    Repeated rows count as often as they occur. An empty table gives an empty result. Other
    columns of docs are not read.
    """
    tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % held_out_mod == 0
    model = train(rows.filter(~held_out))
    schema = "id long, n_tokens long, n_known long, base double, score double"
    return rows.mapInPandas(scorer(*model), schema).select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model[3]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
