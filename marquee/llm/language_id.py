"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, the character n-grams frequent in it (a share of at least
LEAST_SHARE of its n-grams, so a bounded number) and not far rarer than in another language.
They go into one Bloom filter with a bitmask of languages in every slot: the masks at an
n-gram's slots, ANDed, name all languages that contain it. A text's n-grams are counted per
language; each count is corrected by the rate at which that language's bit is set by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import cut, mix, tuned

#: Lengths of n-grams; a word's edges count as a blank.
ORDERS = (2, 3, 4)
#: Documents of each language used for training, chosen by hash.
SAMPLE = 10_000
#: A language contains an n-gram that makes up at least this share of its n-grams and has at
#: least this part of its share in any language.
LEAST_SHARE, LEAST_PART = 1e-6, 0.1
#: Slots per n-gram, hash functions.
ROOM, HASHES = 4, 2
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text each belongs to, and the texts that have a
    letter. Case is folded, and all but letters are blanks, of which runs count once."""
    codes = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    which = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    c = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    is_letter = letters()[c]
    has = np.zeros(len(texts), bool)
    has[which[is_letter]] = True
    keep = is_letter | np.r_[True, is_letter[:-1] | (which[1:] != which[:-1])] if len(c) else is_letter
    c, which, is_letter = np.where(is_letter, c, 32)[keep].astype(np.uint64), which[keep], is_letter[keep]
    out, owner = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - n + 1 + i]
            # no blank inside, and both ends in one text
            ok = which[n - 1 :] == which[: len(c) - n + 1]
            for i in range(1, n - 1):
                ok &= is_letter[i : len(c) - n + 1 + i]
            ok &= is_letter[: len(ok)] | is_letter[n - 1 :]
            out.append(mix(h[ok]))
            owner.append(which[: len(ok)][ok])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(out), np.concatenate(owner), has


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (lang, text) to counts (lang, gram, n), merged over a task's batches in parts."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": key.view(np.int64), "n": n})

    for batch in batches:
        for at in range(0, len(batch), 200):
            for lang, part in batch.iloc[at : at + 200].groupby("lang"):
                h, _, _ = grams(part["text"].tolist())
                held.setdefault(lang, []).append(h)
                size += len(h)
        if size > 8_000_000:
            yield from out()
            held, size = {}, 0
    yield from out()


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES slots for each n-gram, from different bits of its hash."""
    return [((h >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


def build_filter(masks: DataFrame, bits: int, words: int) -> np.ndarray:
    """The filter of rows (gram, word, mask): an array of 2**bits slots by words of 64 languages."""
    rows = None
    for i in range(HASHES):
        slot = F.shiftrightunsigned("gram", i * bits).bitwiseAND((1 << bits) - 1)
        part = masks.select(slot.alias("slot"), "word", "mask")
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # a row per slot at most
    out = np.zeros((1 << bits, words), np.uint64)
    out[got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def predictor(shared, languages: list[str], bits: int, fallback: int) -> Callable:
    """Rows (id, text) to (id, lang_pred, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, chance = shared.value
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                n = len(part)
                h, owner, has = grams(part["text"].tolist())
                places = slots(h, bits)
                counts = np.zeros((n, len(languages)))
                for w in range(table.shape[1]):
                    mask = table[places[0], w]
                    for p in places[1:]:
                        mask = mask & table[p, w]
                    for b in range(min(64, len(languages) - 64 * w)):
                        bit = (mask >> np.array(b, mask.dtype)) & np.array(1, mask.dtype)
                        counts[:, 64 * w + b] = np.bincount(owner, bit, n)
                total = np.bincount(owner, minlength=n)[:, None]
                true = np.maximum(counts - total * chance, 0) / (1 - chance)
                every = true.sum(1)
                best = np.where(every > 0, true.argmax(1), fallback)
                score = np.where(every > 0, true.max(1, initial=0) / np.maximum(every, 1e-9), 1 / max(1, len(languages)))
                names = np.array([*languages, UNDETERMINED], object)
                known = has & (len(languages) > 0)
                yield pd.DataFrame({"id": part["id"].astype("Int64"), "lang_pred": names[np.where(known, best, len(languages))], "score": np.where(known, score, 0.0)})

    return run


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Training reads text and non-null language of rows whose crc32 of the id as text, modulo
    held_out[0], is not held_out[1]; of each language SAMPLE documents at most, chosen by a hash
    of the id. Texts that are null or have no letter, and all texts when there is nothing to
    learn from, are `und` with score 0. A text none of whose n-grams is known gets the commonest
    language. Ties go to the language first in code-point order. Null ids are held as empty
    text. Rows that repeat are scored alike; an empty table gives an empty result.
    """
    spark = tuned(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    part = F.crc32(key.cast("binary")) % held_out[0] == held_out[1]
    known = docs.filter(~part & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key).alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    names = sorted(sizes)
    table, chance, bits, fallback = np.zeros((1, 1), np.uint64), np.zeros(max(1, len(names))), 0, 0
    if names:
        share = spark.createDataFrame([(x, min(1.0, SAMPLE / sizes[x]), i) for i, x in enumerate(names)], "lang string, share double, place int")
        rate = (F.col("h").bitwiseAND((1 << 53) - 1)) / F.lit(float(1 << 53))
        sample = known.join(F.broadcast(share), "lang").filter(rate < F.col("share")).select("lang", "text")
        counts = cut(sample.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInPandas(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        rates = counts.join(F.broadcast(totals), "lang").filter("n > 1").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= LEAST_SHARE)
        most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
        kept = rates.join(most, "gram").filter(F.col("rate") >= LEAST_PART * F.col("most")).join(F.broadcast(share), "lang")
        masks = cut(kept.groupBy("gram", F.expr("place div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("mask")), "masks")
        n = masks.select("gram").distinct().count()
        bits = max(10, (ROOM * n).bit_length())
        table = build_filter(masks, bits, (len(names) + 63) // 64)
        if len(names) <= 8:
            table = table.astype(np.uint8)
        filled = np.array([np.mean((table[:, i // 64] >> np.array(i % 64, table.dtype)) & np.array(1, table.dtype)) for i in range(len(names))])
        chance = np.minimum(filled**HASHES, 0.999)
        fallback = max(range(len(names)), key=lambda i: (sizes[names[i]], -i))
    shared = spark.sparkContext.broadcast((table, chance))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(predictor(shared, names, bits, fallback), "id long, lang_pred string, score double")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return out.select(F.col("id").alias("doc_id"), (F.crc32(key.cast("binary")) % held_out[0] == held_out[1]).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
