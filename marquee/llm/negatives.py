"""Hard negatives by Kronecker-packed products.

Components are scaled to integers. A pack holds some thousands of rows of one label, a wide integer
for each dimension: every row has a field of its own there, wide enough that no sum of products
leaves it, and its component, with a bias that makes it positive, lies in that field. Multiplying
the integers of a pack by an anchor's components, one multiplication each, and adding up gives the
anchor's scores with all rows of the pack at once; fields are cut out as bytes, and what the bias
added is taken off again. All is integer arithmetic of unbounded width, so scores are exact.

Anchors are the stated query set; they meet all rows in blocks, packs by groups of bounded bytes.
A first product joins groups with packs of the same label and finds each anchor's positives; a
second joins them with packs of other labels and finds, for each positive's score, the best rows
between its shares of that score. A task keeps the few best of each anchor over all packs it
reads; windows over these partial results choose the last few. Ranges of (label, id, row) deal
rows to packs, so a label with a third of all rows spreads over as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import cut, tuned

#: Rows of a pack at most, bytes of a pack and of a group of anchors, and groups that are
#: broadcast together (more are joined by shuffle).
PACK, PACK_BYTES, GROUP_BYTES, GROUPS = 4_096, 2 << 20, 8 << 20, 8

Best = list[tuple[int, bool, int]]


def best(found: Best, n: int) -> Best:
    """The first n of (-score, id is null, id): by score, ties by smaller id, null ids last."""
    return sorted(found)[:n]


def packed(x: np.ndarray, bias: int, width: int) -> list[bytes]:
    """One wide integer for each column of x (rows, dimensions): the fields, width bytes each, of
    all rows with bias added."""
    fields = np.ascontiguousarray((x.T + bias).astype("<u8")).view(np.uint8).reshape(x.shape[1], x.shape[0], 8)
    return [np.ascontiguousarray(f[:, :width]).tobytes() for f in fields]


def products(wide: list[int], anchor: list[int], rows: int, bias: int, top: int, width: int) -> np.ndarray:
    """Inner products of an anchor with all rows of a pack; top is what no sum of the products of
    an anchor's components with biased ones exceeds in size."""
    raised = int.from_bytes(top.to_bytes(width, "little") * rows, "little")
    total = sum(map(mul, anchor, wide), raised)  # fields of raised + sum stay positive
    raw = np.frombuffer(total.to_bytes(rows * width, "little"), np.uint8).reshape(rows, width)
    fields = np.zeros((rows, 8), np.uint8)
    fields[:, :width] = raw
    return fields.view("<i8")[:, 0] - (top + bias * sum(anchor))


def make_packs(dims: int, size: int, bias: int, width: int) -> Callable:
    """Rows (label, id, x), sorted by label and id with nulls last, to packs (label, n, ids,
    wide): n rows, of which the last, those beyond ids, have null ids."""

    def pack(label, rows: list[tuple]) -> dict:
        x = np.zeros((len(rows), dims), np.int64)
        for i, (_, v) in enumerate(rows):
            x[i, : len(v)] = v
        return {"label": label, "n": len(rows), "ids": [i for i, _ in rows if i is not None], "wide": packed(x, bias, width)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, rows = None, []
        for batch in batches:
            for new, i, x in zip(batch["label"], batch["id"], batch["x"], strict=True):
                if rows and (new != label or len(rows) == size):
                    yield pd.DataFrame([pack(label, rows)])
                    rows = []
                label = new
                rows.append((None if pd.isna(i) else int(i), x))
        if rows:
            yield pd.DataFrame([pack(label, rows)])

    return run


def make_groups(dims: int) -> Callable:
    """Anchors (g, label, row, x, wanted), sorted by g, to groups (g, rows, labels, x, wanted, many):
    x as bytes of a matrix, wanted the scores of all anchors' positives, many how many each has."""

    def group(g: int, members: list[tuple]) -> dict:
        x = np.zeros((len(members), dims), np.int64)
        for i, (_, _, v, _) in enumerate(members):
            x[i, : len(v)] = v
        return {"g": g, "rows": [m[1] for m in members], "labels": [m[0] for m in members], "anchors": x.tobytes(), "wanted": [p for m in members for p in m[3]], "many": [len(m[3]) for m in members]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, members = None, []
        for batch in batches:
            for g, *member in zip(batch["g"], batch["label"], batch["row"], batch["x"], batch["wanted"], strict=True):
                if g != at and members:
                    yield pd.DataFrame([group(at, members)])
                    members = []
                at = g
                members.append(member)
        if members:
            yield pd.DataFrame([group(at, members)])

    return run


def multiplied(dims: int, bias: int, top: int, width: int, positives: int, negatives: int, low: int, high: int) -> Callable:
    """Packs with groups of anchors to (row, wanted, score, id). Where a group's anchors want
    nothing yet, the best rows of the anchor's own label, one more than positives as it may be
    among them; else, for each wanted positive score, the best rows of other labels whose score
    lies between low and high hundredths of it."""

    def results(state: dict) -> pd.DataFrame:
        flat = [(row, wanted, -score, None if none else i) for (row, wanted), found in state.items() for score, none, i in found]
        out = pd.DataFrame(flat, columns=["row", "wanted", "score", "id"])
        return out.astype({"wanted": "Int64", "id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple[int, int | None], Best] = {}
        groups: set[int] = set()
        for batch in batches:
            for label, size, ids, wide, g, rows, labels, anchors, wanted, many in zip(*(batch[c] for c in ("label", "n", "ids", "wide", "g", "rows", "labels", "anchors", "wanted", "many")), strict=True):
                if g not in groups and len(groups) >= GROUPS:
                    yield results(state)
                    state, groups = {}, set()
                groups.add(g)
                whole = [int.from_bytes(w, "little") for w in wide]
                x = np.frombuffer(anchors, np.int64).reshape(-1, dims)
                ends = np.cumsum(many)
                for i in np.flatnonzero(np.asarray(labels) == label if not len(wanted) else (np.asarray(labels) != label) & (np.asarray(many) > 0)):
                    scores = products(whole, x[i].tolist(), size, bias, top, width)
                    row = int(rows[i])
                    asked = [(None, None, None, positives + 1)] if not len(wanted) else [(p, -(-low * p // 100), high * p // 100, negatives) for p in map(int, wanted[ends[i] - many[i] : ends[i]])]
                    for p, least, most, n in asked:
                        had = state.get((row, p), [])
                        if len(had) == n:  # only as good a score as the last can still enter
                            least = -had[-1][0] if least is None else max(least, -had[-1][0])
                        fits = np.ones(len(scores), bool) if least is None else scores >= least
                        if most is not None:
                            fits &= scores <= most
                        at = np.flatnonzero(fits)
                        if len(at) > n:  # rows of a pack come by id, so a stable sort breaks ties as asked
                            at = at[np.argsort(-scores[at], kind="stable")[:n]]
                        if len(at):
                            new = [(-int(scores[j]), j >= len(ids), int(ids[j]) if j < len(ids) else 0) for j in at]
                            state[row, p] = best(had + new, n)
        yield results(state)

    return run


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: the condition, over the columns of rows, that makes a row an anchor. A component x
    counts as floor(scale * x); a score is the inner product of such components, missing ones of
    shorter vectors counting as 0. An anchor's positives are the first rows of its label, itself
    left out once; a positive's negatives are the first of the rows of other labels whose score
    lies between low and high hundredths of the positive's score (whole numbers; nothing lies
    between them where that score is below 0). Higher scores come first, ties by smaller id, null
    ids last. Rows with a null label or vector, or a component that is null or not finite, take
    no part. Repeated rows are rows each, as anchors too. A table without such rows gives an
    empty result. Scores must fit 61 bits: ValueError for components beyond that.
    """
    spark = tuned(rows.sparkSession)
    x = F.col(f"`{vector_col}`")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    some = rows.filter(F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & sound)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)))
    largest = F.array_max(F.transform(x, lambda v: F.abs(F.floor(v.cast("double") * float(scale)).cast("double"))))
    table = cut(some.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole.alias("x"), largest.alias("m"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")), "vectors")
    dims, most, asking = table.agg(F.max(F.size("x")), F.max("m"), F.count(F.when(F.col("anchor"), 1))).first()
    dims, bias = max(dims or 0, 1), int(most or 0) if (most or 0) < 1 << 62 else 1 << 62
    top = 2 * dims * bias * bias
    if top >= 1 << 61:
        raise ValueError(f"components of up to {bias} in {dims} dimensions give scores beyond 61 bits")
    width = max(1, ((2 * top).bit_length() + 7) // 8)
    size = max(64, min(PACK, PACK_BYTES // (dims * width)))
    groups = max(1, -(-asking * dims * 8 // GROUP_BYTES))

    dealt = table.repartitionByRange("label", "id", "row").sortWithinPartitions("label", F.asc_nulls_last("id"))
    packs = cut(dealt.select("label", "id", "x").mapInPandas(make_packs(dims, size, bias, width), "label long, n int, ids array<long>, wide array<binary>"), "packs")
    anchors = table.filter("anchor").select("row", "label", "x", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"))

    def product(asked: DataFrame) -> DataFrame:
        made = cut(asked.repartition("g").sortWithinPartitions("g", "row").mapInPandas(make_groups(dims), "g long, rows array<long>, labels array<long>, anchors binary, wanted array<long>, many array<int>"), "anchors")
        pairs = packs.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return pairs.join(F.broadcast(made) if groups <= GROUPS else made, "g").mapInPandas(multiplied(dims, bias, top, width, positives, negatives, low, high), "row long, wanted long, score long, id long")

    first = [F.desc("score"), F.asc_nulls_last("id")]
    near = product(anchors.withColumn("wanted", F.array().cast("array<long>"))).drop("wanted")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(*first))).filter(F.col("n") <= positives + 1)
    own = table.filter("anchor").select("row", F.col("id").alias("anchor_id"), F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v).alias("own"))
    near = near.join(own, "row")
    itself = F.when((F.col("score") == F.col("own")) & F.col("id").eqNullSafe(F.col("anchor_id")), F.col("n"))
    near = near.withColumn("itself", F.min(itself).over(Window.partitionBy("row")))
    place = F.col("n") - F.coalesce((F.col("n") > F.col("itself")).cast("int"), F.lit(0))
    near = cut(near.filter((F.coalesce(F.col("n") != F.col("itself"), F.lit(True))) & (place <= positives)).select("row", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    wanted = near.groupBy("row").agg(F.array_sort(F.collect_set("positive_score")).alias("wanted"))
    far = product(anchors.join(wanted, "row"))
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("row", "wanted").orderBy(*first))).filter(F.col("rank") <= negatives)
    out = near.join(far.select("row", F.col("wanted").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.lab AS alab, c.r AS cr, c.vec_id AS cid, c.lab AS clab,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda k: a.q[k] * c.q[k]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.r <> c.r),
p AS (SELECT * FROM s WHERE alab = clab QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, cid) <= 5),
n AS (SELECT p.anchor_id, p.cid AS positive_id, p.score AS positive_score, s.cid AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.cid) AS rank
  FROM p JOIN s ON p.ar = s.ar AND s.clab <> s.alab AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", shifted.alias("label")), F.col("vec_id") % 50 == 0)
