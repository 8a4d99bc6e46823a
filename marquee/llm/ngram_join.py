"""Similarity join of documents on word n-grams, as a blocked sparse matrix product.

Documents by n-grams form a sparse incidence matrix M; the entries of M Mᵀ are overlaps. Only
overlaps that can reach the threshold are formed:

* Texts with equal n-gram sets are one class; classes take part, copies do not.
* Of each set only the first part in a global order enters the product: two sets with enough
  overlap share an n-gram there. The order is by hash, with n-grams that crowd many sets last,
  rarest first.
* A block of the product holds some n-grams; a task multiplies its block, giving partial overlap
  counts of pairs whose sizes allow a link. Counts are summed over the blocks, and a pair whose
  count plus all that the rest of both sets could add stays below the bound is discarded.
* Pairs that remain are verified on whole sets.

A column of the matrix that stays crowded (a large group of near copies) is not multiplied out.
It is split by set size, and its sets are verified against one centre, the set with the fewest
n-grams of its own; those found in one component need no further comparison. The centre, with
all n-grams that crowd the column besides, is a common stock. A pair between components whose
overlaps with the stock both reach the pair's bound is verified; any other pair must share an
n-gram outside the stock, so what the sets hold outside it is multiplied instead.
So no link between different components is lost, and links within one need not be listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import attach, cut, mix, shingles, tuned, words
from marquee.llm.components import components

#: Columns with more sets than this are crowded; so many of the most crowded go last in the
#: order (8 bytes each on the driver; any choice gives the same links).
CROWDED, LAST = 48, 1 << 19
#: Rounds of comparing crowded columns with a centre; rows of a column that a task compares at once.
ROUNDS, BLOCK = 2, 250
#: N-grams that a task counts before it hands counts on, and for each task that adds counts up.
BUFFER, SHARD_GRAMS = 2_000_000, 1_000_000


def bound(n, num: int, den: int):
    """The part of a set of n n-grams that enters the product."""
    return n - (num * n + den - 1) // den + 1


def sketcher(k: int, num: int, den: int, spread: int, last) -> Callable:
    """Rows (id, text) to rows (id, n, s1, s2, head): set size, a 128-bit hash of the set, and
    the first n-grams in the global order, spread times as many as enter the product."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = last.value if last is not None else None
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                s = shingles(words(text), k)
                n = len(s)
                if late is not None and n:
                    grams, rank = late
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    s = s[np.argsort(np.where(grams[at] == s, rank[at], -1), kind="stable")]
                with np.errstate(over="ignore"):
                    s1 = int(mix(s).sum(dtype=np.uint64).view(np.int64)) if n else 0
                    s2 = int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64)) if n else 0
                head = s[: min(n, spread * bound(n, num, den))] if n else s
                out.append((key, n, s1, s2, head.view(np.int64)))
            frame = pd.DataFrame(out, columns=["id", "n", "s1", "s2", "head"])
            frame["id"] = frame["id"].astype("Int64")
            yield frame

    return run


def whole_sets(k: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "grams": [shingles(words(t), k).view(np.int64) for t in batch["text"]]})

    return run


def count_grams(k: int, shards: int) -> Callable:
    """Rows (text) to packed counts of the sets that hold each n-gram, in ranges of n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted((keys >> np.uint64(33)).astype(np.int64) * shards >> 31, np.arange(shards + 1))
            rows = [(i, keys[a:b].tobytes(), n[a:b].astype(np.int64).tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
            return pd.DataFrame(rows, columns=["shard", "keys", "n"])

        for batch in batches:
            for text in batch["text"]:
                held.append(shingles(words(text), k))
                size += len(held[-1])
                if size >= BUFFER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def add_counts(crowded: int) -> Callable:
    """Packed counts of one range to (gram, count) of n-grams counted more than crowded times."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in rows["keys"]])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["n"]])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.add.reduceat(n[order], starts)
        return pd.DataFrame({"gram": keys[starts][n > crowded], "count": n[n > crowded]})

    return run


def complete(batches: Iterator[pd.DataFrame], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Regroups sorted batches so that no gram is split between two of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        both = pd.concat(held, ignore_index=True)
        g = both["gram"].to_numpy()
        end = int(np.flatnonzero(g == g[-1])[0]) if g[0] != g[-1] else 0
        if end:
            yield both.iloc[:end]
        held, size = [both.iloc[end:]], 0 if end else -len(both)
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def product(num: int, den: int, crowded: int) -> Callable:
    """Rows (gram, id, n) or (gram, id, n, label) sorted by gram to partial overlap counts (a, b, na, nb, c) of pairs
    a < b whose sizes allow a link, with different labels; rows of crowded columns come back as (gram, a, na), c = 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in complete(batches):
            g, i, n = (part[c].to_numpy() for c in ("gram", "id", "n"))
            lab = part["label"].to_numpy() if "label" in part else i
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            lengths = np.diff(np.r_[starts, len(g)])
            each = np.repeat(lengths, lengths)
            big = each > crowded
            if big.any():
                yield pd.DataFrame({"gram": g[big], "a": i[big], "b": i[big], "na": n[big], "nb": n[big], "c": 0})
            some = (each > 1) & ~big
            g, i, n, lab = g[some], i[some], n[some], lab[some]
            found = []
            for d in range(1, int(lengths[(lengths <= crowded)].max(initial=1))):
                ok = np.flatnonzero(g[d:] == g[:-d])
                if not len(ok):
                    break
                x, y = ok, ok + d
                fit = (np.minimum(n[x], n[y]) * den >= num * np.maximum(n[x], n[y])) & (lab[x] != lab[y])
                x, y = x[fit], y[fit]
                swap = i[x] > i[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                found.append(np.stack([i[x], i[y], n[x], n[y]]))
            if found:
                pairs = pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b", "na", "nb"])
                pairs = pairs.groupby(["a", "b", "na", "nb"], sort=False).size().rename("c").reset_index()
                yield pairs.assign(gram=0)[["gram", "a", "b", "na", "nb", "c"]]

    return run


def across(num: int, den: int) -> Callable:
    """Rows (gram, i, j, stray, id, n, label, o), a block of a crowded column's strays and one of
    its rows for each (gram, i, j), to pairs (a, b) between labels whose overlaps o with the
    column's stock both reach what the pair's sizes ask for."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        one, other = (part[part["stray"] == x] for x in (True, False))
        i, n, lab, o = (other[c].to_numpy() for c in ("id", "n", "label", "o"))
        found = [np.empty((2, 0), np.int64)]
        for xi, xn, xl, xo in zip(*(one[c].tolist() for c in ("id", "n", "label", "o")), strict=True):
            y = i[(lab != xl) & (np.minimum(o, xo) * (den + num) >= num * (n + xn))]
            found.append(np.stack([np.minimum(xi, y), np.maximum(xi, y)]))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) of pairs (a, b): whole set sizes and overlap."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("both"))


def linked(checked: DataFrame, num: int, den: int) -> DataFrame:
    return checked.filter(F.col("both") * (den + num) >= num * (F.col("na") + F.col("nb"))).select("a", "b")


def most_crowded(counts: DataFrame) -> DataFrame:
    """The LAST most frequent of counts (gram, count)."""
    return cut(counts.orderBy(F.desc("count"), "gram").limit(LAST), "late")


def ranked(late: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams, sorted, and their places in the order of counts, rarest first."""
    late = late.sort_values(["count", "gram"])
    grams = late["gram"].to_numpy(np.int64).view(np.uint64)
    by_gram = np.argsort(grams)
    return grams[by_gram], by_gram


def holding(rows: DataFrame, column: str, late: DataFrame) -> DataFrame:
    """Ids of rows of which column holds one of late, at most 2 * LAST values."""
    return rows.select("id", F.explode(column).alias("gram")).join(F.broadcast(late), "gram").select("id").distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    A set holds the distinct k-word shingles of a text (A-Z lower-cased; of fewer words, the
    whole sequence). Texts link at a Jaccard similarity of percent / 100 or more; component_id
    is the smallest id reachable by links. Null and wordless texts have empty sets and link with
    nothing, not even with one another. Texts with the same smallest id are one node. A row whose
    id is null gets the component of a text with an equal set, or null. An empty table gives an
    empty result. Other columns of docs are not read.
    """
    spark = tuned(docs.sparkSession)
    num, den = percent, 100
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = "id long, n int, s1 long, s2 long, head array<long>"
    heads = cut(texts.mapInPandas(sketcher(k, num, den, 2, None), sketch), "heads")
    classes = heads.filter("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "head")).alias("m"))
    classes = cut(classes.select("s1", "s2", "n", F.col("m.id").alias("id"), F.col("m.head").alias("head")), "classes")

    # crowded n-grams go last in the order: those near the front of many sets, and of the sets
    # that hold such, all that many of them share
    late = most_crowded(classes.select(F.explode("head").alias("gram")).groupBy("gram").count().filter(F.col("count") > crowded))
    entering = F.slice("head", 1, F.expr(f"least(size(head), n - cast(ceil({num} * n / {den}D - 1e-9) as int) + 1)"))
    ready = classes.select("id", "n", entering.alias("head"))
    if not late.isEmpty():
        held = cut(holding(classes, "head", late), "held")
        shards = max(16, classes.agg(F.sum("n")).first()[0] // SHARD_GRAMS)
        counts = attach(texts, held, ["id"], "left_semi").select("text").mapInPandas(count_grams(k, shards), "shard int, keys binary, n binary")
        late = late.union(most_crowded(counts.groupBy("shard").applyInPandas(add_counts(crowded), "gram long, count long")))
        late = cut(late.groupBy("gram").agg(F.max("count").alias("count")), "late")
        order = spark.sparkContext.broadcast(ranked(late.toPandas()))
        moved = cut(holding(ready, "head", late), "moved")
        again = attach(texts, moved, ["id"], "left_semi").mapInPandas(sketcher(k, num, den, 1, order), sketch)
        ready = attach(ready, moved, ["id"], "left_anti").unionByName(cut(again.select("id", "n", "head"), "again"))
    entries = ready.select(F.explode("head").alias("gram"), "id", "n")
    columns = None
    if not late.isEmpty():
        # columns known to be crowded stay where they are read; no task gathers one
        known = entries.join(F.broadcast(late.select("gram")), "gram").groupBy("gram").count().filter(F.col("count") > crowded)
        known = cut(known.select("gram"), "known")  # 2 * LAST rows of 8 bytes at most
        columns = cut(entries.join(F.broadcast(known), "gram", "left_semi"), "columns")
        entries = entries.join(F.broadcast(known), "gram", "left_anti")
    schema = "gram long, a long, b long, na int, nb int, c long"
    entries = entries.repartition("gram").sortWithinPartitions("gram").select("gram", "id", "n")
    parts = cut(entries.mapInPandas(product(num, den, crowded), schema), "overlaps")

    pairs = parts.filter("c > 0").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"))
    more = parts.filter("c = 0").select("gram", F.col("a").alias("id"), F.col("na").alias("n"))
    columns = more if columns is None else columns.select("gram", "id", "n").unionByName(more)
    crowd = columns.groupBy("id").count()
    for x in "ab":
        pairs = pairs.join(crowd.select(F.col("id").alias(x), F.col("count").alias(f"k{x}")), x, "left")
    # overlap at most: counted, plus in crowded columns, plus behind the part that entered
    rest = reduce(F.greatest, [F.expr(f"n{x} - (n{x} - cast(ceil({num} * n{x} / {den}D - 1e-9) as int) + 1)") for x in "ab"])
    most = F.col("c") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) + rest
    pairs = cut(pairs.filter(most * (den + num) >= num * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(columns.select("id")).distinct()
    ids = cut(ids, "wanted")
    sets = cut(attach(texts, ids, ["id"], "left_semi").mapInPandas(whole_sets(k), "id long, grams array<long>"), "sets")
    links = cut(linked(verified(pairs, sets), num, den), "links")
    names = components(links)

    columns = cut(columns, "crowded")
    if not columns.isEmpty():
        names = crowded_links(columns, sets, links, names, late, num, den, crowded)

    of_class = classes.select("s1", "s2", "n", F.col("id").alias("node")).join(names, "node", "left")
    of_class = cut(of_class.select("s1", "s2", "n", F.coalesce("label", "node").alias("label")), "labels")
    rows = attach(heads.select("id", "n", "s1", "s2"), of_class, ["s1", "s2", "n"])
    return rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the row with its smallest id stays, with
    the columns of docs. Rows without an id stay."""
    found = ngram_components(docs, id_col, text_col, k, percent)
    gone = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return attach(docs, gone, [id_col], "left_anti").select(*docs.columns)


def commonest(rows: DataFrame) -> DataFrame:
    """(gram, common): the label that most rows (gram, label) of each gram bear. Counts of labels
    are added up before they move; no task gathers a column."""
    return rows.groupBy("gram", "label").count().groupBy("gram").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("common"))


def centred(rows: DataFrame, round_: int) -> DataFrame:
    """rows (gram, id, n, own, label) with centre and clabel of their column in this round: the
    set with the smallest part of its own; in later rounds, outside the column's largest label."""
    aside = F.lit(0)
    if round_:
        rows = attach(rows, cut(commonest(rows), "common"), ["gram"], "inner")
        aside = (F.col("label") == F.col("common")).cast("int")
    best = rows.groupBy("gram").agg(F.min_by(F.struct("id", "label"), F.struct(aside, "own", -F.col("n"), F.xxhash64("id"))).alias("m"))
    return attach(rows, cut(best, "centres"), ["gram"], "inner").select("gram", "id", "n", "label", F.col("m.id").alias("centre"), F.col("m.label").alias("clabel"))


def crowded_links(columns: DataFrame, sets: DataFrame, links: DataFrame, names: DataFrame, late: DataFrame, num: int, den: int, crowded: int) -> DataFrame:
    """Components once the crowded columns' links are added to links."""
    # the part of each set that is not crowded anywhere
    common = sets.select("id", F.explode("grams").alias("gram")).join(F.broadcast(late.select("gram")), "gram").groupBy("id").agg(F.count(F.lit(1)).alias("common"))
    columns = columns.join(common, "id", "left").withColumn("own", 1 - F.coalesce("common", F.lit(0)) / F.col("n"))
    # two sets that may link are in the same or in neighbouring classes of size
    size = F.floor(F.log("n") / float(np.log(den / num * 1.0001)))
    columns = columns.select("gram", "id", "n", "own", F.explode(F.array(size, size - 1)).alias("size"))
    columns = cut(columns.select(F.xxhash64("gram", "size").alias("gram"), "id", "n", "own"), "crowded")
    labelled = named(columns, names)
    first = None
    for r in range(ROUNDS):
        rows = cut(centred(labelled, r), "columns")
        if rows.isEmpty():
            return names
        apart = (F.col("id") != F.col("centre")) & (F.lit(r == 0) | (F.col("label") != F.col("clabel")))
        stars = rows.filter(apart).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        checked = cut(verified(stars, sets), "stars")
        if first is None:
            first = rows.select("gram", "centre").distinct(), checked
        links = cut(links.unionByName(linked(checked, num, den)), "links")
        names = components(links)
        labelled = named(columns, names)
    centres, checked = first
    overlap = checked.select(F.col("a").alias("centre"), F.col("b").alias("id"), F.col("both").alias("o"))
    overlap = overlap.unionByName(checked.select(F.col("b").alias("centre"), F.col("a").alias("id"), F.col("both").alias("o"))).distinct()
    # a centre itself has been compared with all its column
    rows = cut(attach(labelled, cut(centres, "centres"), ["gram"], "inner").join(overlap, ["centre", "id"]), "measured")
    members = rows.select("centre", "id", "n", "label").distinct()
    both = members.join(sets, "id").join(sets.select(F.col("id").alias("centre"), F.col("grams").alias("stock")), "centre")
    extra = both.select("centre", "id", "n", "label", F.explode(F.array_except("grams", "stock")).alias("gram"))
    extra = cut(extra.withColumn("gram", F.xxhash64("centre", "gram")), "extra")
    stock = cut(extra.groupBy("gram").count().filter(F.col("count") > crowded).select("gram"), "stock")
    more = extra.join(stock, "gram", "left_semi").groupBy("centre", "id").agg(F.count(F.lit(1)).alias("more"))
    rows = rows.join(more, ["centre", "id"], "left").withColumn("o", F.col("o") + F.coalesce("more", F.lit(0)))
    near = blocks(rows.select("gram", "id", "n", "label", "o"), num, den).groupBy("gram", "i", "j").applyInPandas(across(num, den), "a long, b long")
    rest = extra.join(stock, "gram", "left_anti").select("gram", "id", "n", "label").repartition("gram").sortWithinPartitions("gram")
    beyond = rest.mapInPandas(product(num, den, crowded), "gram long, a long, b long, na int, nb int, c long").select("a", "b")
    left = cut(near.union(beyond).distinct(), "across")
    if left.isEmpty():
        return names
    return components(links.unionByName(linked(verified(left, sets), num, den)))


def blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (gram, id, n, label, o) dealt for across, so that each row outside its column's
    commonest label, a stray, meets each row of the column in one block. A pair asks for an
    overlap of num / den of either set at least, so rows with less are left out."""
    rows = cut(rows.filter(F.col("o") * den >= num * F.col("n")), "near")
    common = cut(commonest(rows), "common")
    rows = attach(rows, common, ["gram"], "inner").withColumn("stray", F.col("label") != F.col("common"))
    sizes = rows.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"), F.ceil(F.sum(F.col("stray").cast("int")) / BLOCK).cast("int").alias("strays"))
    rows = attach(rows, cut(sizes.filter("strays > 0"), "sizes"), ["gram"], "inner")

    def dealt(n: str, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    columns = ("gram", "i", "j", "stray", "id", "n", "label", "o")
    one = rows.filter("stray").withColumn("i", dealt("strays", 1)).withColumn("j", each("all")).select(*columns)
    other = rows.withColumn("stray", F.lit(False)).withColumn("j", dealt("all", 2)).withColumn("i", each("strays")).select(*columns)
    return one.unionByName(other)


def named(columns: DataFrame, names: DataFrame) -> DataFrame:
    """columns (gram, id, n, own) with labels, of those that hold more than one label."""
    rows = columns.join(names.select(F.col("node").alias("id"), "label"), "id", "left").select("gram", "id", "n", "own", F.coalesce("label", "id").alias("label"))
    rows = cut(rows, "named")
    mixed = rows.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("gram")
    return attach(rows, cut(mixed, "mixed"), ["gram"], "left_semi")


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, n_shingles AS n, unnest(s) AS g FROM s JOIN n USING (doc_id)),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY x.doc_id, y.doc_id HAVING 185 * count(*) >= 85 * (any_value(x.n) + any_value(y.n))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON n.doc_id = r.a GROUP BY n.doc_id, n.n_shingles
"""


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
