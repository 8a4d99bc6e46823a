"""Quality by a sparse rule ensemble, compiled into Spark column expressions.

Statistics of each text are computed once. Shallow boosted trees are grown on a bounded sample
of labelled rows; every path from a root to a node is a rule, a conjunction of thresholds on
statistics. A lasso logistic regression over the rules keeps a few, and the score of a row is a
plain column expression over its statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import tuned

STATISTICS = (
    "chars", "words", "lines", "word_len", "long_words", "upper", "digit", "symbol", "punct", "pipe", "accent",
    "distinct", "top_word", "run", "line_len", "line_repeat", "stops", "caps_words", "marked_words", "one_char",
)
#: Labelled rows used for fitting, chosen by hash; trees, their depth; bins of a statistic.
SAMPLE, TREES, DEPTH, BINS, RATE = 20_000, 40, 3, 64, 0.3
#: Lasso: the penalty per row, and steps of the proximal gradient method.
PENALTY, STEPS = 2e-3, 400

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other symbol, 6 blank, 7 beyond ASCII
_KIND[33:127] = 5
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
for _c in b".,;:!?'\"-":
    _KIND[_c] = 4
for _c in b" \t\n\r\x0b\x0c":
    _KIND[_c] = 6
_KIND[128:] = 7


def statistics(text: str | None) -> list[float]:
    """The statistics of a text; all 0 for a null, empty or blank one, but for its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = raw.split()
    if not w:
        return [float(len(text or ""))] + [0.0] * (len(STATISTICS) - 1)
    n, size = len(w), len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    count = Counter(w)
    lens = list(map(len, w))
    lines = raw.split(b"\n")
    run = longest = 1
    for a, b in zip(w, w[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    solid = max(1, size - kinds[6])
    most = count.most_common(1)[0][1]
    return [
        len(text), n, len(lines), sum(lens) / n, sum(x > 20 for x in lens) / n, kinds[2] / solid, kinds[3] / solid, kinds[5] / solid, kinds[4] / solid, raw.count(b"|") / n, kinds[7] / solid,
        len(count) / n, most / n, longest, size / len(lines), 1 - len(set(lines)) / len(lines), sum(x <= 3 for x in lens) / n, sum(map(bytes.isupper, w)) / n, sum(not x[-1:].isalnum() and x[-1] < 128 for x in w) / n, sum(x == 1 for x in lens) / n,
    ]


def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([statistics(t) for t in batch["text"]], columns=list(STATISTICS), dtype=np.float64)
        out.insert(0, "id", batch["id"].astype("Int64").array)
        yield out


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list[Rule]:
    """Rules of boosted trees for the logistic loss, in the order they were found."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    score, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            below = []
            for rows, rule in nodes:
                if rule:
                    rules.setdefault(tuple(sorted(rule)), None)
                best = (1e-3, None)
                if level < depth and len(rows) >= 20:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1]
                        hl = np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                        nl = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < 5) | (nl > len(rows) - 5)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (f, k))
                if best[1] is None:
                    score[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                f, k = best[1]
                left = binned[rows, f] <= k
                below += [(rows[left], (*rule, (f, False, float(cuts[f][k])))), (rows[~left], (*rule, (f, True, float(cuts[f][k]))))]
            nodes = below
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression of y on z with an L1 penalty (FISTA)."""
    n, m = z.shape
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b, w = np.log(base / (1 - base)), np.zeros(m)
    bb, ww, t = b, w.copy(), 1.0
    v = np.ones(m)
    for _ in range(15):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / (float(v @ (z.T @ (z @ v))) + n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(bb + z @ ww))) - y
        nb, nw = bb - step * r.mean(), ww - step * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bb, ww = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


def compiled(rules: list[Rule], intercept: float, weights: np.ndarray, columns=STATISTICS) -> Column:
    """The score of a row of statistics as a column expression."""
    total = F.lit(intercept)
    for rule, w in zip(rules, weights, strict=True):
        if w:
            all_of = F.lit(True)
            for f, above, t in rule:
                all_of &= F.col(columns[f]) > t if above else F.col(columns[f]) <= t
            total += F.when(all_of, F.lit(float(w))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(sample: pd.DataFrame) -> Column:
    """The score expression learned from rows of statistics and label, in the order of ids."""
    sample = sample.sort_values(["id", "label", *STATISTICS])
    x, y = sample[list(STATISTICS)].to_numpy(np.float64), sample["label"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:
        return F.lit(float(y.mean()) if len(y) else 0.5)
    rules = grow(x, y)
    if not rules:
        return F.lit(float(y.mean()))
    z = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    return compiled(rules, *lasso(z, y))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Learns from rows whose id is labelled and whose crc32 of the id as text, modulo held_out[0],
    is not held_out[1]; at most about SAMPLE of them, chosen by a hash of the id. Null labels and
    repeated label rows beyond the smallest are ignored. Without labels of both kinds the score
    is the share of label 1, or 0.5. Null and empty texts are scored by their statistics (all
    0). An empty table gives an empty result. Only ids and texts of docs are read.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, " + ", ".join(f"`{c}` double" for c in STATISTICS)
    key = F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")
    part = F.crc32(key) % held_out[0] == held_out[1]
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label")).filter(~part)
    share = min(1.0, SAMPLE / max(1, known.count()))
    known = known.filter(F.xxhash64("id").bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53)) < share)
    sample = rows.join(F.broadcast(known), "id").select("id", "text", "label")  # about SAMPLE rows
    with_label = sample.select("id", "text").mapInPandas(described, schema).join(F.broadcast(known), "id")
    score = fit(with_label.toPandas())
    out = rows.mapInPandas(described, schema).select("id", part.alias("held_out"), score.alias("score"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
