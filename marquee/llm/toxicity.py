"""Toxicity by weak supervision.

Many voters look at each text: word lists of several languages, patterns, and terms mined from
labelled rows (words and word beginnings that occur almost only in toxic texts). A generative
model explains all votes of the corpus by a hidden class: it estimates how often each voter
votes in either class, and from what the classes leave unexplained, which voters copy one
another; those share their say. (Estimating rates anew under these shares lowered held-out recall
in a trial, so rates stay.) A known label is an observed class: rows that have one anchor the two
classes. (As one voter more of high accuracy they lost toxic rows where labels are few.) The
posterior of the class labels a bounded sample of texts, labelled or not, on which a linear
classifier over hashed words and word beginnings is trained; it scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import attach, cut, fresh, text_hashes, tuned

#: Word lists, a voter each.
LEXICONS = {
    "insults_en": "idiot idiots moron morons stupid dumb dumbass fool imbecile retard loser losers clown clowns pathetic worthless scum trash garbage filth vermin pig",
    "slights_en": "disgusting disgrace ugly useless failure coward liar freak creep jerk nobody ignorant brainless spineless repulsive vile",
    "profanity_en": "fuck fucking fucker shit shitty bullshit bitch bastard asshole ass crap damn piss slut whore dick prick cunt twat",
    "threats_en": "kill hang burn shoot stab destroy exterminate deport",
    "insults_de": "idiot idioten dumm dummkopf trottel vollidiot arschloch abschaum versager schwein drecksau wertlos ekelhaft hurensohn scheiße schlampe",
    "insults_fr": "idiot idiote crétin imbécile abruti con connard connasse salaud salope ordure déchet minable dégueulasse merde putain",
    "insults_es": "idiota imbécil estúpido estúpida tonto basura escoria inútil asqueroso mierda puta cabrón gilipollas pendejo perdedor patético",
}
#: Patterns over the lower-cased text, a voter each.
PATTERNS = {
    "address_en": r"you(?<!\wyou)(?:'re| are)? (?:an?|all|such an?|nothing but) ?(?:idiot|moron|loser|clown|fool|pig|joke|disgrace)",
    "imperative_en": r"\b(?:shut up|go to hell|get lost|drop dead|go die)\b",
    "hate_en": r"\bi hate (?:you|them|these|all)\b|\bhate (?:you|them) all\b",
    "masked": r"\b[a-z]+[*@#$]{2,}[a-z]*\b",
}
#: Mined voters at most; hashed features; lengths of word beginnings, and shares of a text's
#: words from which a beginning counts, a feature each.
MINED, DIMENSIONS, BEGINNINGS, DENSE = 48, 1 << 20, (4, 5, 6, 7), (0.006, 0.012)
#: Labelled rows from which voters are mined, and rows that train the classifier.
LABELLED, SAMPLE = 20_000, 24_000
#: Evidence that a feature needs to enter the classifier.
LEAST_TOXIC, LIFT = 2.5, 4
#: Weight of a row without a known label against one with it.
UNLABELLED = 0.3
#: Rounds of the label model.
ROUNDS = 15

_STRIP = ".,;:!?\"'()[]{}*#$%&|<>«»“”…-"
_SETS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
#: What a text must hold for a pattern to match at all: one of these, found faster than the pattern.
_HINTS = {"address_en": ("you",), "imperative_en": ("shut up", "go to hell", "get lost", "drop dead", "go die"), "hate_en": ("hate ",), "masked": tuple(a + b for a in "*@#$" for b in "*@#$")}
BASE_VOTERS = (*_SETS, *_PATTERNS)


def terms(text: str | None) -> Counter[str]:
    """A text's words with their counts, lower-cased, without marks around them."""
    out: Counter[str] = Counter()
    for x, n in Counter((text or "").lower().split()).items():
        if w := x.strip(_STRIP):
            out[w] += n
    return out


def features(found: Counter[str]) -> np.ndarray:
    """Sorted distinct places, among DIMENSIONS, of a text's words and of the word beginnings
    that make up at least the shares DENSE of its words."""
    keys = list(found)
    total = found.total()
    for size in BEGINNINGS:
        heads: dict[str, int] = {}
        for w, n in found.items():
            if len(w) > size:
                h = w[:size]
                heads[h] = heads.get(h, 0) + n
        for i, part in enumerate(DENSE, 1):
            keys += ["^" * i + h for h, n in heads.items() if n >= part * total]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.unique((h % np.uint64(DIMENSIONS)).astype(np.int64))


def count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (text, label) to (place, texts, toxic texts)."""
    every, toxic = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            f = features(terms(text))
            every[f] += 1
            if label:
                toxic[f] += 1
    at = np.flatnonzero(every)
    yield pd.DataFrame({"place": at, "texts": every[at], "toxic": toxic[at]})


def votes(text: str | None, mined: np.ndarray) -> tuple[int, np.ndarray]:
    """The votes on a text as bits, and its features."""
    found = terms(text)
    bits = 0
    for i, words in enumerate(_SETS.values()):
        if not found.keys().isdisjoint(words):
            bits |= 1 << i
    low = (text or "").lower()
    for i, (k, p) in enumerate(_PATTERNS.items(), len(_SETS)):
        if any(x in low for x in _HINTS[k]) and p.search(low):
            bits |= 1 << i
    f = features(found)
    at = np.searchsorted(f, mined)
    for i in np.flatnonzero(f[np.minimum(at, len(f) - 1)] == mined) if len(f) else ():
        bits |= 1 << (len(BASE_VOTERS) + int(i))
    return bits, f


def voter(shared) -> Callable:
    """Rows (id, text, h1, h2) to (id, h1, h2, votes, f), f the features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mined = shared.value
        for batch in batches:
            seen = [votes(t, mined) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "h1": batch["h1"], "h2": batch["h2"], "votes": np.array([v for v, _ in seen], np.int64), "f": [f.astype(np.int32) for _, f in seen]})

    return run


def co_votes(voters: int) -> Callable:
    """Rows (votes, label, n) to counts of rows in which each pair of voters votes, by label (-1: unknown)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((voters, voters))
        for batch in batches:
            x = (batch["votes"].to_numpy(np.int64)[:, None] >> np.arange(voters)) & 1
            total += (x * batch["n"].to_numpy(np.float64)[:, None]).T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})

    return run


class LabelModel:
    """Rates of each voter's votes in either class, the toxic share, and each voter's say."""

    def __init__(self, voters: int, prior: float):
        self.prior = prior
        self.rates = np.stack([np.full(voters, 1e-3), np.full(voters, 0.2)])  # of class 0 and 1
        self.say = np.ones(voters)

    def logit(self, votes):
        """Log odds of class 1 as a column over the bits of votes."""
        r0, r1 = np.clip(self.rates, 1e-6, 1 - 1e-6)
        off = self.say * np.log((1 - r1) / (1 - r0))
        on = self.say * np.log(r1 / r0) - off
        total = F.lit(float(np.log(self.prior / (1 - self.prior)) + off.sum()))
        for i, w in enumerate(on):
            total += F.when(F.getbit(votes, F.lit(i)) == 1, F.lit(float(w))).otherwise(0.0)
        return total

    def posterior(self, votes, label):
        """Chance of class 1; a known label is the class itself."""
        return F.coalesce(label.cast("double"), 1 / (1 + F.exp(-self.logit(votes))))

    def fit(self, patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
        """patterns: rows (votes, label or null, n). Every round is one aggregation over all."""
        rows = patterns.agg(F.sum("n")).first()[0] or 0
        if not rows:
            return self
        for _ in range(rounds):
            old = self.rates
            self._estimate(patterns, rows)
            if np.abs(self.rates - old).max() < 1e-4:
                break
        self._share_say(patterns, rows)
        return self

    def _estimate(self, patterns: DataFrame, rows: int) -> None:
        """The toxic share and the voters' rates, from the posterior that they now give."""
        m = self.rates.shape[1]
        share = F.col("n") * self.posterior(F.col("votes"), F.col("label"))
        sums = [F.sum(F.when(F.getbit("votes", F.lit(i)) == 1, F.col(c)).otherwise(0.0)) for c in ("s", "n") for i in range(m)]
        got = patterns.withColumn("s", share).agg(F.sum("s"), *sums).first()
        one, by_one, by_all = got[0], np.array(got[1 : m + 1]), np.array(got[m + 1 :])
        self.prior = float(np.clip(one / rows, 1e-4, 0.5))
        # a vote never speaks against toxicity: class 1 votes at least as often
        r1 = (by_one + 0.1) / (one + 1)
        r0 = (by_all - by_one + 0.01) / (rows - one + 1)
        self.rates = np.stack([np.minimum(r0, r1), r1])

    def _share_say(self, patterns: DataFrame, rows: int) -> None:
        """What the classes leave unexplained of joint votes makes voters share their say."""
        m = self.rates.shape[1]
        pairs = patterns.mapInPandas(co_votes(m), "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
        joint = np.zeros((m, m))
        joint[pairs["i"], pairs["j"]] = pairs["n"] / rows
        weights = np.array([1 - self.prior, self.prior])
        expected = np.einsum("k,ki,kj->ij", weights, self.rates, self.rates)
        spread = np.einsum("k,ki->i", weights, self.rates * (1 - self.rates)) + 1e-9
        copied = np.clip((joint - expected) / np.sqrt(np.outer(spread, spread)), 0, 1)
        np.fill_diagonal(copied, 0)
        say = 1 / (1 + copied.sum(1))
        self.say = say / say.mean()  # only shares change: what all voters say together does not


def weigh_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (p, weight, f) to (place, toxic, clean): weights of texts by features."""
    toxic, clean = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for batch in batches:
        for f, p, weight in zip(batch["f"], batch["p"], batch["weight"], strict=True):
            toxic[f] += p * weight
            clean[f] += (1 - p) * weight
    at = np.flatnonzero(toxic + clean)
    yield pd.DataFrame({"place": at, "toxic": toxic[at], "clean": clean[at]})


def used_features(shared) -> Callable:
    """Rows (id, p, weight, known, f) with only those places in f that are in shared.value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = [np.intersect1d(x, shared.value, assume_unique=True) for x in batch["f"]]
            yield batch[["id", "p", "weight", "known"]].assign(f=f)

    return run


def threshold(z: np.ndarray, p: np.ndarray, weight: np.ndarray, known: np.ndarray) -> float:
    """The log odds to be scored 0.5: the cut with the best F1 among those that have a row known
    to be toxic above and one known to be clean below; 0, which moves nothing, where there is no
    such cut, as where all rows are clean, none has a label or no feature tells them apart."""
    order = np.argsort(-z, kind="stable")
    z, p, weight, known = z[order], p[order], weight[order], known[order]
    hit, seen = np.cumsum(p * weight), np.cumsum(weight)
    above, below = np.cumsum(known & (p >= 0.5)) > 0, np.cumsum((known & (p < 0.5))[::-1])[::-1] > 0
    cuts = np.flatnonzero((z[:-1] > z[1:]) & above[:-1] & below[1:])
    if not len(cuts):
        return 0.0
    k = int(cuts[(2 * hit[cuts] / (seen[cuts] + hit[-1])).argmax()])
    return float(np.clip((z[k] + z[k + 1]) / 2, -3, 3))


def train_linear(f: list[np.ndarray], p: np.ndarray, weight: np.ndarray, known: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels p, by AdaGrad in blocks from
    the rows' own share of toxic ones; the intercept is then moved by threshold."""
    share = float(np.clip(np.average(p, weights=weight) if len(f) else 0.01, 1e-4, 1 - 1e-4))
    w, gw, b, gb = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8), float(np.log(share / (1 - share))), 1e-8
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(f)), max(1, len(f) // 64)):
            rows = [f[i] for i in part]
            if not rows:
                continue
            at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            col = np.concatenate(rows)
            z = np.bincount(at, w[col], len(rows)) + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p[part]) * weight[part]
            places, inverse = np.unique(col, return_inverse=True)
            g = np.bincount(inverse, e[at], len(places)) / len(rows) + decay * w[places]
            gw[places] += g * g
            w[places] -= rate * g / np.sqrt(gw[places])
            gb += e.mean() ** 2
            b -= rate * e.mean() / np.sqrt(gb)
    z = np.array([w[x].sum() for x in f], np.float64) + b
    return w, b - threshold(z, p, weight, known)


def scores(found, w: np.ndarray, b: float) -> np.ndarray:
    """Scores of texts with the features found."""
    z = np.array([w[f].sum() + b for f in found], np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scorer(shared) -> Callable:
    """Rows (id, h1, h2, f) to (id, h1, h2, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["h1", "h2"]].assign(id=batch["id"].astype("Int64"), score=scores(batch["f"], *shared.value))

    return run


def fit(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, float]]:
    """The votes and features of rows (id, text), a row each (id, h1, h2, votes, f) in a written
    table, h1 and h2 128 bits of the text's hash, and the classifier learned from them and known (id, label). Texts are read twice at most: the
    sample from which voters are mined, and all once for votes and features."""
    spark = rows.sparkSession
    unit = F.xxhash64("id").bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    known = cut(known, "known")
    counts = known.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = min(1.0, LABELLED / max(1, counts[0]))
    bounded = known.filter(unit < share)
    labelled = rows.join(F.broadcast(bounded), "id").select("text", "label").repartition(max(8, spark.sparkContext.defaultParallelism))
    found = labelled.mapInPandas(count_features, "place int, texts long, toxic long").groupBy("place").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    # terms with equal counts are nearly always beginnings of one another; one of them votes
    best = found.filter("toxic >= 4 AND toxic >= 0.6 * texts").groupBy("texts", "toxic").agg(F.min("place").alias("place"))
    best = best.orderBy(F.desc(F.expr("toxic - 2 * (texts - toxic)")), "place").limit(MINED)
    mined = best.toPandas()["place"].to_numpy(np.int64)

    shared = spark.sparkContext.broadcast(mined)
    m = len(BASE_VOTERS) + len(mined)
    seen = cut(rows.select("id", "text", *text_hashes("text")).mapInPandas(voter(shared), "id long, h1 long, h2 long, votes long, f array<int>"), "seen")
    cast = cut(seen.select("id", "votes").join(known, "id", "left"), "votes")
    patterns = cut(cast.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")), "patterns")
    prior = float(np.clip(counts[1] / max(1, counts[0]), 1e-3, 0.5)) if counts[0] else 0.05
    model = LabelModel(m, prior).fit(patterns)

    # posterior labels train the classifier: a bounded sample, half of it likely toxic
    trust = F.when(F.col("label").isNotNull(), 1.0).otherwise(UNLABELLED)
    judged = cast.select("id", model.posterior(F.col("votes"), F.col("label")).alias("p"), trust.alias("trust"), F.col("label").isNotNull().alias("known")).dropna()
    n1, n0 = judged.agg(F.coalesce(F.sum((F.col("p") >= 0.5).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("p") < 0.5).cast("long")), F.lit(0))).first()
    s1, s0 = (min(1.0, SAMPLE / 2 / max(1, n)) for n in (n1, n0))
    rate = F.when(F.col("p") >= 0.5, s1).otherwise(s0)
    chosen = judged.withColumn("weight", F.col("trust") * F.pow(F.lit(1.0) / rate, F.lit(0.25))).filter(unit < rate).dropDuplicates(["id"])
    # one row of each id: however often the corpus repeats it, the sample keeps its bound
    train = cut(seen.select("id", "f").join(F.broadcast(chosen), "id").select("id", "p", "weight", "known", "f").dropDuplicates(["id"]), "train")
    # features that speak for toxicity: held by enough toxic texts, and commoner there
    weights = train.mapInPandas(weigh_features, "place int, toxic double, clean double").groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    one, zero = train.agg(F.coalesce(F.sum(F.col("p") * F.col("weight")), F.lit(0.0)), F.coalesce(F.sum((1 - F.col("p")) * F.col("weight")), F.lit(0.0))).first()
    telling = weights.filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") / max(one, 1) >= LIFT * (F.col("clean") + 0.5) / max(zero, 1)))
    places = np.sort(telling.select("place").toPandas()["place"].to_numpy(np.int64))  # DIMENSIONS at most
    kept = train.mapInPandas(used_features(spark.sparkContext.broadcast(places)), "id long, p double, weight double, known boolean, f array<int>").toPandas().sort_values("id", kind="stable")
    return seen, train_linear([np.asarray(x, np.int64) for x in kept["f"]], kept["p"].to_numpy(), kept["weight"].to_numpy(), kept["known"].to_numpy(bool))


def _held_out(id_column, held_out: tuple[int, int]):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % held_out[0] == held_out[1]


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out: tuple[int, int]):
    """The features of docs by row, and the classifier for them, broadcast (see fit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    seen, model = fit(rows, known.filter(~_held_out(F.col("id"), held_out)))
    return seen, docs.sparkSession.sparkContext.broadcast(model)


def toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Learns labels from rows whose crc32 of the id as text, modulo held_out[0], is not
    held_out[1]; mined voters and the classifier use bounded samples of rows chosen by a hash
    of the id, the label model all votes. Null labels are ignored, of repeated ones the largest
    counts. Without any label the word lists and patterns alone decide. Null and empty texts
    have no votes and no features and get the classifier's intercept. A table without toxic rows,
    or without a feature that tells them, keeps the scores of its small share of toxic rows, well
    under 0.5 (see threshold). Repeated rows are scored
    alike; an empty table gives an empty result. Only ids and texts of docs are read.
    """
    tuned(docs.sparkSession)
    seen, shared = trained(docs, labels, id_col, text_col, label_col, held_out)
    out = seen.select("id", "h1", "h2", "f").mapInPandas(scorer(shared), "h1 long, h2 long, id long, score double")
    return out.select(F.col("id").alias("doc_id"), _held_out(F.col("id"), held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """docs without those predicted toxic, with the columns of docs."""
    tuned(docs.sparkSession)
    seen, shared = trained(docs, labels, id_col, text_col, label_col, held_out)
    scored = seen.select("id", "h1", "h2", "f").mapInPandas(scorer(shared), "h1 long, h2 long, id long, score double")
    # a score depends on the text alone, so a text's hash names its verdict for every row
    h1, h2 = fresh(docs, "x_h1"), fresh(docs, "x_h2")
    gone = cut(scored.filter("score >= 0.5").select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct(), "toxic")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(text_hashes(text_col), (h1, h2), strict=True)])
    return attach(keyed, gone, [h1, h2], "left_anti").select(*[keyed[f"`{c}`"] for c in docs.columns])


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxic(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
