"""Classifiers by held-out accuracy, and the pipeline by what its stages must keep and drop."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import language_id, quality, queries, toxicity

MIDDLE = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    found = queries.QUERIES[name](spark, MIDDLE).toPandas()
    assert found["score"].between(0, 1).all() and len(found) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    return both[both["held_out"] & both[label].notna()]


def test_toxicity(spark):
    rows = held_out(spark, "op8_toxicity", "toxic")
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.95  # the commoner class: 0.91
    assert rows.loc[rows["toxic"] == 1, "predicted"].mean() > 0.7


def test_label_model_tells_classes_and_copies(spark):
    """Votes drawn from known rates: rates, the toxic share and posteriors return; and of five
    voters, one a copy of another, those two have less say."""
    rng = np.random.default_rng(12)
    rates = np.array([[0.02, 0.05, 0.01, 0.03], [0.6, 0.5, 0.4, 0.7]])
    y = (rng.random(20_000) < 0.15).astype(int)
    x = rng.random((len(y), 4)) < rates[y]

    def fitted(x):
        votes = (x << np.arange(x.shape[1])).sum(1).tolist()
        known = [int(v) if i % 20 == 0 else None for i, v in enumerate(y)]
        rows = Counter(zip(votes, known, strict=True))
        frame = spark.createDataFrame([(*k, n) for k, n in rows.items()], "votes long, label int, n long")
        return votes, frame, toxicity.LabelModel(x.shape[1], 0.1).fit(frame)

    votes, frame, model = fitted(x)
    assert abs(model.prior - 0.15) < 0.02 and np.abs(model.rates - rates).max() < 0.05
    p = frame.filter("label IS NULL").select("votes", model.posterior(F.col("votes"), F.col("label")).alias("p")).toPandas().set_index("votes")["p"].to_dict()
    best = {v: max((y[np.array(votes) == v] == c).mean() for c in (0, 1)) for v in set(votes)}
    right = np.mean([(p[v] > 0.5) == t for v, t in zip(votes, y.tolist(), strict=True)])
    assert right > np.mean([best[v] for v in votes]) - 0.005
    _, _, model = fitted(np.c_[x, x[:, 3]])
    assert model.say[3:].max() < 0.8 * model.say[:3].min()


def test_hints_lose_no_match():
    for text in ("you are an idiot", "oh shut up now", "i hate you", "we hate them all", "f**k", "a sh@#t b", "you're such a clown", "drop dead"):
        for k, p in toxicity._PATTERNS.items():
            assert not p.search(text) or any(x in text for x in toxicity._HINTS[k])


def test_quality(spark):
    rows = held_out(spark, "op5_quality", "quality")
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95  # the commoner class: 0.88


def test_languages(spark):
    found = queries.QUERIES["op9_language_id"](spark, MIDDLE).toPandas()
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    rows = both[both["held_out"] & both["lang"].notna() & (both["lang_pred"] != "und")]
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.9


def test_odd_rows_get_a_score(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2, (i % 4 == 0) * 1) for i in range(40)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxic, quality.scored):
        found = f(odd, labels).toPandas()
        assert len(found) == len(odd_rows) and found["score"].between(0, 1).all()
        assert f(none, labels).count() == 0 and f(odd, labels.limit(0)).count() == len(odd_rows)
    found = language_id.languages(odd).toPandas()
    assert len(found) == len(odd_rows) and language_id.languages(none).count() == 0
    wordless = {r[0] for r in odd_rows if not any(c.isalpha() for c in r[1] or "")}
    assert set(found.loc[found["doc_id"].isin([i for i in wordless if i is not None]), "lang_pred"]) == {"und"}


def test_lasso_finds_the_rule_that_counts():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (400, 5)).astype(float)
    _, w = quality.lasso(z, z[:, 2])
    assert int(np.abs(w).argmax()) == 2 and w[2] > 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_stages(spark, sf):
    """Each stage keeps a subset of its input's rows and its columns, and decides as its operator does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        ids = [r.doc_id for r in after.collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= {r.doc_id for r in before.collect()}
        if name != "mixing":
            assert after.columns == docs.columns
        if name == "exact_dedup":
            want = before.groupBy("text").agg({"doc_id": "max"}).count()
            assert len(ids) == want
        before = after
    assert "taken" in before.columns and before.filter("taken <= 0").count() == 0


def few_clean(spark, n, toxic=None):
    """n clean texts of plain words; toxic: what labels say, None without labels."""
    rng = random.Random(n)
    plain = "the river and a table near old houses some people walk to work with bread or tea while rain falls on roofs".split()
    docs = spark.createDataFrame([(i, " ".join(rng.choices(plain, k=rng.randrange(5, 60)))) for i in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([] if toxic is None else [(i, toxic) for i in range(0, n, 2)], "doc_id long, toxic int")


@pytest.mark.parametrize(("n", "label"), [(20, 0), (20, None), (150, 0), (150, None)])
def test_clean_tables_hold_nothing_toxic(spark, n, label):
    docs, labels = few_clean(spark, n, label)
    found = toxicity.toxic(docs, labels).toPandas()
    assert len(found) == n and found["score"].max() < 0.5 and not found["predicted"].any()
    assert toxicity.without_toxic(docs, labels).count() == n


def test_no_label_of_sf_toxic(spark, sf_dir):
    """The rows of the smallest tables that are labelled clean, with those labels: all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    assert toxicity.toxic(docs, labels).filter("predicted = 1").count() == 0


def test_threshold_against_every_cut():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        z, p, weight, known = rng.integers(-3, 4, n).astype(float), rng.random(n), rng.random(n) + 0.1, rng.random(n) < 0.6
        best = {}
        for cut in sorted({(a + b) / 2 for a in z for b in z if a > b and not any(b < c < a for c in z)}):
            up = z > cut
            if (known & (p >= 0.5) & up).any() and (known & (p < 0.5) & ~up).any():
                best[cut] = 2 * (p * weight)[up].sum() / (weight[up].sum() + (p * weight).sum())
        got = toxicity.threshold(z, p, weight, known)
        assert got in best and np.isclose(best[got], max(best.values())) if best else got == 0


def test_pipeline_keeps_odd_and_clean_rows(spark, sf_dir, tmp_path, odd):
    """Nulls, repeats and clashing columns; all rows are clean, so the first stage keeps them all."""
    columns = odd.select("doc_id", "text", "lang", "source", "n_chars", "kept", "KEY", "n")
    columns.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and first.exceptAll(docs).count() == 0 and docs.exceptAll(first).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    texts = {r["text"] for r in out.collect()}
    assert "One two" in texts and len(texts) >= 10
