import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, KEY string, n int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties, columns that clash."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta", "iota", "chi", "psi", "rho"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    texts = [None, "", "", " \t ", "one", "One two", "é" * 3, *base, base[0], base[0], base[1] + " more", base[1] + " other", base[2].upper(), " ".join(base * 40)]
    for k in range(60):
        w = base[3].split() * 4
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    out = [(i, t, ("en", "de", None)[i % 3], ("web", "web", "web", "book", None)[i % 5], None, None, i % 7, "k", 3) for i, t in enumerate(texts)]
    return [*out, out[9], out[9], (None, None, None, None, None, None, None, None, None), (None, base[4], "en", "web", 1, True, 1, "k", 1)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
