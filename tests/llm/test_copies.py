"""Exact dedup, the n-gram join and mixing against brute force; the SQL of those that have it."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from comparing import differences

from marquee.llm import exact_dedup, mixing, ngram_join, queries
from marquee.llm.components import components


@pytest.mark.parametrize("name", ["op1_warc", "op3_exact_dedup", "op7_mixing"])
def test_query_matches_sql(spark, sf_dir, name):
    assert not differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_is_brute_force(odd, odd_rows, bits):
    """Also when nearly all hashes collide and buckets split."""
    groups = defaultdict(list)
    for r in odd_rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    out = exact_dedup.exact_dedup(odd, key_bits=bits, capacity=5)
    assert Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert {"KEY", "n", "size"} <= set(out.columns)


def test_directory_doubles_and_splits():
    depth, entries = exact_dedup.build_directory({0: 10, 1: 10, 4095: 1}, capacity=10)
    assert depth == 12 and len(entries) == 4096
    assert entries[0] == (0, 12) and entries[1] == (1, 12) and entries[-1] == (1, 1)
    assert exact_dedup.build_directory({}) == (0, [(0, 0)])


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, k, percent):
    label = {r[0]: r[0] for r in rows if r[0] is not None}
    of = [(r[0], sets(r[1], k)) for r in rows if r[0] is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(of, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


@pytest.mark.parametrize(("k", "percent", "crowded"), [(4, 85, 48), (5, 80, 4)])
def test_join_is_brute_force(odd, odd_rows, k, percent, crowded):
    """Also where columns are crowded by a group of near copies."""
    label = brute_components(odd_rows, k, percent)
    found = ngram_join.ngram_components(odd, k=k, percent=percent, crowded=crowded).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        if r.doc_id is not None:
            assert r.component_id == label[r.doc_id]
    assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((r[0], len(sets(r[1], k))) for r in odd_rows)


@pytest.mark.parametrize(("percent", "rounds"), [(70, 2), (60, 0), (60, 1)])
def test_crowded_columns_of_several_labels(spark, monkeypatch, percent, rounds):
    """Families that share a stock of words, with sizes and overlaps around the threshold: columns
    that stay crowded hold several components, dealt in small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", max(rounds, 1))
    rng = random.Random(percent + rounds)
    stock = [f"s{i}" for i in range(30)]
    rows = []
    for family in range(6):
        own = [f"f{family}x{i}" for i in range(rng.choice((6, 10, 14)))]
        for _ in range(14):
            w = stock + own
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    label = brute_components(rows, 3, percent)
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=3, percent=percent, crowded=5).collect()
    assert {r.doc_id: r.component_id for r in found} == label


def test_one_of_each_group_stays(odd, odd_rows):
    label = brute_components(odd_rows, 5, 80)
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in odd_rows if r[0] is None or label[r[0]] == r[0])


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160))


def test_mixing_meets_targets(odd, odd_rows):
    out = mixing.mixed(odd).collect()
    assert len(out) == len(odd_rows)
    by = defaultdict(list)
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken <= 3 * r.size
        by[r.source].append(r)
    total = sum(r.size for r in out)
    assert abs(sum(rs[0].target for rs in by.values()) - min(total, 3 * total)) < 1e-6
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)


def test_empty_tables(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.ngram_components(none).count() == 0
    assert mixing.mixed(none).count() == 0


def test_dropping_copies_keeps_clashing_columns(odd, odd_rows):
    want = {r[1] or "": max((x[0] for x in odd_rows if (x[1] or "") == (r[1] or "") and x[0] is not None), default=None) for r in odd_rows}
    left = Counter(r for r in odd_rows if r[0] == want[r[1] or ""])
    clashing = odd.withColumnsRenamed({"size": "keep_id", "n": "group_size", "KEY": "text_sha256"})
    found = exact_dedup.drop_copies(clashing)
    assert found.columns == clashing.columns and Counter(map(tuple, found.collect())) == left


def test_a_bucket_has_one_owner(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    docs = spark.createDataFrame([(i, f"text {i % 400}") for i in range(800)], "doc_id long, text string")
    assert exact_dedup.exact_dedup(docs, capacity=100).filter("kept").count() == 400
    files = [len(list(x.glob("*.parquet"))) for x in (tmp_path / "buckets").glob("bucket=*")]
    assert len(files) > 3 and set(files) == {1}
