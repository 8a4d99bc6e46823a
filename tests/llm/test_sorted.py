"""Suffix arrays and long repeats, repair of conversations and hard negatives against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import product

import numpy as np
import pandas as pd
import pytest
from comparing import differences
from pyspark.sql import functions as F

from marquee.llm import conversations, negatives, queries, repeats, suffixes

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_conversations", "op13_hard_negatives"])
def test_matches_sql(spark, sf_dir, name):
    assert not differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


@pytest.mark.parametrize("buckets", [1_024, 0])
def test_suffix_array_and_prefixes(monkeypatch, buckets):
    """Both ways of induction, recursion included, on random and periodic strings."""
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    for trial in range(600):
        n, sigma, most = int(rng.integers(0, 40)), int(rng.integers(1, 5)), int(rng.integers(1, 12))
        t = rng.integers(0, sigma, n)
        if trial % 3 == 0 and n:
            t = np.tile(t[: max(1, n // 4)], 9)[:n]
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        sa = suffixes.suffix_array(t, sigma)
        assert sa.tolist() == want
        if not n:
            continue
        monkeypatch.setattr(suffixes, "LANE", int(rng.integers(1, 9)))
        found, before = suffixes.permuted_prefixes(t + 1, sa, most)
        for q, p in zip([-1, *want], want, strict=False):
            long = 0
            while q >= 0 and long < most and max(p, q) + long < n and t[p + long] == t[q + long]:
                long += 1
            assert (before[p], found[p]) == (q, long)


def removed(texts, length):
    """The bytes of each text that a repeated string of length bytes covers."""
    starts = defaultdict(list)
    for i, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]].append((i, p))
    gone = [np.zeros(len(b), bool) for b in texts]
    for places in starts.values():
        for i, p in places if len(places) > 1 else []:
            gone[i][p : p + length] = True
    return gone


def repeat_texts(rng):
    """Passages shared whole and cut, at either end, inside themselves, in thousands of surroundings."""
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [word(rng.randrange(30, 160)) for _ in range(6)]
    texts = [None, "", "x", "a" * 300, "ab" * 100, "a" * 90, "é" * 60]
    for i in range(160):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randrange(0, 20) :], word(rng.randrange(0, 30))]
        parts += [passages[0] if i % 2 else "", word(3)]
        texts.append("".join(parts))
    return [*texts, texts[20], texts[20], texts[30] * 4]


@pytest.mark.parametrize(("shard", "crowd", "chunk"), [(1 << 20, 1 << 20, 1 << 20), (2_000, 900, 500), (500, 100, 64)])
def test_repeats(spark, shard, crowd, chunk):
    """Windows of 40 bytes named by grams of 8; small shards, crowded keys and texts longer than what
    is hashed at a time change nothing."""
    texts = repeat_texts(random.Random(shard))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = repeats.repeats(docs, length=40, gram=8, shard=shard, crowd=crowd, finer=(4, 1), chunk=chunk).toPandas().set_index("doc_id")
    bodies = [(t or "").encode() for t in texts]
    for i, (b, gone) in enumerate(zip(bodies, removed(bodies, 40), strict=True)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
        row = found.loc[i]
        assert (row["n_bytes"], [[s["a"], s["b"]] for s in row["spans"]]) == (len(b), edge), i
        assert bytes(row["kept"]) == bytes(np.frombuffer(b, np.uint8)[~gone]), i


def test_only_segments_that_may_share_a_window_are_sorted(monkeypatch):
    """Segments of one key that share a line shorter than a window stay out of the shard; none that shares a
    window does, wherever the segments are cut, and what occurs twice counts also without another one."""
    rng, length = random.Random(5), 40
    word = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    bodies, ats = [], []
    for _ in range(3_000):
        around = [rng.choice([b"a" * 40, b"ab" * 20, word(40)]) for _ in range(2)]
        at, end = rng.randrange(33), rng.randrange(48, 81)
        whole = around[0] + b"the gram" + around[1]
        first = 40 - at
        if end + 8 - first >= length and first + length >= 48:
            bodies.append(whole[first : end + 8])
            ats.append(at)
    found = repeats.partnered(ats, bodies, length)
    windows = defaultdict(set)
    for i, (at, b) in enumerate(zip(ats, bodies, strict=True)):
        for p in range(len(b) - length + 1):
            windows[at - p, b[p : p + length]].add(i)
    shares = {i for x in windows.values() if len(x) > 1 for i in x}
    assert shares and shares <= {i for i, x in enumerate(found) if x}

    sorted_bytes = []
    judge = repeats.repeated_windows
    monkeypatch.setattr(repeats, "repeated_windows", lambda b, n: sorted_bytes.append(sum(map(len, b))) or judge(b, n))
    line, window = word(14) + b"the gram" + word(8), word(16) + b"the gram" + word(16)
    rows = [(7, i, 0, 1 + (i == 13), 22, b"%02d" % i * 4 + line + b"%02d" % i * 10) for i in range(10, 60)]
    rows += [(8, 60, 0, 1, 16, window + b"60"), (8, 61, 0, 1, 18, b"61" + window)]
    frame = pd.DataFrame(rows, columns=["key", "d1", "d2", "n", "at", "body"])
    got = {d1: runs for f in repeats.sort_shards(length, 1 << 20)([frame]) for d1, runs in zip(f["d1"], f["runs"], strict=True)}
    assert got == {13: [{"a": 0, "b": len(rows[3][5]) - length + 1}], 60: [{"a": 0, "b": 1}], 61: [{"a": 2, "b": 3}]}
    assert sum(sorted_bytes) == len(rows[-2][5]) + len(rows[-1][5])


def test_repeats_of_odd_rows(spark, odd, odd_rows, none):
    found = repeats.repeats(odd.withColumn("spans", F.lit(1)), length=60, gram=16)
    assert set(found.columns) == {*odd.columns, "n_bytes", "spans", "kept"}
    want = removed([(r[1] or "").encode() for r in odd_rows], 60)
    assert found.agg(F.sum("n_bytes"), F.sum(F.octet_length("kept"))).first() == (sum(map(len, want)), sum(int((~g).sum()) for g in want))
    assert repeats.repeats(none).count() == 0


GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """All edits of rows (role, text, fault) with up to two inserts at each place: the least cost, its
    ASCII-least string and the repaired rows."""
    best = None
    options = []
    for role, text, fault in rows:
        late = 5 * (fault == "truncated")
        here = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            here += [("K", late, [(role, text)])] if role else []
            here += [("R", 1 + late, [(r, text)]) for r in ("user", "assistant")]
        options.append([(("I" * len(new)) + e, c + 5 * len(new), [(r, "") for r in new] + out) for e, c, out in here for new in INSERTS])
    options.append([("I" * len(new), 5 * len(new), [(r, "") for r in new]) for new in INSERTS])
    for way in product(*options):
        out = [r for w in way for r in w[2]]
        if GOOD.fullmatch("".join(r[:1] for r, _ in out)):
            found = sum(w[1] for w in way), "".join(w[0] for w in way), out
            best = min(best, found) if best else found
    return best


INSERTS = [(), ("user",), ("assistant",), ("user", "assistant")]


def judged(rows):
    """Rows (turn, role, text) in order to (role, text, fault)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


@pytest.mark.parametrize("spill", [1, 1 << 20])
def test_repair(spark, spill):
    """Random conversations of up to four rows, with null turns, ties, odd roles, absent rows."""
    rng = random.Random(5)
    rows = []
    for c in [None, *range(40)]:
        for _ in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None])
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 9]), role, rng.choice(["a.", "b!", "b", "é?\n", "", None, "c."]), rng.random() < 0.85))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, here boolean").withColumn("conv", F.lit("x")).repartition(3)
    repair = conversations.Repair(frame, present=F.col("here"), spill=spill)
    found = {r["conv_id"]: r for r in repair.digest().collect()}
    texts = defaultdict(list)
    for r in repair.repaired().orderBy("place").collect():
        texts[r["conv_id"]].append((r["role"], r["text"]))
    assert found.keys() == {r[0] for r in rows}
    for c, got in found.items():
        mine = [(t, role or (" " if role is None else ""), " " if text is None else text) for k, t, role, text, here in rows if k == c and here]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults = judged(mine)
        cost, audit, out = cheapest(faults)
        assert (got["cost"], got["audit"], texts[c]) == (cost, audit, out), (c, mine)
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        turns = {t for t, *_ in mine if t is not None}
        assert got["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert [got[k] for k in ("blank", "duplicate", "truncated")] == [sum(f == k for *_, f in faults) for k in ("blank", "duplicate", "truncated")]
        first = [r[:1] for r, *_ in faults]
        assert got["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))


def test_repair_of_a_giant_conversation(spark):
    """One conversation over many batches and spilled blocks, and an empty table."""
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{i}." if rng.random() < 0.9 else f"{i}") for i in range(9_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (conversations.Repair(frame, spill=n).digest().first() for n in (1 << 20, 500))
    assert one == many and len(one["audit"].replace("I", "")) == 9_000
    assert conversations.Repair(frame.limit(0)).digest().count() == 0 and conversations.Repair(frame.limit(0)).repaired().count() == 0


def negatives_of(rows, positives=5, wanted=3):
    """Rows (id, vector, label) to the counted results."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], k) for i, v, k in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, k) in enumerate(good):
        if i is None or i % 50:
            continue
        order = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, k2, b) for b, (j, w, k2) in enumerate(good) if b != a)
        for p, none, j, *_ in [o for o in order if o[3] == k][:positives]:
            fits = [o for o in order if o[3] != k and 50 * -p <= 100 * -o[0] <= 95 * -p][:wanted]
            out += [(i, None if none else j, r, None if o[1] else o[2], -p, -o[0]) for r, o in enumerate(fits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("pack", "group"), [(4_096, 8 << 20), (64, 200)])
def test_hard_negatives(spark, monkeypatch, pack, group):
    """Ties, repeated rows and ids, nulls, vectors of other lengths, a label with half of all rows; small
    packs and more groups than are broadcast."""
    monkeypatch.setattr(negatives, "PACK", pack)
    monkeypatch.setattr(negatives, "GROUP_BYTES", group)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 0.3, 0.0, 0.4]) for _ in range(rng.choice([4, 4, 4, 3]))], rng.choice([1, 1, 1, 2, 3])) for i in range(700)]
    rows += [rows[50], rows[50], rows[51], (100, [0.25] * 4, 1), (None, [0.3] * 4, 2), (None, [0.4] * 4, 1), (None, None, 1), (900, [0.3, None], 1), (950, [0.3, float("nan")], 1)]
    rows += [(1_000, [0.3, float("inf")], 1), (1_050, [0.3] * 4, None), (1_100, [], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)).repartition(3)
    got = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0).collect()
    want = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    assert sorted(map(tuple, got), key=repr) == negatives_of(want)
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="61 bits"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int"), F.lit(True))
