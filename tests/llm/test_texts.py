"""Decontamination, personal data, language models and archives against brute force."""

import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from marquee.llm import decontamination, elias_fano, lm, pii, warc

PASSAGE = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch from the old oak tree and count the stars of a cold winter night."


def test_contamination_finds_edited_passages_only(spark):
    edited = PASSAGE.replace("quick", "quik").replace("seven", "sevven")
    docs = [(1, "Intro text. " + PASSAGE + " And more."), (2, "x " * 500 + edited + " y" * 3000), (3, "Nothing of the kind is in this clean text about owls and a winter night."), (4, None), (5, ""), (6, PASSAGE.upper().replace(" ", "\n ")), (6, PASSAGE), (None, PASSAGE), (None, "a clean text"), (1, "clean, with the id of another"), (7, " Tiny\n"), (8, "a tiny one"), (9, "who wrote it? And more"), (10, "awho wrote it?")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, FOUND string, item_id int")
    items = spark.createDataFrame([(10, PASSAGE), (11, None), (12, "tiny"), (13, PASSAGE), (14, "Who wrote it?"), (15, ""), (None, "who wrote")], "item_id long, text string")
    found = decontamination.contamination(frame, items).collect()
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in docs)
    assert Counter(r.doc_id for r in found if r.contaminated) == Counter([1, 2, 6, 6, None, 7, 9])
    one = next(r for r in found if r.doc_id == 1 and r.contaminated)
    assert one.n_items == 2 and one.first_item == 10 and one.fewest_edits == 0
    assert next(r for r in found if r.doc_id == 9).n_items == 2
    left = decontamination.decontaminated(frame, items)
    assert left.columns == frame.columns and Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 4, 5, 8, 10, None])
    assert decontamination.contamination(frame, items.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(frame.limit(0), items).count() == 0


def test_alignment_is_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 3, 8), rng.integers(0, 3, 14)
        best = 99
        for i, j in itertools.combinations(range(len(b) + 1), 2):
            row = list(range(j - i + 1))
            for x in range(len(a)):
                last, row = row, [row[0] + 1] + [0] * (j - i)
                for y in range(j - i):
                    row[y + 1] = min(last[y + 1] + 1, row[y] + 1, last[y] + (a[x] != b[i + y]))
            best = min(best, row[-1])
        assert decontamination.edits(a, b, 50) == best


def test_contamination_is_brute_force(spark, monkeypatch):
    """The query's rows against the alignment of every segment with every whole text; also where
    stretches are halved and the index is in many files."""
    monkeypatch.setattr(decontamination, "HITS", 500)
    monkeypatch.setattr(decontamination, "BLOCK", 700)
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.integers(3, 90)))) for i in range(12)] + [(50, "aaaa " * 60)]
    docs = []
    for i in range(70):
        t = [word() for _ in range(rng.integers(0, 120))]
        if i % 2:
            c = list(items[rng.integers(len(items))][1])
            for _ in range(rng.integers(0, 3 + len(c) // 8)):
                c[rng.integers(len(c))] = str(rng.choice(list("abcde f")))
            a = int(rng.integers(0, max(1, len(c) - 90)))
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = ["".join(c[a : a + int(rng.integers(80, 400))])]
        docs.append((i, " ".join(t)))
    docs += [(70, "aaaa " * 400), (71, items[3][1]), (72, "")]
    clean = {i: decontamination.codes(decontamination.normalised(t)) for i, t in items if len(decontamination.normalised(t)) >= decontamination.LEAST}

    def fewest(text, c):
        d, best = decontamination.codes(decontamination.normalised(text)), 99
        for s in [0] if len(c) <= 100 else [*range(0, len(c) - 100, 50), len(c) - 100]:
            part = c[s : s + 100]
            budget = len(part) // 10 if len(part) >= 32 else 0
            e = decontamination.edits(part, d, budget)
            best = min(best, e if e <= budget else 99)
        return best

    want = {}
    for i, t in docs:
        e = {k: fewest(t, c) for k, c in clean.items()}
        hit = {k: x for k, x in e.items() if x < 99}
        want[i] = (bool(hit), len(hit), min(hit, default=None), min(hit.values(), default=None))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in found} == {k: v[:3] for k, v in want.items()}
    assert 10 < sum(v[0] for v in want.values()) < 60


def brute_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_patterns_are_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(4000):
        text = "".join(rng.choice(list("a1.@+- 9()é"), 40))
        assert pii.patterns(text) == brute_spans(text)
    known = "mail a.b@c.org, 10.0.0.255 and 256.1.1.1, card 4111 1111 1111 1111, call +49 (30) 1234567."
    assert [pii.KINDS[k] for k, _, _ in pii.patterns(known)] == ["email", "ip", "card", "phone"]


def test_tagger_gradients_and_decoding():
    rng = np.random.default_rng(3)
    t = pii.Tagger()
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = rng.integers(0, 98, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 6, 0]])
    _, g = t.gradients(x, y)
    for key in ("xf", "hb", "out", "trans", "bias", "start"):
        flat = t.p[key].reshape(-1)
        i = int(np.abs(g[key]).reshape(-1).argmax())
        old, e = flat[i], 1e-3
        flat[i] = old + e
        up = t.gradients(x, y)[0]
        flat[i] = old - e
        down = t.gradients(x, y)[0]
        flat[i] = old
        assert math.isclose((up - down) / (2 * e), g[key].reshape(-1)[i], rel_tol=2e-2, abs_tol=1e-4)
    x = rng.integers(0, 98, (1, 4))
    e, trans = t.emissions(x)[:, 0], t.p["trans"] + t.allowed
    score = lambda p: t.p["start"][p[0]] + t.allowed[0][p[0]] + sum(e[i][p[i]] for i in range(4)) + sum(trans[a, b] for a, b in itertools.pairwise(p))
    assert tuple(t.decode(x)[0]) == max(itertools.product(range(t.TAGS), repeat=4), key=score)


def test_personal_data_keeps_the_patterns_spans(spark):
    texts = [None, "", "call +49 (30) 1234567 now", "mail to x@y.zz " * 20_000, "no data here", "Ünïcode a@b.cd"]
    rows = [*enumerate(texts), (2, texts[2]), (None, texts[5])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, SPANS string, id int")
    found = pii.personal_data(docs, steps=3).collect()
    assert len(found) == 8
    for r in found:
        text = texts[5] if r.doc_id is None else texts[r.doc_id] or ""
        base = pii.joined(brute_spans(text))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_email == sum(k == 0 for k, _, _ in brute_spans(text))
    assert pii.personal_data(docs.limit(0), steps=1).count() == 0


def test_tagger_finds_forms_that_no_pattern_has():
    """Held-out written forms: recall of each kind, and look-alikes left alone. Fails if the tagger
    adds nothing."""
    rng = np.random.default_rng(21)
    prose = ["".join(rng.choice(list("etaoin shrdlu "), 400)) for _ in range(60)]
    tagger = pii.Tagger().fit(*pii.training(prose[:30]))
    docs, gold = [], []
    for _ in range(1500):
        kind, s = pii.written(rng)
        front, behind = pii.FRAMES[rng.integers(len(pii.FRAMES))] if kind == 4 else ("", "")
        body = prose[30 + rng.integers(30)]
        at = body.find(" ", int(rng.integers(0, 300))) + 1
        docs.append(body[:at] + front + s + behind + " " + body[at:])
        gold.append((kind, at + len(front), at + len(front) + len(s)))
    hit, added, total = Counter(), Counter(), Counter()
    for (base, more), (kind, a, b) in zip(pii.find_all(docs, tagger), gold, strict=True):
        total[kind] += 1
        hit[kind] += bool(more) if kind < 0 else (kind, a, b) in base + more
        added[kind] += (kind, a, b) in more
    assert all(hit[k] >= 0.9 * total[k] and added[k] > 0.15 * total[k] for k in range(5)), (hit, added, total)
    assert hit[-1] < 0.03 * total[-1]


def test_personal_data_of_documents(spark):
    """The query against brute force, and the tokens of documents, which no pattern finds."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = pii.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    tokens, caught = 0, 0
    for r in found:
        base = brute_spans(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert r.n_spans == len(spans) == len(base) + r.n_added and set(pii.joined(base).split(",")) - {""} <= set(spans)
        if 'token = "' in docs[r.doc_id]:
            tokens += 1
            caught += "secret:" in r.spans
    assert tokens >= 10 and caught >= 0.9 * tokens
    assert sum(r.n_added > 0 for r in found) <= 1.5 * tokens


@pytest.fixture(scope="module")
def tagger():
    """Trained on 400 random texts of sf0.01, not the query's own sample."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    return pii.Tagger().fit(*pii.training([texts[i] for i in np.random.default_rng(0).choice(len(texts), 400, replace=False)]))


def test_secrets_of_documents_are_found_whole(tagger):
    """Of a larger table than the training texts come from."""
    rows = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE contains(text, 'token = \"') ORDER BY doc_id").fetchall()]
    hit = 0
    for text, (_, more) in zip(rows, pii.find_all(rows, tagger), strict=True):
        m = re.search('token = "([^"]*)"', text)
        hit += (4, m.start(1), m.end(1)) in more
    assert len(rows) >= 100 and hit >= 0.9 * len(rows), (hit, len(rows))


PROSE = "lorem ipsum dolor sit amet and so forth we went along the river with some bread "


@pytest.mark.parametrize("size", [12, 30, 60, 64, 80, 100, 120, 128])
def test_secrets_of_every_length_are_found_whole(tagger, size):
    """At any place in their windows; none is found without its end."""
    rng = np.random.default_rng(size)
    hit = 0
    for r in range(60):
        s = "".join(pii.secret(rng) for _ in range(11))[: size - 1] + "7"
        front, behind = pii.FRAMES[r % len(pii.FRAMES)]
        body = (PROSE * 8)[: int(rng.integers(0, 300))] + " " + front
        ((_, more),) = pii.find_all([body + s + behind + " " + PROSE], tagger)
        ours = [x for x in more if x[0] == 4 and x[1] < len(body) + size and len(body) < x[2]]
        assert all(b >= len(body) + size for _, _, b in ours), (s, ours)
        hit += (4, len(body), len(body) + size) in ours
    assert hit >= 54


@pytest.mark.parametrize(("front", "behind"), [('secret_key: "', '"'), ('"password": "', '",'), ("AWS_SECRET_ACCESS_KEY=", ""), ("my token is ", ""), ("x-api-key: ", ""), ("TOKEN='", "'"), ("passwd is '", "'")])
def test_secrets_in_frames_that_training_does_not_write(tagger, front, behind):
    assert (front, behind) not in pii.FRAMES
    rng = np.random.default_rng(8)
    hit = 0
    for _ in range(60):
        s, body = pii.secret(rng), (PROSE * 3)[: 100 + int(rng.integers(0, 80))] + " " + front
        ((_, more),) = pii.find_all([body + s + behind + " " + PROSE], tagger)
        hit += (4, len(body), len(body) + len(s)) in more
    assert hit >= 54


@pytest.mark.parametrize(("text", "kind"), [("10 . 0 . 0 . 1", 1), ("10,0,0,12", 1), ("(030) 123 45 67", 3), ("10[.]0[.]0[.]12", 1), ("user (at) host (dot) org", 0)])
def test_spelled_out_forms(tagger, text, kind):
    ((_, more),) = pii.find_all([f"{PROSE}see {text} {PROSE}"], tagger)
    at = len(PROSE) + 4
    assert more == [(kind, at, at + len(text))]


def test_overlapping_windows_are_reconciled():
    assert pii.reconciled([(5, 0, 10, 20), (60, 0, 8, 20), (1, 3, 19, 30), (2, 1, 40, 50)]) == [(0, 8, 20), (1, 40, 50)]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 1000):
        v = np.sort(rng.integers(0, 1 << 20, n))
        ef = elias_fano.EliasFano(elias_fano.EliasFano.build(v))
        assert (ef.at(np.arange(n)).astype(np.int64) == v).all()


def test_language_model_counts(odd, odd_rows):
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]

    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 == 0 for r in odd_rows]
    counts = Counter(w for r, h in zip(odd_rows, held, strict=True) if not h for w in tokens(r[1]))
    total = counts.total()
    want = Counter()
    for r, h in zip(odd_rows, held, strict=True):
        t = tokens(r[1])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in t)
        want[(r[0], h, len(t), sum(counts[w] > 0 for w in t), total, round(base, 5))] += 1
    found = lm.lm_scores(odd).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert all(r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


@pytest.mark.parametrize("rows", [0, 6])
def test_archives_round_trip(spark, rows):
    long = "<p>" + "é" * 200
    pages = [(3, "http://a/\r\nx", long), (1, None, long), (2, "u", None), (2, "u", "short"), (None, "v", long), (9, "", "")][:rows]
    folder, index = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = warc.read_archives(folder, index, with_html=True).collect()
    assert len(found) == rows
    for r in found:
        if r.page_id == 3 or r.page_id is None:
            assert (r.record_type, r.refers_to, r.html) == ("revisit", 1, None) and r.payload_bytes == 403
        if r.page_id == 1:
            assert r.html == long and r.record_type == "response"
    whole = warc.read_pages(folder, index).collect()
    assert Counter((r.page_id, r.html or None) for r in whole) == Counter((p[0], p[2] or None) for p in pages)


def test_archives_of_odd_pages(spark):
    """Very long payloads, clashing columns, many small records: ids of records are unique, and
    reading is dealt by bytes."""
    pages = [(i, "u", f"page {i % 50} " * (200_000 if i == 7 else 12), "x", i) for i in range(300)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, DIGEST string, first int").repartition(5)
    folder, index = warc.write_archives(frame)
    found = warc.read_pages(folder, index)
    assert Counter((r.page_id, r.html) for r in found.collect()) == Counter((p[0], p[2]) for p in pages)
    files = Path(folder.removeprefix("file://"))
    ids = [m for f in files.glob("*.gz") for m in re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(f.read_bytes()))]
    assert len(ids) == len(set(ids)) == 300
    assert warc.read_archives(folder, index).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_neighbouring_ranges_are_read_together():
    assert list(warc.spans([0, 10, 500, 900], [10, 10, 10, 10], gap=100, most=1000)) == [(0, 2), (2, 3), (3, 4)]
    assert list(warc.spans([0, 10, 20], [10, 10, 10], gap=100, most=25)) == [(0, 2), (2, 3)]


def test_every_repeated_ngram_is_listed(spark, monkeypatch):
    """Also where the corpus is so large that a fixed share of it would be many occurrences; scores
    against brute force."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 60)) for _ in range(500)] * 2 + ["a b c " * 200_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    tokens = [["", *(t or "").split(), ""] for t in texts]
    trained = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for t in trained for w in t[1:])
    two = {k: n for k, n in Counter(x for t in trained for x in itertools.pairwise(t)).items() if n > 1}
    three = {k: n for k, n in Counter(x for t in trained for x in zip(t, t[1:], t[2:], strict=False)).items() if n > 1}
    words, grams, triples, total, distinct = lm.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 10 != 0").select("text"))
    assert (words.size, grams.size, triples.size, total, distinct) == (len(one), len(two), len(three), one.total(), len(one))
    assert len(words.files) > lm.SHARDS

    p1 = lambda w: (one[w] + 0.1) / (total + 0.1 * (distinct + 1))
    p2 = {(v, w): (n - 0.75) / one[v] for (v, w), n in two.items()}
    p3 = {(u, v, w): (n - 0.75) / two[u, v] for (u, v, w), n in three.items()}
    left1, below1, left2, below2 = (Counter() for _ in range(4))
    for (v, w), p in p2.items():
        left1[v] += p
        below1[v] += p1(w)
    for (u, v, w), p in p3.items():
        left2[u, v] += p
        below2[u, v] += p2[v, w]

    def score(t):
        out = 0
        for i in range(1, len(t)):
            v, w = t[i - 1], t[i]
            p = p2.get((v, w)) or p1(w) * (1 - left1[v]) / (1 - below1[v])
            if i > 1:
                uv = t[i - 2], v
                p = p3.get((*uv, w)) or (p * (1 - left2[uv]) / (1 - below2[uv]) if uv in two else p)
            out += math.log10(p)
        return out

    for r in lm.lm_scores(docs).collect():
        t = tokens[r.doc_id]
        if len(t) < 1000:
            assert abs(r.score - score(t)) < 0.02 * len(t)


def test_shards_of_many_contexts():
    """A group's key is a NumPy int of 32 bits; shards times contexts are more."""
    grams = lm.Grams([(None, 0)] * 250, 60_000_000, 1_000_000)
    assert [grams.low(np.int32(i)) for i in range(251)] == [240_000 * i for i in range(251)]
    assert lm.Grams([(None, 0)] * 250, 5_000_000_000, 1_000_000).low(np.int32(249)) == 4_980_000_000


@pytest.mark.parametrize("count", [3, 400])
def test_level_finds_few_and_many(count):
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 50 * 1000, 500))
    level = elias_fano.Level(elias_fano.Level.build(keys // 1000, keys % 1000, keys, keys / 1e5, np.ones(50)))
    asked = np.unique(np.r_[rng.choice(keys, count), rng.integers(0, 50 * 1000, count)])
    at = np.searchsorted(keys, asked)
    assert (level.find(asked, 1000) == np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, -1)).all()


def test_short_items_at_the_end_of_a_text_belong_to_it(spark):
    docs, items, want, rng = [], [], set(), np.random.default_rng(8)
    for size in range(20, 41):
        item = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxy"), size))
        items.append((size, item))
        for pad in range(9):
            for t in (item, "z" * pad + " " + item, item + " " + "z" * pad):
                want.add((len(docs), size))
                docs += [(len(docs), t), (len(docs) + 1, "quite another text without any passage"), (len(docs) + 2, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = decontamination.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.fewest_edits == 0} == want
    assert {r.doc_id for r in found} == {d for d, _ in want}


def test_segments_split_between_rows_are_no_match(spark):
    docs = [(3 * i + k, t) for i, cut in enumerate(range(2, 99)) for k, t in enumerate((PASSAGE[:cut], PASSAGE[cut:100], ""))]
    c = decontamination.codes(decontamination.normalised(PASSAGE[:100]))

    def holds(t):
        return decontamination.edits(c, decontamination.codes(decontamination.normalised(t)), 10) <= 10

    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = decontamination.leaks(frame, spark.createDataFrame([(1, PASSAGE[:100])], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {i for i, t in docs if holds(t)}
