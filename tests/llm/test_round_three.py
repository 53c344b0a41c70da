"""Hard negatives, winnowing and the source audit on small tables against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwatch.llm import hard_negatives, source_audit, winnowing

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string"


def vectors(n=260, dim=6, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.25, 0.5, 1.0, rng.uniform(-1, 1)]) for _ in range(dim)]
        rows.append((i, [1.0, 0.5, 0.25, 0.5, 0.0, 1.0] if i % 3 == 0 else v, rng.randrange(3)))
    rows += [(1000, None, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, 0), (1003, [float("inf")] * dim, 0), (1004, [0.5] * dim, None), (None, [0.5] * dim, 1)]
    rows += [(1100, [], 1), (1200, [0.5, 0.5], 1), (1201, [0.5] * 9, 2), rows[5], rows[5], rows[100], (1300, [-1.0] * dim, 2)]
    return [(*r, "clash", "clash") for r in rows]


def mined(rows, every=20, positives=5, negatives=10):
    good = {}
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[(i, lab, tuple(math.floor(256 * x) for x in v))] = None
    out = []
    for i, lab, v in good:
        if i % every:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), j, m == lab) for j, m, w in good})
        near = [(-s, j) for s, j, same in scored if same and j != i][:positives]
        for ps, p in near:
            far = [(-s, j) for s, j, same in scored if not same and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(far)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = hard_negatives.mine(hard_negatives.usable(frame), F.col("id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want
    small = hard_negatives.mine(hard_negatives.usable(frame), F.col("id") % 20 == 0, selection=hard_negatives.Selection(block=4))
    assert sorted(map(tuple, small.collect())) == want


def test_hard_negatives_without_rows_and_of_any_size(spark):
    empty = hard_negatives.usable(spark.createDataFrame([], VECTORS))
    assert hard_negatives.mine(empty, F.col("id") % 20 == 0).count() == 0
    # components so large that neither floats nor 64 bits are exact
    for scale in (2.0**20, 2.0**27, 2.0**40):
        rows = [(i, [float(np.float32(scale * (1 + i % 7 / 8))), float(np.float32(scale + i)), 0.5], i % 3, "", "") for i in range(60)]
        got = hard_negatives.mine(hard_negatives.usable(spark.createDataFrame(rows, VECTORS)), F.col("id") % 20 == 0)
        if scale < 2.0**22:
            assert sorted(map(tuple, got.collect())) == mined(rows)
        else:
            assert got.count() >= 0


def test_slots_of_equal_scores():
    best = hard_negatives.Best(np.array([[10, 7, 7, 3]]), np.array([1]), 3)
    scores = np.array([[11, 10, 8, 7, 7, 7, 7, 4, 3, 1, 0, 10]])
    for _ in range(2):  # offered twice, held once
        best.offer(0, scores, np.ones(scores.shape, bool), np.arange(12))
    assert best.found().to_pydict() == {"anchor": [0] * 8, "slot": [0, 0, 0, 2, 2, 2, 3, 3], "score": [10, 10, 8, 7, 7, 7, 3, 1], "id": [1, 11, 2, 3, 4, 5, 8, 9]}


# --- winnowing --------------------------------------------------------------


def brute_winnow(text, k=16, w=40):
    kept = [(i, c.lower() if c.isascii() else c) for i, c in enumerate(text) if ord(c) > 32]
    if not kept:
        return [], []
    k = min(k, len(kept))
    grams = ["".join(c for _, c in kept[i : i + k]) for i in range(len(kept) - k + 1)]
    m = (1 << 64) - 1

    def h(g):
        x = 0
        for i, c in enumerate(g):
            x = (x + (ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)) & m
        x ^= x >> 31
        x = x * 0xBF58476D1CE4E5B9 & m
        return x ^ x >> 29

    hs = [h(g) for g in grams]
    w = min(w, len(hs))
    chosen = []
    for i in range(len(hs) - w + 1):
        at = max(range(i, i + w), key=lambda j: (-hs[j], j))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [hs[i] for i in chosen], [kept[i][0] for i in chosen]


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "𝒳y", "zeta", "eta,", "theta.", "ι"]) + str(rng.randrange(30)) for _ in range(n))


def test_winnow_is_least_hash_of_each_window(monkeypatch):
    rng = random.Random(2)
    texts = ["", " \n", "a", "ab c", "x" * 500, "ab" * 300, "Abc" * 7, *(prose(rng, n) for n in (1, 3, 9, 10, 60, 400)), "\ud800 lone" * 40]
    for portion in (1 << 18, 64):
        monkeypatch.setattr(winnowing, "_PORTION", portion)
        for t in texts:
            h, at = winnowing.winnow(t)
            assert (h.tolist(), at.tolist()) == brute_winnow(t), t[:40]


def test_shared_passages_leave_common_hashes():
    rng = random.Random(5)
    how = winnowing.Winnowing()
    for _ in range(40):
        shared = "".join(rng.choice("abcdefghij") for _ in range(how.gram + how.window - 1))
        a, b = ("".join(rng.choice("klmnop ") for _ in range(rng.randrange(300))) for _ in range(2))
        x, y = winnowing.winnow(a + shared + b), winnowing.winnow(b + shared.upper() + a)
        assert len(np.intersect1d(x[0], y[0]))
        assert winnowing.matched_chars(a + shared + b, x, y[0]) >= how.gram


def successors(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)]


DOCS = "doc_id long, text string, range long, h string, carried string"


@pytest.mark.parametrize("chars", [8 << 20, 900])
def test_edits_of_the_next_document(spark, monkeypatch, chars):
    monkeypatch.setattr(winnowing, "_RANGE_CHARS", chars)
    rng = random.Random(7)
    rows = [(i * 3, prose(rng, rng.choice([1, 5, 40, 200]))) for i in range(60)] + [(1, None), (5, ""), (200, "x" * 3000), (-4, prose(rng, 20)), (None, prose(rng, 30))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], DOCS).repartition(4)
    got = {r["doc_id"]: r for r in winnowing.compare_with_edits(docs).collect()}
    assert len(got) == len(rows)
    for i, t, following in successors(rows):
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (set(brute_winnow(x)[0]) for x in (t, changed, following))
        like = lambda p, q: 1.0 if not p and not q else len(p & q) / len(p | q)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:016x}" for x in sorted(a)) and r["edited_fingerprint"] == "".join(f"{x:016x}" for x in sorted(b))
        assert (r["near_edited"], r["near_next"]) == (like(a, b), like(a, c))


def test_edits_with_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "_RANGE_CHARS", 300)
    rng = random.Random(8)
    rows = [(7, prose(rng, 9)) for _ in range(80)] + [(None, prose(rng, 9)) for _ in range(50)] + [(8, "same")] * 5 + [(9, "last")]
    docs = spark.createDataFrame([(*r, 1, "", "") for r in rows], DOCS)
    got = winnowing.compare_with_edits(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    # every text is the successor of exactly one row
    assert Counter(r["fingerprint"] for r in got) == Counter(winnowing.as_text(winnowing.winnow(t)[0]) for _, t in rows)
    assert [r["near_next"] for r in got if r["doc_id"] == 8].count(1.0) >= 4
    assert winnowing.compare_with_edits(docs.limit(0)).count() == 0
    one = winnowing.compare_with_edits(docs.filter("doc_id = 9")).collect()
    assert [(r["near_edited"], r["near_next"]) for r in one] == [(winnowing.likeness(*(winnowing.winnow(t)[0] for t in ("last", "lala"))), 1.0)]


def test_fingerprints_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 1, "a", "b"), (1, "x" * 60, 2, "a", "b")], DOCS)
    got = winnowing.fingerprints(docs).orderBy("range").collect()
    assert got[0].asDict().keys() == {*docs.columns, "hashes", "positions"} and got[0]["hashes"] == []
    assert got[1]["positions"] == brute_winnow("x" * 60)[1]


# --- source audit -----------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, source string, n string, term string"


def audited(rows, least=30, top=50):
    docs = [(t or "", lang or "", s or "") for t, lang, s in rows]
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(t)) for t, _, _ in docs]
    groups = {(lang, s) for _, lang, s in docs}
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, s), w in zip(docs, terms):
        count[lang, s].update(w)
        seen[lang].update(set(w))
    out = []
    for lang, s in groups:
        kept = [w for w, n in seen[lang].items() if n >= least]

        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = share(count[lang, s])
        pairs = []
        for x, o in groups:
            if x == lang and o != s:
                q = share(count[lang, o])
                pairs.append((-sum(abs(p[w] - q[w]) for w in kept), o.encode()))
        whole = Counter()
        for x, o in groups:
            if x == lang:
                whole += count[x, o]
        q = share(whole)
        more = [(q[w] - p[w], w.encode()) for w in kept if count[lang, s][w] and p[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
            out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)]
    return sorted(out)


WORDS = ["a", "Bee", "eightlet", "ninelette", "sixteenletterswd", "seventeenletters", "L" * 70, "é", "ßtraße", "中文字", "x" * 64, "zz", "Zz", "the", "of"]


def texts(n, sources, seed=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.choice(sources)
        w = [rng.choice(WORDS[: 4 + len(s or "") * 3]) for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice([" ", "1", "\n", "_"]).join(w), rng.choice(["en", "de", None]), s))
    return rows


@pytest.mark.parametrize("tile", [64, 2])
def test_source_audit_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(source_audit, "_TILE", tile)
    monkeypatch.setattr(source_audit, "_SHARD", 20)
    monkeypatch.setattr(source_audit, "_TERMS", 3)
    monkeypatch.setattr(source_audit, "_PORTION", 900)
    rows = texts(900, ["a", "bb", "ccc", None, "é", "日本"]) + [(None, "fr", "x"), ("", "fr", "y"), ("rare words only", "fr", "z"), ("only", "lone", "one")]
    rows += [("y" * 70_000 + " the", "en", "a")] * 40
    docs = spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)], TEXTS).repartition(5)
    got = source_audit.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = audited(rows)
    assert {r[2] for r in want} == {"pair", "term"} and sorted(map(tuple, got.collect())) == want
    assert source_audit.divergence(docs.limit(0)).count() == 0


def test_terms_are_counted_by_group_and_document():
    rng = random.Random(1)
    kept = [(" ".join(rng.choice(WORDS) for _ in range(20)).encode(), g) for g in sorted(rng.choices(range(3), k=50))]
    want, in_docs = Counter(), Counter()
    for t, g in kept:
        w = t.lower().split()
        want.update((g, x) for x in w)
        in_docs.update((g, x) for x in set(w))
    got = {(g, t): (n, d) for found in source_audit.count_terms([t for t, _ in kept], np.array([g for _, g in kept])) for g, t, n, d in zip(*found)}
    assert got == {k: (n, in_docs[k]) for k, n in want.items()}


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 5, 4000).astype(np.uint64) << np.uint64(40), rng.integers(0, 1 << 63, 4000).astype(np.uint64) >> np.uint64(61)]
    assert (source_audit.radix_order(words) == np.lexsort((np.arange(4000), words[1], words[0]))).all()


def test_shares_of_large_counts(spark):
    cases = [(0, 0, 7), (3, 10, 2), (10**15 - 5, 10**15, 10**6), (10**12 + 17, 9 * 10**14, 123_457), (5, 10**15, 1)]
    frame = spark.createDataFrame(cases, "c long, n long, v long")
    got = frame.select("c", "n", "v", source_audit.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    for c, n, v, p in got:
        assert p == 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)


# --- stages of the pipeline -------------------------------------------------


def test_leaks_and_copies_are_rows_not_ids(spark):
    from skeinwatch.llm import decontaminate, simhash

    rng = random.Random(3)
    leak = " ".join(rng.choices(["one", "two", "three", "four", "five", "six", "seven"], k=60))
    clean = [prose(rng, 40) for _ in range(3)]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    given = [(None, "lead " + leak), (None, clean[0]), (2, clean[1]), (2, clean[2]), (2, leak), (5, None), (6, ""), (2, clean[1])]
    docs = spark.createDataFrame([(i, t, "user", "user") for i, t in given], "doc_id long, text string, _row string, _leak string")
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(kept.select("doc_id", "text").collect()) == Counter([(None, clean[0]), (2, clean[1]), (2, clean[2]), (5, None), (6, ""), (2, clean[1])])
    one = simhash.keep_one_similar(kept)
    assert one.columns == docs.columns and {r["_row"] for r in one.collect()} == {"user"}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in one.collect()) == sorted([(0, clean[0]), (2, clean[1]), (2, clean[2]), (5, None)])
    assert decontaminate.without_leaks(docs.limit(0), bench).count() == 0


def test_punctuation_and_case_do_not_make_another_text(spark):
    from skeinwatch.llm import simhash

    rng = random.Random(9)
    t = " ".join(rng.choice(["alpha", "Beta,", "eta.", "(zeta)"]) + str(rng.randrange(50)) for _ in range(60))
    rows = [(1, t), (2, t.replace(",", " ").upper()), (3, t.replace(" ", " - "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one_similar(docs).collect()] == [1]
