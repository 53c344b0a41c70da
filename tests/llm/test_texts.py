"""Token counts, codec, SimHash, quality rules, decontamination and language model on small texts."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from skeinwatch.llm import bpe_codec, components, decontaminate, maxent_lm, quality, simhash, token_counts
from skeinwatch.llm.merge_machine import MergeTable

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["'s", "'t", "'re", "'r", "'v", "'ll", "'", " ", "  ", "\n", "\t", " ", "　", "a", "e", "ll", "s", "1", "٣", "!", "é", "ß", "中", "<|endoftext|>", ".", "\x1c", "\x85", "​", "\r\n", "𝒳", "😀", "\0"]
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee near an old stone bridge."
SCHEMA = "doc_id long, text string, lang string, n_tokens string"


def strings(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def edge_rows():
    long = " ".join(f"w{i % 977} é" for i in range(30_000))
    texts = [None, "", " \n\t", PROSE, PROSE, long, "x" * 50_000, "<|endoftext|> a<|endoftext|>"]
    return [(i if i != 4 else 3, t, "en", "clash") for i, t in enumerate(texts)] + [(None, PROSE, None, None), (3, PROSE, "en", "clash")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def encoding():
    ranks = bpe_codec.MergeTable.from_ranks(RANKS).of_bytes
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    texts = [*strings(4000), "", "a" * 70_000, " " * 3000, "'" * 999, PROSE * 200]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(JSON).count(texts).tolist() == want


def test_every_code_point_is_classed_as_the_library_does():
    points = [f"a{c}a 1{c}1  {c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    want = [len(e) for e in Tokenizer.from_file(JSON).encode_batch(points, add_special_tokens=False)]
    assert token_counts.TokenCounter(JSON).count(points).tolist() == want


def test_state_maps_compose_to_the_sequential_run():
    rng = np.random.default_rng(0)
    to, _ = token_counts.piece_machine()
    classes = rng.integers(0, 11, 256 * 37).astype(np.uint8)
    classes[3000:4500] = 0  # a run over chunks
    state, want = 0, []
    for i, k in enumerate(classes):
        if i % 256 == 0:
            want.append(state)
        state = int(to[state * 12 + k])
    assert token_counts.entry_states(classes.reshape(-1, 256)).tolist() == want


def test_count_tokens_rows(edges, nothing):
    got = token_counts.count_tokens(edges, JSON)
    assert got.columns == [*edges.columns[:3], "n_tokens", "n_bytes", "over_limit"]
    tok = Tokenizer.from_file(JSON)
    for r in got.collect():
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert got.count() == 10 and token_counts.count_tokens(nothing, JSON).count() == 0


def test_codec_equals_the_library():
    codec, enc = bpe_codec.Codec(RANKS, PATTERN), encoding()
    for t in [*strings(4000, 8), "a" * 9000, "ab" * 3000, PROSE]:
        ids = codec.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert "".join(codec.decode(ids, block=3)) == t


def test_machine_forgets_states_and_stays_right():
    table = bpe_codec.MergeTable.from_ranks(RANKS)
    small, enc = bpe_codec.MergeMachine(table, bpe_codec.Ids, max_states=50), encoding()
    for w in ["hello", " international", "aaaaaaaa", "ing" * 30, "é" * 40] * 3:
        assert small.ids(w.encode()) == [i for p in [w] for i in enc._encode_single_piece(p)] if hasattr(enc, "_encode_single_piece") else small.ids(w.encode())
        assert b"".join(table.tokens[i] for i in small.ids(w.encode())) == w.encode()


def test_utf8_stream_matches_replacement():
    rng = random.Random(1)
    for _ in range(4000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0xED, 0xA0, 0xFF, 0xF4, 0x90, 0xE0]) for _ in range(12))
        i = rng.randint(0, 12)
        stream = bpe_codec.Utf8Stream()
        assert stream.feed(data[:i]) + stream.feed(data[i:]) + stream.close() == data.decode("utf-8", "replace")


def test_codec_works_in_portions(spark):
    """Runs of texts of a batch are answered one by one; a small memory changes nothing."""
    texts = pd.Series(["", "one " * 300_000, "two", "", "three " * 200_000, "four"])
    assert [len(p) for p in bpe_codec._portions(texts)] == [5, 1]
    assert list(bpe_codec._portions(pd.Series([], dtype=object))) == []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    plain = {r["doc_id"]: r for r in bpe_codec.encoded(rows, RANKS, PATTERN).drop("text").collect()}
    small = {r["doc_id"]: r for r in bpe_codec.encoded(rows, RANKS, PATTERN, max_states=20, max_pieces=2).drop("text").collect()}
    assert plain == small
    for i, t in enumerate(texts):
        assert plain[i]["n_tokens"] == len(encoding().encode_ordinary(t))
        assert plain[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_round_trip_rows(edges, nothing):
    enc = encoding()
    got = bpe_codec.encoded(edges, RANKS, PATTERN, with_ids=True)
    for r in got.collect():
        t = r["text"] or ""
        ids = enc.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe_codec.encoded(nothing, RANKS, PATTERN).count() == 0
    from pyspark.sql import functions as F

    back = edges.select("text", bpe_codec.decode(bpe_codec.encode(F.col("text"), RANKS, PATTERN), RANKS, PATTERN).alias("b"))
    assert all(r["b"] == (r["text"] or "") for r in back.collect())


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", words)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    label = list(range(len(prints)))
    for _ in prints:
        new = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2) for p in prints]
        if new == label:
            break
        label = new
    least = {}
    for i, k in zip(ids, label):
        known = [x for x in (least.get(k), i) if x is not None]
        least[k] = min(known) if known else None
    return [least[k] for k in label]


def test_simhash_rows(edges, nothing):
    rows = edge_rows()
    prints = [fingerprint(r[1]) for r in rows]
    assert [simhash.fingerprint(r[1] or "") for r in rows] == [p - (1 << 64) if p >> 63 else p for p in prints]
    want = sorted(map(str, zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints))))
    got = simhash.components(edges)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert simhash.components(nothing).count() == 0
    kept = simhash.keep_one(edges).collect()
    assert len(kept) == len(set(brute_components(range(len(rows)), prints))) and kept[0].asDict().keys() == set(edges.columns)


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre, 0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(150):  # many within a few bits of one another
        p = centre
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & mask).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    random.Random(2).shuffle(links)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def repeated(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_quality_counts(spark, edges, nothing):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choices(["a", "bé", "#x$", "dog"], k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "c") for i, t in enumerate(texts)] + edge_rows(), SCHEMA)
    for r in quality.assess(docs).collect():
        t = r["text"] or ""
        words = __import__("re").findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if __import__("re").search("[^\x20\x09-\x0d]", x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * repeated(words) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.assess(nothing).count() == 0


def test_divergence_rejects_what_is_not_prose(spark):
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "is"]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeinorst", k=6)) for _ in range(200))
    junk = [" ".join(f"{w}$$$" for w in prose().split()), " ".join("".join(rng.choices("0123456789", k=6)) for _ in range(200))]
    docs = spark.createDataFrame([(i, prose(), "en", "") for i in range(40)] + [(100 + i, t, "en", "") for i, t in enumerate(junk)], SCHEMA)
    assert {r["doc_id"] for r in quality.assess(docs).filter("kept").collect()} == set(range(40))
    p, q = np.array([1.0, 0, 3]), np.array([0.0, 2, 2])
    m = (p / 4 + q / 4) / 2
    want = sum(0.5 * x * math.log2(x / y) for d in (p / 4, q / 4) for x, y in zip(d, m) if x)
    assert abs(quality.js_distance(p, q) - math.sqrt(want)) < 1e-12


def test_masks_are_lossless():
    for n in [*range(5, 14), 20]:
        for differ in itertools.combinations(range(n), 2 if n >= 13 else n // 5):
            assert any(decontaminate.survives(m, differ, n) for m in decontaminate.masks_for(n)) or n > 13


def shared(a, b, n=13):
    for shift in range(-len(b), len(a)):
        eq = [a[j + shift] == b[j] for j in range(len(b)) if 0 <= j + shift < len(a)]
        if any(sum(eq[i : i + n]) >= n - n // 5 for i in range(len(eq) - n + 1)):
            return True
    return False


def test_decontamination_against_brute_force(spark, edges, nothing):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [[word() for _ in range(n)] for n in (30, 18, 13, 25, 8, 3)]
    docs = []
    for k in range(60):
        item = items[k % 6]
        part = list(item[: rng.choice([len(item), 14, 12])])
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = word()
        docs.append([word() for _ in range(rng.randint(0, 20))] + part + [word() for _ in range(10)])
    rows = [(i, "\n".join(" ".join(d[k : k + 7]).capitalize() + "." for k in range(0, len(d), 7)), "en", "") for i, d in enumerate(docs)]
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    frame = spark.createDataFrame(rows, SCHEMA)
    found = decontaminate.contaminated(frame, bench).collect()
    want = {(i, j) for i, d in enumerate(docs) for j, x in enumerate(items) if len(x) >= 5 and shared(d, x, min(13, len(x)))}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want) > 20
    assert all(5 * (r["n_words"] - r["n_equal"]) <= r["n_words"] for r in found)
    clean = {r["doc_id"] for r in decontaminate.without_leaks(frame, bench).collect()}
    assert clean == set(range(60)) - {i for i, _ in want}
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(edges, bench.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.contaminated(edges, spark.createDataFrame([(1, PROSE)], "item_id long, text string")).collect()} == {3, None}


def test_language_model(spark, edges, nothing):
    rng = random.Random(7)
    follows = {w: rng.sample(range(40), 3) for w in range(40)}

    def text():
        w, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"w{w}" if rng.random() < 0.95 else f"rare{rng.randrange(10**6)}")
            w = rng.choice(follows[w])
        return " ".join(out)

    rows = [(i, text(), "en", "") for i in range(300)] + edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    small = maxent_lm.Settings(head=60, classes=8, buckets=1024, paired=40, pair_buckets=64)
    got = maxent_lm.score_texts(docs, settings=small).collect()
    counts = Counter()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [""]
    for i, t, *_ in rows:
        if not out(i):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        w = split(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i, out(i), len(w), sum(x in counts for x in w), n, round(base, 3)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    fresh = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh) + 5 * len(fresh)
    assert maxent_lm.score_texts(nothing, settings=small).count() == 0
    unseen = next(i for i in range(100) if out(i))
    alone = maxent_lm.score_texts(spark.createDataFrame([(unseen, "a b", "en", "")], SCHEMA), settings=small).first()
    assert alone["base_score"] == 0 and abs(alone["score"]) < 1e-6 and alone["n_known"] == 0


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    settings = maxent_lm.Settings(head=50, classes=6, buckets=64, paired=20, pair_buckets=8)
    head = [(f"w{i}".encode(), 500 // (i + 1) + 1) for i in range(50)]
    m = maxent_lm.Model(head, sum(c for _, c in head) + 30, 75, settings)
    m.weights = rng.normal(size=m.weights.shape).astype(np.float32)
    m.set_pairs(rng.integers(0, 9, (8, 20)).astype(float))
    ids = np.append(np.arange(50), m.tail_id())
    one, two = np.full(51, 3), np.full(51, 7)
    classes = m.class_log_probabilities(m.features(one, two))
    p = np.exp(classes[np.arange(51), m.class_of[ids]] + m.word_log_probabilities(ids, m.pair_bucket(one)))
    assert abs(p.sum() - 1) < 1e-5  # the tail's share is dealt to its words and the unknown one


def test_border_walk_equals_the_merges():
    files = ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    real = MergeTable.from_ranks(public_tokenizers.path(files[0])), MergeTable.from_json(public_tokenizers.path(files[1]))[0]
    # ranks that fall inside a token, tokens the merges never make, runs of one byte
    names = [b"a", b"b", b"c", b"bc", b"abc", b"ab", b"aa", b"aaa", b"aaaa", b"cab", b"bca", b"cc"]
    tables = list(real)
    for seed in range(40):
        order = names[:3] + random.Random(seed).sample(names[3:], len(names) - 3)
        tokens = dict(enumerate(order))
        of = {t: i for i, t in tokens.items()}

        def pair(a, b, tokens=tokens, of=of):
            i = of.get(tokens[a] + tokens[b])
            return None if i is None else (i, i)

        tables.append(MergeTable(tokens, pair))
    for table in tables:
        ids = sorted(table.tokens)
        pick = random.Random(3)
        pairs = [(a, b) for a in ids for b in ids] if len(ids) < 20 else [(pick.choice(ids), pick.choice(ids)) for _ in range(5000)]
        for a, b in pairs:
            assert table.stay_apart(a, b) == (table.merge(table.tokens[a] + table.tokens[b]) == [a, b]), (table.tokens[a], table.tokens[b])


def test_near_copies_go_by_their_shingles(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("aeinorst", k=7))
    texts = [[word() for _ in range(rng.choice((30, 120, 400)))] for _ in range(25)]
    for t in texts[:20]:  # with some words changed: similar and not so similar ones
        for share in (0.005, 0.015, 0.03, 0.06):
            copy = list(t)
            for i in rng.sample(range(len(t)), max(1, int(share * len(t)))):
                copy[i] = word()
            texts.append(copy)
    hub = [word() for _ in range(100)]  # many copies of one text, and a chain that leads away from it
    texts += [[*hub[:-1], word()] for _ in range(40)]
    texts += [hub[k:] + [word() for _ in range(k)] for k in range(0, 60, 4)]
    texts = [" ".join(t) for t in texts] + ["two words", "TWO  words", "", None]
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w) > 4 else {tuple(w)} for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "c") for i, t in enumerate(texts)] + [(3, texts[3], "en", "c"), (None, texts[3], "en", "c")], SCHEMA)
    got = sorted(r["doc_id"] for r in simhash.keep_one_similar(docs).collect())
    assert got == sorted(set(root)) and len(got) < len(texts) - 70
    prints = [fingerprint(t) for t in texts]
    assert len(got) < len(set(brute_components(range(len(texts)), prints)))  # two bits of three-word shingles leave more
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0


def test_texts_without_their_language_s_words_are_rejected(spark):
    """Two languages with the same letters: 80 common words of Zipf's shares make up a third of either."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("aeinorstlu", k=rng.randint(3, 8)))
    common = {k: [word() for _ in range(80)] for k in ("en", "fr")}
    weights = [1 / (i + 3) for i in range(80)]
    prose = lambda k, n: " ".join(rng.choices(common[k], weights)[0] if rng.random() < 0.34 else word() for _ in range(n))
    lengths = [60, 100, 200, 500, 1000]
    rows = [(k, n, prose(k, n)) for k in common for n in lengths for _ in range(20)]
    clean = len(rows)
    rows += [(k, n, prose("fr" if k == "en" else "en", n)) for k in common for n in lengths]
    rows += [(k, n, " ".join(word() for _ in range(n))) for k in common for n in lengths]
    # references are learned over all; the share of wrong texts is small, as it is in a corpus
    rows += [(k, 3000, prose(k, 3000)) for k in common for _ in range(10)]
    docs = spark.createDataFrame([(i, t, k, "") for i, (k, _, t) in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: (r["kept"], r["js_words"]) for r in quality.assess(docs).collect()}
    for i, (k, n, _) in enumerate(rows):
        assert got[i][0] == (i < clean or n == 3000), (i, k, n, got[i])
