"""Benchmark passages in documents, found by spaced seeds and tolerant of substituted words.

A mask keeps some places of a window of words and ignores the others, so a window still hashes alike
if the words that differ fall on ignored places. The two masks are lossless: of 13 aligned words any
two may differ and some window still hits. Test and training hashes are joined, and around every hit
the texts are compared along its diagonal. A passage is shared if 13 aligned words have at most two that
differ; of an item of 5 to 12 words all must be aligned and at most one in five differ. Reported is the
longest run around it with at most one in five different.

Benchmark items are the query set. They are cut into pieces of bounded size and dealt into blocks of
bounded size; a block's hashes go to all tasks and are joined where the documents lie, so documents
are not shuffled. More items mean more blocks, each over all documents. Only findings are shuffled.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import materialize
from .simhash import free_name, row_key

_MIN_RUN, _TOLERANCE, _MIN_ITEM = 13, 5, 5
#: Lossless for two substitutions in 13 words, which the tests prove by trying all.
LONG_MASKS = ("11101011", "11001001101")
_PIECE, _BLOCK_WORDS = 4096, 1 << 18
_MEMO = 150_000
_PAIRS_AT_ONCE = 1 << 20
_TO_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and non-ASCII characters."""
    return (text or "").encode("utf-8").lower().translate(_TO_SPACE).split()


def survives(mask: str, differ: tuple[int, ...], n: int) -> bool:
    """Whether the mask fits somewhere in n words without touching those that differ."""
    return any(all(not (0 <= p - o < len(mask) and mask[p - o] == "1") for p in differ) for o in range(n - len(mask) + 1))


@functools.cache
def masks_for(n: int) -> tuple[str, ...]:
    """Lossless masks for items of n words: the heaviest set of at most six, found greedily."""
    if n >= _MIN_RUN:
        return LONG_MASKS
    wanted = list(itertools.combinations(range(n), n // _TOLERANCE))
    for weight in range(n - n // _TOLERANCE, 0, -1):
        shapes = {"".join("1" if i in c else "0" for i in range(n)).strip("0") for c in itertools.combinations(range(n), weight)}
        reach = {m: {d for d in wanted if survives(m, d, n)} for m in sorted(shapes)}
        left, chosen = set(wanted), []
        while left and len(chosen) < 6:
            best = max(reach, key=lambda m: len(reach[m] & left))
            chosen.append(best)
            left -= reach[best]
        if not left:
            return tuple(chosen)
    raise ValueError(n)


def _mixers(n: int) -> np.ndarray:
    """Odd multipliers for the places of a mask, from a fixed recurrence."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x | 1)
    return np.array(out, np.uint64)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window, by its first word."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, i in zip(_mixers(len(mask)), [i for i, c in enumerate(mask) if c == "1"]):
        out += words[i : i + n] * k
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self):
        import xxhash

        self.digest, self.memo = xxhash.xxh64_intdigest, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, digest = self.memo, self.digest
        found = [memo.get(w) for w in words]
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                found[i] = memo[w] = digest(w)
        return np.array(found, np.uint64)


def shared(equal: np.ndarray, n: int) -> bool:
    """Whether some n aligned words have at most one in five that differs."""
    if len(equal) < n:
        return False
    sums = np.concatenate([[0], np.cumsum(equal)])
    return int((sums[n:] - sums[:-n]).max()) >= n - n // _TOLERANCE


def longest_run(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch that begins and ends with an equal word and of which at most one in five differ."""
    gain = np.where(equal, 1, 1 - _TOLERANCE)
    height = np.concatenate([[0], np.cumsum(gain)])
    lowest = np.minimum.accumulate(height)  # falls along the way: the first place not above height[b] starts the longest stretch to b
    starts = np.searchsorted(-lowest, -height, "left")
    at = int(np.argmax(np.arange(len(height)) - starts))
    a, b = int(starts[at]), at
    inside = np.flatnonzero(equal[a:b])
    return (a + int(inside[0]), a + int(inside[-1]) + 1) if len(inside) else (0, 0)


class Block:
    """Hashes of some benchmark pieces: item numbers, words, and for each mask the sorted hashes with their places."""

    def __init__(self, items: list, pieces: list[np.ndarray], lengths: list[int]):
        self.items, self.lengths = items, lengths
        sizes = [len(p) for p in pieces]
        self.words = np.concatenate([*pieces, np.zeros(0, np.uint64)]).astype(np.uint64)
        self.ends = np.cumsum(sizes).astype(np.int64)
        self.begins = self.ends - sizes
        places: dict[str, list[np.ndarray]] = {}
        hashes: dict[str, list[np.ndarray]] = {}
        for piece, begin, n in zip(pieces, self.begins, lengths):
            for mask in masks_for(n):
                h = seed_hashes(piece, mask)
                hashes.setdefault(mask, []).append(h)
                places.setdefault(mask, []).append(np.arange(len(h)) + begin)
        self.masks = {}
        for mask in hashes:
            h, p = np.concatenate(hashes[mask]), np.concatenate(places[mask])
            order = np.argsort(h, kind="stable")
            bits = min(24, max(16, int(len(h)).bit_length() + 6))
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.masks[mask] = (h[order], p[order], bits, seen)

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in `words` and in the block that begin equal windows."""
        for mask, (hashes, places, bits, seen) in self.masks.items():
            h = seed_hashes(words, mask)
            at = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(n)
            first = 0
            while first < len(at):  # a common window has many partners: in portions
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS_AT_ONCE, "right")))
                m = n[first:last]
                shift = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield np.repeat(at[first:last], m), places[np.repeat(low[first:last], m) + shift]
                first = last

    def findings(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """text number, piece number, words of the run, equal words among them, and the run's first word in the text; the best of each pair."""
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()
        for at, place in self.hits(words):
            text = np.searchsorted(ends, at, "right")
            piece = np.searchsorted(self.ends, place, "right")
            for t, p, shift in np.unique(np.stack([text, piece, at - place]), axis=1).T.tolist():
                if (t, p, shift) in tried:
                    continue
                tried.add((t, p, shift))
                low = max(int(self.begins[p]), int(begins[t]) - shift)
                high = min(int(self.ends[p]), int(ends[t]) - shift)
                equal = words[low + shift : high + shift] == self.words[low:high]
                if shared(equal, min(_MIN_RUN, self.lengths[p])):
                    a, b = longest_run(equal)
                    same = int(np.count_nonzero(equal[a:b]))
                    found = (same, b - a, -(low + shift + a - int(begins[t])))
                    best[t, p] = max(best.get((t, p), found), found)
        for (t, p), (same, size, minus) in best.items():
            yield t, p, size, same, -minus


def benchmark_pieces(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, n (words of the item), words (hashes): pieces of at most `_PIECE` words that overlap by a run."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for i, t in zip(batch["item"], batch["text"]):
                h = hashes(words_of(t)).view(np.int64)
                for k in range(0, max(1, len(h) - 2 * _MIN_RUN), _PIECE - 2 * _MIN_RUN) if len(h) >= _MIN_ITEM else ():
                    rows.append((i, len(h), h[k : k + _PIECE]))
            yield pd.DataFrame(rows, columns=["item", "n", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")).mapInPandas(cut, f"item {kind}, n long, words array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that share a passage: doc_id, item_id, n_words (of the longest run), n_equal, first_word.

    Items of fewer than five words (null and empty texts among them) are no evidence and never match; nor do
    null and empty documents. Rows with equal ids count as one document or item; null ids are an id. Columns beside those named are not read.
    """
    pieces = materialize(benchmark_pieces(benchmark, item_id), "benchmark-pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // _BLOCK_WORDS)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))))
    kind_d, kind_i = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for b in range(max(1, blocks)):
        rows = dealt.filter(F.col("block") == b).orderBy("item", "words").collect()
        block = Block([r["item"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows], [r["n"] for r in rows])
        part = read.mapInPandas(_search(docs.sparkSession.sparkContext.broadcast(block)), f"doc_id {kind_d}, item_id {kind_i}, n_words long, n_equal long, first_word long")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_equal", "n_words", (-F.col("first_word")).alias("minus"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "b.n_words", "b.n_equal", (-F.col("b.minus")).alias("first_word")
    )


def _search(shared):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, hashes = shared.value, WordHashes()
        for batch in batches:
            rows, held, sizes, first = [], [], [], 0
            texts, ids = batch["text"], batch["doc_id"]

            def search_held(upto: int) -> None:
                ends = np.cumsum(sizes)
                for t, p, size, same, at in block.findings(np.concatenate(held), ends - sizes, ends):
                    rows.append((ids.iloc[first + t], block.items[p], size, same, at))

            count = 0
            for k, t in enumerate(texts):
                h = hashes(words_of(t))
                held.append(h)
                sizes.append(len(h))
                count += len(h)
                if count >= 1 << 19:
                    search_held(k)
                    held, sizes, first, count = [], [], k + 1, 0
            if held:
                search_held(len(texts))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_equal", "first_word"])

    return search


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """`docs` without the rows whose text shares a passage with the benchmark; other rows of the same id, or without an id, stay.

    Null and empty texts stay, repeated rows stay or go together, all columns are kept whatever their names, and an empty table gives
    no rows. Rows are known by 128 bits of id and text; those to drop are written first, so Spark knows their size when it picks the join.
    """
    key = free_name(docs, "_leak")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    bad = materialize(contaminated(keyed, benchmark, text, key, item_id).select(key).distinct(), "leaks")
    return keyed.join(bad, key, "left_anti").drop(key)
