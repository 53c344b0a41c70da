"""Scores of texts under a hashed maximum-entropy language model.

A word's probability is that of its class times that of the word within it. Head words (the most
frequent, by a fixed number) are dealt in order of frequency into classes of equal mass; all other
words, unknown ones as one event, form the last class.

* Class: softmax of weights hashed by features of the context: the last word, the last two, and
  the last but one (skip). Every pass, each partition computes its expected feature counts in sparse
  numpy batches, the gradient (observed - expected) is summed over partitions, and the weights move
  along it, scaled by the expected counts.
* Word in class: softmax of log frequency plus weights hashed by the last word, for the most
  frequent words; its gradient depends on pair counts only, which are summed over all partitions once.
* Words of the last class have add-one frequencies.

Counts of all words stay a table: only head words go to tasks. Other words of a text meet their counts in a join,
where none is frequent. The corpus is split into words twice (counts, then ids, which are written). What each
partition gathers for a pass has a fixed size, so traffic grows with the number of partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import materialize

_END = b""
_FLUSH = 150_000


@dataclass(frozen=True)
class Settings:
    head: int = 131_071
    longest: int = 64  # bytes; longer words are never head words
    classes: int = 31
    buckets: int = 1 << 14
    paired: int = 4096
    pair_buckets: int = 256
    passes: int = 2
    rate: float = 0.4
    prior: float = 2.0


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary; empty: the end of a text), n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                held.update(_words(t.as_py()))
                held[_END] += 1
                if len(held) > _FLUSH:
                    yield out()
        yield out()

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Head words by id (most frequent first), classes, weights, and the fixed sizes of the corpus."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int, settings: Settings):
        self.settings, self.n, self.v = settings, n, v
        self.head, self.counts = [w for w, _ in head], np.array([c for _, c in head], np.int64)
        self.tail_tokens, self.tail_words = n - int(self.counts.sum()), v - len(head)
        before = np.cumsum(self.counts) - self.counts
        if len(head):
            steps = (before * settings.classes // max(1, int(self.counts.sum()))).astype(np.int64)
            _, of = np.unique(steps, return_inverse=True)
            self.first = np.concatenate([np.unique(of, return_index=True)[1], [len(head)]])
        else:
            of, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.n_classes = len(self.first)
        self.class_of = np.append(of, self.n_classes - 1).astype(np.int64)
        mass = np.bincount(of, self.counts, self.n_classes) + np.bincount([self.n_classes - 1], [self.tail_tokens + 1], self.n_classes)
        self.mass, self.log_prior = mass, np.log(mass / (n + 1)).astype(np.float32)
        self.weights = np.zeros((settings.buckets, self.n_classes), np.float32)
        self.paired = min(settings.paired, len(head))
        self.set_pairs(np.zeros((settings.pair_buckets, self.paired)))

    def tail_id(self) -> int:
        return len(self.head)

    def features(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """Buckets of the last word, the last two, and the last but one."""
        keys = (one + 1, (one + 1) * 2_654_435_761 + two * 40_503 + 7, two * 5 + 0x9E3779B1)
        return [self._hash(k + 0x1000193 * i, self.settings.buckets) for i, k in enumerate(keys)]

    def pair_bucket(self, one: np.ndarray) -> np.ndarray:
        return self._hash(one * 3 + 1, self.settings.pair_buckets)

    @staticmethod
    def _hash(key: np.ndarray, size: int) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(40)).astype(np.int64) % size

    def _logits(self, buckets: list[np.ndarray]) -> np.ndarray:
        """Weights move by at most one a pass, so their exponentials cannot overflow."""
        logits = np.take(self.weights, buckets[0], axis=0)
        for b in buckets[1:]:
            logits += np.take(self.weights, b, axis=0)
        logits += self.log_prior
        return logits

    def class_log_probabilities(self, buckets: list[np.ndarray]) -> np.ndarray:
        logits = self._logits(buckets)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits

    def class_probabilities(self, buckets: list[np.ndarray]) -> np.ndarray:
        p = np.exp(self._logits(buckets))
        p /= p.sum(axis=1, keepdims=True)
        return p

    def step(self, observed: np.ndarray, expected: np.ndarray) -> None:
        s = self.settings
        move = s.rate * (observed - expected) / (expected + s.prior)
        self.weights += np.clip(move, -1, 1).astype(np.float32)

    def set_pairs(self, pairs: np.ndarray) -> None:
        """Fits the words' weights within their classes to counts by bucket and word, and tabulates log probabilities."""
        s, k = self.settings, self.paired
        base = np.log(np.maximum(self.counts, 1) / self.mass[self.class_of[:-1]]) if len(self.head) else np.zeros(0)
        weights = np.zeros((s.pair_buckets, k))
        edges = self.first[:-1]
        plain = np.add.reduceat(np.exp(base), edges) if len(base) else np.zeros(0)
        own = np.add.reduceat(np.append(np.exp(base[:k]), np.zeros(len(base) - k)), edges) if len(base) else np.zeros(0)
        rest = plain - own
        log_z = np.zeros((s.pair_buckets, max(1, len(edges))))
        shown = self.class_of[:k]
        whole = np.zeros((s.pair_buckets, self.n_classes))
        if k and pairs.any():
            starts = np.flatnonzero(np.diff(shown, prepend=-1))
            whole[:, shown[starts]] = np.add.reduceat(pairs, starts, axis=1)
        for _ in range(8 if k and pairs.any() else 1):
            if not k:
                break
            size = np.exp(base[:k] + weights)
            starts = np.flatnonzero(np.diff(shown, prepend=-1))
            z = np.repeat(rest[None, :], s.pair_buckets, 0)
            z[:, shown[starts]] += np.add.reduceat(size, starts, axis=1)
            log_z = np.log(z)
            if not pairs.any():
                break
            expected = whole[:, shown] * np.exp(base[:k] + weights - log_z[:, shown])
            weights += np.clip(0.8 * (pairs - expected) / (expected + s.prior), -1, 1)
        self.base, self.log_z, self.pair_weights = base.astype(np.float64), log_z, weights.astype(np.float32)
        if k and pairs.any():  # the normaliser of the last weights
            size = np.exp(base[:k] + self.pair_weights)
            starts = np.flatnonzero(np.diff(shown, prepend=-1))
            z = np.repeat(rest[None, :], s.pair_buckets, 0)
            z[:, shown[starts]] += np.add.reduceat(size, starts, axis=1)
            self.log_z = np.log(z)

    def word_log_probabilities(self, ids: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Within the class; zero for words of the last class."""
        out = np.zeros(len(ids))
        head = ids < self.tail_id()
        i, g = ids[head], bucket[head]
        value = self.base[i] - self.log_z[g, self.class_of[i]]
        near = i < self.paired
        value[near] += self.pair_weights[g[near], i[near]]
        out[head] = value
        return out


def _context(ids: np.ndarray, begins: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """The last word and the last but one of every position; `outside` before a text."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[begins] = two[begins] = outside
    second = begins + 1
    two[second[second < len(ids)]] = outside
    return one, two


def _portions(batch: pa.RecordBatch, column: int, size: int = 1 << 18) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of whole texts with about `size` tokens (a longer text alone), their ids and where the texts begin and end among them."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield slice(at, upto), values[offsets[at] : offsets[upto]].astype(np.int64), offsets[at : upto + 1] - offsets[at]
        at = upto


def _positions(batch: pa.RecordBatch, column: int, m: Model) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Slices of a portion's ids, last words and last words but one."""
    for _, ids, offsets in _portions(batch, column):
        one, two = _context(ids, offsets[:-1], m.tail_id() + 1)
        for part in _batches(ids):
            yield part, (ids, one, two)


def _batches(ids: np.ndarray, size: int = 1 << 16) -> Iterator[slice]:
    for k in range(0, len(ids), size):
        yield slice(k, min(len(ids), k + size))


def tokenised(docs: DataFrame, model, text: str, doc_id: str) -> DataFrame:
    """_row, doc_id, held_out, ids (head words' ids, or the tail's, and the end), tail (other words), tail_n."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        number = {w: i for i, w in enumerate(m.head)}
        other, end = m.tail_id(), number.get(_END, m.tail_id())
        for batch in batches:
            at, size = 0, 0
            ids, tails, numbers = [], [], []
            for k, t in enumerate(batch.column(3), 1):
                words = _words(t.as_py())
                found = [number.get(w, other) for w in words]
                rest = Counter([w for w, i in zip(words, found) if i == other])
                found.append(end)
                if end == other:
                    rest[_END] += 1
                ids.append(np.array(found, np.int32))
                tails.append(list(rest))
                numbers.append(list(rest.values()))
                size += len(found)
                if size >= 1 << 18 or k == batch.num_rows:
                    made = [pa.array(ids, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int32()))]
                    given = [c.slice(at, k - at) for c in batch.columns[:3]]
                    yield pa.RecordBatch.from_arrays([*given, *made], ["_row", "doc_id", "held_out", "ids", "tail", "tail_n"])
                    at, size = k, 0
                    ids, tails, numbers = [], [], []

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(of, f"_row long, doc_id {kind}, held_out boolean, ids array<int>, tail array<binary>, tail_n array<int>")


def _summed(parts: DataFrame, shards: int) -> dict[int, np.ndarray]:
    """Sums of blocks of numbers by shard: each shard is added up as its blocks arrive, one block in memory."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(block.as_buffer(), np.float32)
                sums[shard] = sums[shard] + got if shard in sums else got.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["shard", "block"])

    rows = parts.repartition(shards, "shard").mapInArrow(add, "shard int, block binary").collect()
    return {r["shard"]: np.frombuffer(r["block"], np.float64) for r in rows}


def _gathered(tokens: DataFrame, model, observe: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Summed over the texts: observed counts by (bucket, class) and pair counts, or the expected counts of the model as it is."""
    m = model.value
    shards, wide = 32, m.settings.buckets * m.n_classes

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        total = np.zeros((m.settings.buckets, m.n_classes), order="F")
        pairs = np.zeros(m.settings.pair_buckets * m.paired)
        for batch in batches:
            for part, (ids, one, two) in _positions(batch, 0, m):
                y = m.class_of[ids[part]]
                buckets = m.features(one[part], two[part])
                if observe:
                    for b in buckets:
                        total += np.bincount(b * m.n_classes + y, minlength=total.size).reshape(total.shape)
                    near = ids[part] < m.paired
                    g = m.pair_bucket(one[part][near])
                    pairs += np.bincount(g * m.paired + ids[part][near], minlength=len(pairs))
                    continue
                p = m.class_probabilities(buckets).T.astype(np.float64, order="C")  # a row a class, laid out as such: one count of buckets each
                for b in buckets:
                    for c in range(m.n_classes):
                        total[:, c] += np.bincount(b, p[c], m.settings.buckets)
        blocks = np.array_split(total.reshape(-1).astype(np.float32), shards)
        if observe:
            blocks += np.array_split(pairs.astype(np.float32), shards)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["shard", "block"])

    sums = _summed(tokens.select("ids").mapInArrow(gather, "shard int, block binary"), shards)
    empty = np.array_split(np.zeros(wide), shards)
    first = np.concatenate([sums.get(i, empty[i]) for i in range(shards)]).reshape(m.settings.buckets, m.n_classes)
    if not observe:
        return first, None
    empty = np.array_split(np.zeros(m.settings.pair_buckets * m.paired), shards)
    return first, np.concatenate([sums.get(shards + i, empty[i]) for i in range(shards)]).reshape(m.settings.pair_buckets, m.paired)


def train(tokens: DataFrame, shared, settings: Settings):
    """Fits the model to the texts of `tokens` that are not held out; the broadcast of the fitted one."""
    context = tokens.sparkSession.sparkContext
    learn, model = tokens.filter(~F.col("held_out")), shared.value
    observed, pairs = _gathered(learn, shared, True)
    model.set_pairs(pairs)
    expected = observed.sum(axis=1, keepdims=True) * np.exp(model.log_prior.astype(np.float64))  # of the model without weights
    model.step(observed, expected)
    for _ in range(settings.passes):
        now = context.broadcast(model)
        expected, _ = _gathered(learn, now, False)
        now.unpersist()
        model.step(observed, expected)
    return context.broadcast(model)


def _scored(tokens: DataFrame, fitted) -> DataFrame:
    """Per text what head words, classes and the end give: the rest of a text is in its tail words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fitted.value
        log_count = np.log10(np.append(m.counts + 1.0, 1.0))
        for batch in batches:
            for rows, ids, offsets in _portions(batch, 3):
                one, two = _context(ids, offsets[:-1], m.tail_id() + 1)
                logp = np.zeros(len(ids))
                for part in _batches(ids):
                    y = m.class_of[ids[part]]
                    classes = m.class_log_probabilities(m.features(one[part], two[part]))
                    logp[part] = classes[np.arange(len(y)), y] + m.word_log_probabilities(ids[part], m.pair_bucket(one[part]))
                size, n = len(offsets) - 1, np.diff(offsets)
                text = np.repeat(np.arange(size), n)
                known = np.bincount(text, ids < m.tail_id(), size)
                columns = (n, known, np.bincount(text, log_count[ids], size), np.bincount(text, logp, size) / np.log(10))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
                given = [c.slice(rows.start, rows.stop - rows.start) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*given, *arrays], ["_row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "head_score"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    out = f"_row long, doc_id {kind}, held_out boolean, n_tokens long, head_known double, head_log double, head_score double"
    return tokens.select("_row", "doc_id", "held_out", "ids").mapInArrow(score, out)


def _least_head_count(counts: DataFrame, settings: Settings) -> int:
    """The count from which on words are head words, so that these are at most `settings.head`; found on steps of a 64th of an octave."""
    step = F.floor(F.log2("n") * 64)
    sizes = counts.filter((F.length("word") <= settings.longest) & (F.col("n") > 0)).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n"))
    least, words = 1 << 62, 0
    for r in sorted(sizes.collect(), key=lambda r: -r["step"]):
        words += r["words"]
        if words > settings.head:
            break
        least = r["n"]
    return least


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word frequencies) and score (the model), in log10.

    Learns from all texts that are not held out. Null and empty texts are one end. Without any text to learn from, every token
    has probability one under both. Repeated rows each have a row and are each learnt from. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    counts = materialize(word_counts(docs.filter(~held_out(F.col(doc_id))), text), "lm-counts")
    n, v = counts.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.filter((F.length("word") <= settings.longest) & (F.col("n") >= _least_head_count(counts, settings))).collect()
    head.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    shared = context.broadcast(Model([(bytes(r["word"]), r["n"]) for r in head], n, v, settings))
    tokens = materialize(tokenised(docs, shared, text, doc_id), "lm-tokens")
    fitted = train(tokens, shared, settings)
    model = fitted.value

    words = tokens.select("_row", F.explode(F.arrays_zip("tail", "tail_n")).alias("w")).select("_row", F.col("w.tail").alias("word"), F.col("w.tail_n").alias("k"))
    met = words.join(counts, "word", "left").select("_row", "k", F.coalesce("n", F.lit(0)).alias("n"))
    rest = met.groupBy("_row").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("tail_log"),
        F.sum("k").alias("tail_k"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("tail_known"),
    )
    zero = F.lit(0)
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    within = F.coalesce(F.col("tail_log") - F.col("tail_k") * float(np.log10(model.tail_tokens + model.tail_words + 1)), F.lit(0.0))
    return _scored(tokens, fitted).join(rest, "_row", "left").select(
        F.col("doc_id").alias(doc_id), "held_out", "n_tokens",
        (F.col("head_known").cast("long") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("head_score") + within).alias("score"),
    )
