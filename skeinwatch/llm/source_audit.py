"""How far the sources of a language diverge in what words they use.

Terms are counted by length-bucketed packing: terms of up to 8 bytes are one uint64, up to 16 bytes two, big endian and
filled up with zero bytes, which no term has; they are radix-sorted by 16-bit digits and counted by runs in numpy. Longer
terms are sorted as bytes, apart. Each portion of texts is ordered by group first and the sorts are stable, so that a run gives
the occurrences in a group and, from changes of the text within it, its documents. Spark then adds the portions' counts up
by (lang, term), which is the only exchange of terms.

Frequencies are whole numbers out of a thousand million, exact for counts up to 10^15. Distances of two sources are sums over all kept
terms; each (lang, pair of tiles of sources) is summed over shards of the terms, in numpy over a few thousand terms at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import materialize

_PORTION = 6 << 20  # bytes of text counted at a time
_LONGEST = 1 << 16  # longer terms are sorted one by one, so that no array is as wide as all of them
_TILE = 64  # sources
_TERMS = 2048
_SHARD = 1 << 16  # rows
_SMOOTH, _SCALE = 5, 1_000_000_000
_COUNTED = "lang string, source string, term binary, n long, docs long"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of a term, and what they become: only A-Z change."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    part = (low >= 128) | ((low >= 97) & (low <= 122))
    return part, low


_PART, _LOW = _letters()


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows of uint64 words (most significant first), by 16-bit digits from the least."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Terms of at most 8 * n_words bytes as n_words uint64 each."""
    out = []
    for w in range(n_words):
        word = np.zeros(len(starts), np.uint64)
        for j in range(8 * w, 8 * w + 8):
            has = np.flatnonzero(sizes > j)
            word[has] |= text[starts[has] + j].astype(np.uint64) << np.uint64(8 * (7 - j % 8))
        out.append(word)
    return out


def _runs(change: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of runs of one term and group in the sorted rows, their sizes and their documents."""
    new = change.copy()
    new[1:] |= group[1:] != group[:-1]
    text = new.copy()
    text[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new))), np.add.reduceat(text.astype(np.int64), at) if len(at) else at


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """group, term, occurrences, documents, for each bucket of lengths; `groups` (of the texts) in ascending order."""
    text = _LOW[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    edge = np.diff(_PART[text].astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - starts
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, starts, "right")
    group = groups[doc]
    for n_words, low, high in ((1, 0, 8), (2, 8, 16)):
        mine = np.flatnonzero((sizes > low) & (sizes <= high))
        words = packed(text, starts[mine], sizes[mine], n_words)
        order = radix_order(words)
        words = [w[order] for w in words]
        change = np.ones(len(mine), bool)
        change[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        at, n, docs = _runs(change, group[mine[order]], doc[mine[order]])
        flat = np.stack([w[at] for w in words], axis=1).astype(">u8").view(f"S{8 * n_words}").reshape(-1)
        yield group[mine[order[at]]], flat.tolist(), n, docs  # numpy leaves the zero bytes at the end out
    mine = np.flatnonzero(sizes > 16)
    whole = text.tobytes()
    for width in (64, _LONGEST, None):
        some = mine[(sizes[mine] <= width)] if width else mine
        mine = mine[sizes[mine] > width] if width else mine[:0]
        terms = np.empty(len(some), object)
        terms[:] = [whole[a : a + n] for a, n in zip(starts[some], sizes[some])]
        order = np.argsort(terms.astype(bytes), kind="stable") if width == 64 and len(some) else np.array(sorted(range(len(some)), key=terms.__getitem__), np.int64)
        terms = terms[order]
        change = np.ones(len(some), bool)
        change[1:] = terms[1:] != terms[:-1]
        at, n, docs = _runs(change, group[some[order]], doc[some[order]])
        yield group[some[order[at]]], terms[at].tolist(), n, docs


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term (binary), n, docs: occurrences and documents, partly summed. Every group has a row of the empty term with zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            names = sorted({(x, s) for x, s, _ in held})
            number = {g: i for i, g in enumerate(names)}
            held.sort(key=lambda r: number[r[:2]])
            groups = np.array([number[r[:2]] for r in held], np.int64)
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            none = np.zeros(len(names), np.int64)
            for group, terms, n, in_docs in [*count_terms([r[2] for r in held], groups), (np.arange(len(names)), [b""] * len(names), none, none)]:
                at = pa.array(group)
                arrays = [langs.take(at), sources.take(at), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, s, t in zip(langs, sources, batch.column(2)):
                t = t.as_buffer().to_pybytes()
                held.append((x, s, t))
                size += len(t)
                if size >= _PORTION:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*given).mapInArrow(count, _COUNTED)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) by long division, three digits at a time, within 64 bits up to counts of 10^15."""
    base = total + terms * _SMOOTH
    whole, rest = F.lit(0).cast("long"), count + _SMOOTH
    rest, whole = _divide(rest, base)
    for _ in range(3):
        left, more = _divide(rest * 1000, base)
        whole, rest = whole * 1000 + more, left
    return whole + 1


def _divide(x: Column, base: Column) -> tuple[Column, Column]:
    return x % base, F.call_function("div", x, base)


def kept_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """lang, source, term, n, lang_n for terms in at least `least_docs` documents of their language; and lang, source of all groups."""
    partial = term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = partial.select("*", F.sum("docs").over(whole).alias("lang_docs"), F.sum("n").over(whole).alias("lang_n"))
    found = materialize(summed.filter((F.col("lang_docs") >= least_docs) | (F.length("term") == 0)).drop("docs", "lang_docs"), "audit-counts")
    empty = F.length("term") == 0
    return found.filter(~empty), found.filter(empty).select("lang", "source")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for every occurring (lang, source).

    A language keeps the terms (letters and all characters beyond ASCII; A-Z lower-cased) in at least `least_docs` of its documents; a
    group's frequency of a kept term is `share` of its occurrences there. Part `pair`: every other source of the language and the sum of
    absolute differences over all kept terms. Part `term`: kept terms that occur in the group and are more frequent there than in the language,
    with the difference, the first `top`. Ranks from 1 by value descending, then item ascending by UTF-8 bytes.
    Null texts, languages and sources are empty ones. Repeated rows each count. Groups without terms have pairs (of value 0 if their
    language keeps none). An empty table gives no rows. Other columns are not read.
    """
    counts, groups = kept_counts(docs, text, lang, source, least_docs)
    zero = F.lit(0).cast("long")
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"), F.count("*").alias("lang_rows"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    known = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sizes, "lang")
    filled = known.select("lang", "source", "sources", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms", "lang_rows")])
    known = materialize(filled, "audit-groups")

    p, q, none = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")), share(zero, F.col("total"), F.col("terms"))
    rows = counts.join(known, ["lang", "source"]).select("lang", "source", "term", "sources", "lang_rows", p.alias("p"), none.alias("none"), (p - q).alias("more"))
    terms = rows.filter("more > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.col("more").alias("value"))
    pairs = distances(rows, known).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))


def distances(rows: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the summed absolute differences of `p` over the kept terms; `none` where a term is absent.

    `known` has every group with its `total`, and its language's `terms`, `sources` and `lang_rows` (rows of kept terms).
    """
    tiles = F.ceil(F.col("sources") / _TILE)
    tile = F.pmod(F.xxhash64("source"), tiles).cast("int")
    every = F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int")))
    shards = F.ceil(F.col("lang_rows") * 2 / (tiles * _SHARD)).cast("int")
    absent = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    ends = known.withColumn("none", F.when(F.col("terms") > 0, absent).otherwise(0)).select("lang", "source", "terms", "none", tile.alias("tile"), every.alias("with"), shards.alias("shards"))
    # every shard of terms has the sources of its tiles, as rows of the empty term, before the terms
    listed = ends.filter("shards > 0").select("lang", "source", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("p"), "none", "tile", "with", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    given = rows.select("lang", "source", "term", "p", "none", tile.alias("tile"), every.alias("with"), F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"))
    dealt = listed.unionByName(given).select("lang", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "shard", "term", "source", "p", "none", "tile")
    part = dealt.repartition("lang", "a", "b", "shard").sortWithinPartitions("lang", "a", "b", "shard", "term").mapInArrow(_summed_pairs, "lang string, source string, item string, value long, met long")
    met = part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    # what a pair differs by where both lack a term is the same for all such terms: only terms of either are summed, and counted
    x = ends.select("lang", "source", "terms", F.col("none").alias("x"), F.col("tile").alias("a"), F.col("with").alias("b"))
    y = ends.select("lang", F.col("source").alias("item"), F.col("none").alias("y"), F.col("with").alias("a"), F.col("tile").alias("b"))
    both = x.join(y, ["lang", "a", "b"]).filter("source != item").join(met, ["lang", "source", "item"], "left")
    rest = (F.col("terms") - F.coalesce("met", F.lit(0))) * F.abs(F.col("x") - F.col("y"))
    return both.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).cast("long").alias("value"))


def _summed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms met (those that any source here has), per pair of sources; whole terms are taken a portion at a time."""
    held: list[pa.RecordBatch] = []
    listed: dict[tuple, pd.DataFrame] = {}
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _TERMS * 8:
            table = pa.Table.from_batches(held)
            cut = _last_whole(table)
            if cut:
                yield from _pair_sums(table.slice(0, cut).to_pandas(), listed)
                held = table.slice(cut).to_batches()
    if held:
        yield from _pair_sums(pa.Table.from_batches(held).to_pandas(), listed)


def _last_whole(table: pa.Table) -> int:
    """Rows before the last term (its rows may go on in the next batch)."""
    columns = [table.column(c) for c in ("lang", "a", "b", "shard", "term")]
    at = table.num_rows
    last = [c[-1] for c in columns]
    while at and [c[at - 1] for c in columns] == last:
        at -= 1
    return at


def _pair_sums(frame: pd.DataFrame, listed: dict[tuple, pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    """`listed` keeps the sources of the one shard that may go on; a portion of terms is a dense block of frequencies."""
    for where, part in frame.groupby(["lang", "a", "b", "shard"], sort=False):
        heading = part["term"].to_numpy(object) == b""
        if heading.any():
            listed.clear()
            listed[where] = part[heading].sort_values("source")
            part = part[~heading]
        if part.empty:
            continue
        sources = listed[where]
        names = sources["source"].to_numpy(object)
        none, tile = sources["none"].to_numpy(np.int64), sources["tile"].to_numpy()
        s = np.searchsorted(names, part["source"].to_numpy(object))
        t, p = np.unique(part["term"].to_numpy(object), return_inverse=True)[1], part["p"].to_numpy(np.int64)
        value, met = np.zeros((len(names), len(names)), np.int64), np.zeros((len(names), len(names)), np.int64)
        for first in range(0, int(t.max()) + 1, _TERMS):
            some = (t >= first) & (t < first + _TERMS)
            width = min(_TERMS, int(t.max()) + 1 - first)
            dense, has = np.repeat(none[:, None], width, 1), np.zeros((len(names), width), bool)
            dense[s[some], t[some] - first], has[s[some], t[some] - first] = p[some], True
            for i in range(len(names)):
                either = has | has[i]
                value[i] += np.where(either, np.abs(dense - dense[i]), 0).sum(axis=1)
                met[i] += either.sum(axis=1)
        x, y = np.nonzero(met)
        apart = (x != y) & ((where[1] == where[2]) | (tile[x] != tile[y]))  # of two tiles, pairs across them
        x, y = x[apart], y[apart]
        arrays = [pa.array([where[0]] * len(x), pa.string()), pa.array(names[x], pa.string()), pa.array(names[y], pa.string()), pa.array(value[x, y]), pa.array(met[x, y])]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "item", "value", "met"])
