"""Document fingerprints by winnowing.

The text's code points, A-Z lower-cased and without ASCII white space and control characters, form k-grams with a rolling
hash (a polynomial modulo 2^64, from running sums). Of every `window` consecutive hashes the least is chosen, the rightmost
of equal ones. Its position in the text is kept with it. So a passage of `window + k - 1` kept code points that two texts share
leaves a common hash in both, and chosen k-grams that agree can be traced back to the passages (`matched_chars`). A text with
fewer code points than k is one gram; one without any has an empty fingerprint.

Each text is compared with an edited one that ends like the beginning of the next document, so documents meet their
successor. There is no window over all rows: ids are cut into ranges by quantiles, a range goes to one task sorted, and the
first row of each range is sent to the range before as well. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FACTOR = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2^64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_PORTION = 1 << 18  # grams hashed at a time
_RANGE_CHARS = 8 << 20
_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass(frozen=True)
class Winnowing:
    gram: int = 16
    window: int = 40


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR, _PORTION + 4096), _powers(_INVERSE, _PORTION + 4096)


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """One mixed hash for each k-gram of at most `_PORTION` + 4096 code points: running sums, shifted back to power zero."""
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _DOWN[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the least hash, the rightmost of equal ones, of each `window` consecutive hashes: doubling spans."""
    least, at, span = h, np.arange(len(h)), 1
    while span < window:
        step = min(span, window - span)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


def winnow(text: str, how: Winnowing = Winnowing()) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and the positions (code points) where their grams begin, in the order of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.flatnonzero(points > 32)
    if not len(kept):
        return _NOTHING
    points = points[kept].astype(np.uint64)
    upper = (points >= 65) & (points <= 90)
    points[upper] += np.uint64(32)
    k = min(how.gram, len(points))
    grams = len(points) - k + 1
    window = min(how.window, grams)
    hashes, places = [], []
    for first in range(0, grams - window + 1, _PORTION):  # windows that begin in [first, last)
        last = min(first + _PORTION, grams - window + 1)
        h = _gram_hashes(points[first : last + window - 1 + k - 1], k)
        at = np.unique(_rightmost_minima(h, window))
        hashes.append(h[at])
        places.append(at + first)
    h, at = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate([[True], at[1:] > np.maximum.accumulate(at)[:-1]])
    return h[new], kept[at[new]]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common share of the distinct hashes of two fingerprints; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def matched_chars(text: str, mine: tuple[np.ndarray, np.ndarray], other: np.ndarray, how: Winnowing = Winnowing()) -> int:
    """Code points of `text` under its chosen grams that the other fingerprint has too; passages whose grams overlap count once."""
    starts = mine[1][np.isin(mine[0], other)]
    if not len(starts):
        return 0
    kept = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 32)
    k = min(how.gram, len(kept))
    ends = kept[np.searchsorted(kept, starts) + k - 1] + 1
    begin = np.maximum(starts, np.concatenate([[0], ends[:-1]]))
    return int(np.maximum(ends - begin, 0).sum())


def as_text(hashes: np.ndarray) -> str:
    """The distinct hashes in order, 16 hexadecimal digits each."""
    return np.unique(hashes).astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", how: Winnowing = Winnowing()) -> DataFrame:
    """`docs` with `hashes` (array of long) and `positions` (array of int) of its texts; both empty for null and empty texts.

    Rows are kept as they are, repeated ones too; own columns of these two names are replaced.
    """

    @F.pandas_udf("hashes array<long>, positions array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [winnow(t, how) for t in texts.fillna("")]
            yield pd.DataFrame({"hashes": [h.view(np.int64) for h, _ in found], "positions": [p.astype(np.int32) for _, p in found]})

    made = docs.withColumns({"hashes": of(F.col(text).cast("string"))})
    return made.withColumns({"positions": F.col("hashes.positions"), "hashes": F.col("hashes.hashes")})


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in descending order of id (no id last), numbered by it. An id that fills a range is cut by the hash of its texts."""

    bounds: list[int]
    hot: list[bool]

    @staticmethod
    def over(docs: DataFrame, ids: str, chars: int) -> Ranges:
        parts = max(2, -(-chars // _RANGE_CHARS))
        cuts = docs.agg(F.percentile_approx(ids, [i / parts for i in range(parts)], 100 * parts)).first()[0] or []
        times = Counter(cuts)
        return Ranges(sorted(times), [times[b] > 1 for b in sorted(times)])

    def number(self, ids: Column, text_hash: Column) -> Column:
        """128 numbers a range: 0, or 1 to 64 by the hash for rows of its hot bound, which is its least id."""
        part = F.shiftright(text_hash, 58) + 33
        last = F.lit((len(self.bounds) + 1) * 128)
        if not self.bounds:
            return (last + part).cast("long")
        table, n = F.array(*[F.lit(b).cast("long") for b in self.bounds]), len(self.bounds)
        steps = [1 << i for i in reversed(range(n.bit_length()))]
        at = F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda lo, s: F.when((lo + s <= n) & (F.try_element_at(table, lo + s) <= ids), lo + s).otherwise(lo),
        )
        hot = F.array(*[F.lit(b) for b, h in zip(self.bounds, self.hot) if h]).cast("array<long>")
        sub = F.when(F.array_contains(hot, ids), part).otherwise(0) if any(self.hot) else F.lit(0)
        return F.when(ids.isNull(), last + part).otherwise((n - at) * 128 + sub).cast("long")


def _with_successors(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """range, carried (the row is only the successor of the range's last), doc_id, text; sorted so that a row's successor is the row after it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = Ranges.over(rows, "doc_id", chars)
    order = F.xxhash64("text")
    keyed = rows.withColumn("h", order).withColumn("range", ranges.number(F.col("doc_id"), F.col("h")))
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("n"))).alias("f")
    heads = sorted(keyed.groupBy("range").agg(first).collect(), key=lambda r: r["range"])  # one row a range
    before = [heads[i - 1]["range"] for i in range(len(heads))]
    table = docs.sparkSession.createDataFrame(
        [(r["f"]["doc_id"], ~r["f"]["n"], r["range"], b) for r, b in zip(heads, before)], "first_id long, first_h long, own long, before long"
    )
    is_first = (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    marked = keyed.join(F.broadcast(table), is_first, "left")  # bounded: one row for each 8 million code points
    places = F.array(F.struct(F.col("range"), F.lit(False).alias("carried")), F.struct(F.col("before").alias("range"), F.lit(True).alias("carried")))
    sent = marked.select("doc_id", "h", "text", F.explode(F.filter(places, lambda p: p["range"].isNotNull())).alias("p")).select("p.*", "doc_id", "h", "text")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorting = ["range", "carried", F.desc_nulls_last("doc_id"), "h", "text"]
    return sent.repartition(max(slots, -(-chars // (4 * _RANGE_CHARS))), "range").sortWithinPartitions(*sorting)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_MADE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, matched_chars long"


def compare_with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Winnowing = Winnowing()) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to it and to the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, matched_chars (code points of the
    text under grams that the edited text has too). The next document is that of the next smaller id, after the last the first. Rows of one id
    follow each other by the hash of their text, rows without an id come last; a single document is its own successor. Null texts are
    empty; empty texts have empty fingerprints, alike to each other and unlike all others. Repeated rows each have a row. An
    empty table gives no rows. Other columns are not read.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at = None  # range, id, text, fingerprint of the row before
        for batch in batches:
            for where, carried, i, t in zip(*(batch.column(c) for c in range(4))):
                where, carried, i, t = where.as_py(), carried.as_py(), i.as_py(), t.as_py()
                if carried and (at is None or at[0] != where):
                    continue  # a repeated first row
                own = winnow(t, how)
                if at is not None and at[0] == where:
                    rows.append(_compared(at[1], at[2], at[3], t, own, how))
                at = None if carried else (where, i, t, own)
                if len(rows) >= 512:
                    yield _made(rows)
                    rows = []
        yield _made(rows)

    return _with_successors(docs, text, doc_id).select("range", "carried", "doc_id", "text").mapInArrow(compare, _MADE)


def _compared(i: int | None, text: str, mine: tuple, following: str, theirs: tuple, how: Winnowing) -> tuple:
    changed = edited(text, following)
    other = mine if changed == text else winnow(changed, how)
    digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
    near = likeness(mine[0], other[0]), likeness(mine[0], theirs[0])
    return i, len(text), digest, as_text(mine[0]), as_text(other[0]), *near, matched_chars(text, mine, other[0], how)


def _made(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [c.split()[0] for c in _MADE.split(", ")])
