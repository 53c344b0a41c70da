"""Windows [t - W, t] of each record from one shuffle of a few narrow columns.

Time is cut into chunks of twice the width. A record goes to its own chunk and, if a window of the next chunk can still see it, to that
one too, where it is history only. Rows are dealt by (keys, chunk) and sorted by time within a task, which then works on blocks
of rows with whole-array operations: windows are pairs of positions, sums are differences of prefix sums. From block to block only the
rows go on that a later window can see, so a task holds a block and one window, not a key.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

CHUNK = 2  # widths
BLOCK = 1 << 16  # rows; more where a window holds more


class Frame(NamedTuple):
    """Positions for each row of a block, in (keys, chunk, time) order."""

    t: np.ndarray
    group: np.ndarray  # number of the row's (keys, chunk)
    first: np.ndarray  # first row of its window
    last: np.ndarray  # last row of its window: the last of its instant
    until: np.ndarray  # first row that no longer sees it


Fold = Callable[[pa.Table, Frame, np.ndarray], dict]


def longs(column) -> np.ndarray:
    """Integers as an array; nulls are zero."""
    return pc.fill_null(column, 0).to_numpy().astype(np.int64, copy=False)


def _changes(column) -> np.ndarray:
    """Whether a row differs from the one before; nulls are equal."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(pc.is_null(here), pc.is_null(before)))
    return np.concatenate([[True], differs.to_numpy(zero_copy_only=False)])


def _last_of_run(starts: np.ndarray) -> np.ndarray:
    """For each row the last row of its run; `starts` marks first rows."""
    at = np.flatnonzero(starts)
    return np.append(at[1:], len(starts))[np.cumsum(starts) - 1] - 1


def _frame(block: pa.Table, keys: list[str], width: int) -> Frame:
    starts = np.zeros(len(block), dtype=bool)
    for name in (*keys, "_b"):
        starts |= _changes(block[name])
    t = longs(block["_t"])
    group = np.cumsum(starts)
    # within a chunk stamps are small numbers, so (group, stamp) is one number that grows with the position
    place = group * ((CHUNK + 2) * width + 2) + (t - (longs(block["_b"]) * CHUNK - 1) * width)
    instant = starts | _changes(block["_t"])
    if "_o" in block.column_names:
        instant |= _changes(block["_o"])
    end = _last_of_run(starts) + 1
    return Frame(
        t, group, np.searchsorted(place, place - width), _last_of_run(instant),
        np.minimum(np.searchsorted(place, place + width, side="right"), end),
    )


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], width: int, fold: Fold, names: list[str]) -> Iterator[pa.RecordBatch]:
    carried, done, waiting, size = None, 0, [], 0

    def work(block: pa.Table, begin: int, whole: bool):
        frame = _frame(block, keys, width)
        n = len(block)
        ready = n
        if not whole:  # more rows of the last instant may come
            ready = int(np.searchsorted(frame.last, n - 1))
        wanted = np.concatenate([[0], np.cumsum(block["_hit"].to_numpy().astype(np.int64))])
        at = np.flatnonzero(frame.last == np.arange(n))
        opens = np.concatenate([[0], at[:-1] + 1])
        at = at[(at >= begin) & (at < ready) & (wanted[at + 1] > wanted[opens])]
        found = {name: block[name].take(pa.array(at)) for name in names if name in block.column_names}
        found |= fold(block, frame, at)
        keep = int(frame.first[-1])
        out = pa.table([found[name] for name in names], names=names)
        return out, block.slice(keep), ready - keep

    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size < max(BLOCK, 0 if carried is None else len(carried)):
            continue
        new = pa.Table.from_batches(waiting)
        block = (new if carried is None else pa.concat_tables([carried, new])).combine_chunks()
        out, carried, done = work(block, done, False)
        waiting, size = [], 0
        yield from out.combine_chunks().to_batches(BLOCK)
    parts = ([] if carried is None else [carried]) + ([pa.Table.from_batches(waiting)] if size else [])
    if parts:
        block = pa.concat_tables(parts).combine_chunks()
        if len(block):
            yield from work(block, done, True)[0].combine_chunks().to_batches(BLOCK)


def fold_windows(rows: DataFrame, keys: list[str], width_us: int, fold: Fold, fields: list[StructField]) -> DataFrame:
    """One row per (keys, _t[, _o]) that has a record with `_hit`: these columns and `fields`, which `fold` gives for the rows at some positions.

    rows: the keys, `_t`, `_hit`, `_o` where records of one instant have an order, and what `fold` reads. Rows without a stamp are in no window.
    """
    chunk = CHUNK * width_us
    t, here = F.col("_t"), F.floor(F.col("_t") / chunk)
    own = F.struct(here.alias("b"), F.col("_hit").alias("hit"))
    history = F.struct((here + 1).alias("b"), F.lit(False).alias("hit"))
    copies = F.when(t >= (here + 1) * chunk - width_us, F.array(own, history)).otherwise(F.array(own))
    others = [c for c in rows.columns if c != "_hit"]
    dealt = (
        rows.filter(t.isNotNull()).select(*others, F.explode(copies).alias("_c"))
        .select(*others, F.col("_c.b").alias("_b"), F.col("_c.hit").alias("_hit"))
        .repartition(*keys, "_b")
        .sortWithinPartitions(*keys, "_b", *[c for c in ("_t", "_o") if c in others])
    )
    same = [StructField(c, rows.schema[c].dataType) for c in (*keys, "_t", "_o") if c in others]
    schema = StructType([*same, *fields])
    names = schema.names

    def run(batches):
        return _blocks(batches, keys, width_us, fold, names)

    return dealt.mapInArrow(run, schema)


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values."""
    out = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def window_sum(column, frame: Frame, at: np.ndarray) -> pa.Array:
    """Sum over the window; null where it holds nulls only."""
    sums = prefix(longs(column))
    first, after = frame.first[at], frame.last[at] + 1
    empty = None
    if column.null_count:
        valid = prefix(pc.is_valid(column).to_numpy().astype(np.int64))
        empty = valid[after] == valid[first]
    return pa.array(sums[after] - sums[first], mask=empty)


def window_distinct(column, weights: list, frame: Frame, at: np.ndarray) -> list[pa.Array]:
    """Sums of each of `weights` (a column, or None for one) over the distinct values in the window; nulls do not count.

    A value is present from a record to its next one, or until the record leaves. So the total is what has begun less what has ended.
    """
    n = len(frame.t)
    codes = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy().astype(np.int64)
    pair = frame.group * (int(codes.max(initial=0)) + 2) + codes + 1
    order = np.argsort(pair, kind="stable")
    again = np.flatnonzero(pair[order][1:] == pair[order][:-1])
    ends = frame.until.copy()
    ends[order[again]] = np.minimum(ends[order[again]], order[again + 1])
    known = codes >= 0
    after = frame.last[at] + 1
    out = []
    for weight in weights:
        w = known.astype(np.int64) if weight is None else np.where(known, longs(weight), 0)
        ended = np.zeros(n + 1, dtype=np.int64)
        np.add.at(ended, ends, w)
        out.append(pa.array(prefix(w)[after] - prefix(ended)[after]))
    return out



def long_field(name: str) -> StructField:
    return StructField(name, LongType())


def narrow(rows: DataFrame, keys: dict[str, Column], tie: str, wanted: Column, *others: Column) -> DataFrame:
    """The columns that `fold_windows` reads."""
    if tie not in ("peers", "arrival"):
        raise ValueError(f"tie must be 'peers' or 'arrival', not {tie!r}")
    order = [F.col("seq").alias("_o")] if tie == "arrival" else []
    return rows.select(*[c.alias(n) for n, c in keys.items()], F.col("ts_us").alias("_t"), *order, wanted.alias("_hit"), *others)
