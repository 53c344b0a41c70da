"""Running totals along an order that one task need not hold: two levels.

Rows are cut into slices along the order. Each slice is reduced, with map-side combine; the slices' results, one short row each,
are scanned; within a slice a running total starts from what all slices before it gave. So the largest group that a
window holds is a slice, or one row for each slice of a key.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def before_slices(rows: DataFrame, keys: list[str], slice_column: str, parts: dict[str, Column], scan: Callable[[str], Column] = F.sum) -> DataFrame:
    """One row per (keys, slice): for each of `parts` (an aggregate of a slice) the scan over all earlier slices; null for the first."""
    reduced = rows.groupBy(*keys, slice_column).agg(*[c.alias(n) for n, c in parts.items()])
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    return reduced.select(*keys, slice_column, *[scan(n).over(earlier).alias(n) for n in parts])


def running_sums(rows: DataFrame, keys: list[str], slice_column: str, order: list[str], sums: list[str]) -> DataFrame:
    """`rows` with each of `sums` replaced by its running total along `order` within `keys`."""
    return running_scans(rows, keys, slice_column, order, dict.fromkeys(sums, F.sum))


def running_scans(rows: DataFrame, keys: list[str], slice_column: str, order: list[str], scans: dict[str, Callable[[str], Column]]) -> DataFrame:
    """`rows` with each column of `scans` replaced by its running sum, least or greatest value (`F.sum`, `F.min`, `F.max`) along `order` within `keys`.

    Slices must follow the order, of which the first column is never null. What a slice begins with enters it as a row before all others, so there is no join
    and null keys are keys like any other.
    """
    mark = "_carried"
    others = [c for c in rows.columns if c not in (*keys, slice_column, *scans, *order)]
    # the slices read every column, so that both branches are the same exchange and the rows are made once
    reduced = rows.groupBy(*keys, slice_column).agg(*[scan(c).alias(c) for c, scan in scans.items()], *[F.max(c).alias(c) for c in others])
    earlier = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)

    def start(c: str) -> Column:
        if c in order:
            return F.lit(None).cast(rows.schema[c].dataType).alias(c)
        return scans[c](c).over(earlier).alias(c) if c in scans else F.col(c)

    first = reduced.select(*[start(c) for c in rows.columns], F.lit(True).alias(mark))
    run = Window.partitionBy(*keys, slice_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = rows.withColumn(mark, F.lit(False)).unionByName(first)
    return every.select(*[scans[c](c).over(run).alias(c) if c in scans else F.col(c) for c in rows.columns], mark).filter(~F.col(mark)).drop(mark)


def with_neighbours(rows: DataFrame, keys: list[str], slice_column: str, order: list[str], fields: list[str]) -> DataFrame:
    """`rows` with `prev2`, `prev1`, `next1`, `next2`: structs of `fields` of the two rows before and after along `order` within `keys`, null at the ends.

    Slices must follow the order, and `fields` must begin with it: they are compared in that order. Within a slice neighbours come from one
    window; those beyond it from the slices next to it, of which each gives its first and last two rows.
    """
    at = Window.partitionBy("_k", slice_column).orderBy(*order)
    rows = rows.withColumn("_k", F.struct(*keys)).withColumn("_me", F.struct(*fields))  # a struct is never null, so null keys join
    near = {"l2": F.lag("_me", 2), "l1": F.lag("_me", 1), "r1": F.lead("_me", 1), "r2": F.lead("_me", 2)}
    inner = rows.select("*", *[c.over(at).alias(f"_{n}") for n, c in near.items()])
    ends = inner.filter("_l2 IS NULL OR _r2 IS NULL").groupBy("_k", slice_column).agg(F.array_sort(F.collect_list("_me")).alias("e"))  # four rows at most
    head, tail = F.slice("e", 1, 2), F.slice(F.col("e"), F.greatest(F.size("e") - 1, F.lit(1)), F.lit(2))
    ends = ends.select("_k", slice_column, head.alias("head"), tail.alias("tail"), F.slice("e", 1, 0).alias("none"))
    by_slice = Window.partitionBy("_k").orderBy(slice_column)
    before = F.concat(*[F.coalesce(F.lag("tail", n).over(by_slice), "none") for n in (2, 1)])
    after = F.concat(*[F.coalesce(F.lead("head", n).over(by_slice), "none") for n in (1, 2)])
    around = ends.select("_k", slice_column, before.alias("_before"), after.alias("_after"))
    p1, p2, n1, n2 = (F.try_element_at(c, F.lit(i)) for c, i in (("_before", -1), ("_before", -2), ("_after", 1), ("_after", 2)))

    def second(found: str, first: str, one: Column, two: Column) -> Column:
        return F.coalesce(F.col(found), F.when(F.col(first).isNull(), two).otherwise(one))

    return inner.join(around, ["_k", slice_column]).select(
        *[c for c in rows.columns if c not in ("_k", "_me")],
        second("_l2", "_l1", p1, p2).alias("prev2"), F.coalesce("_l1", p1).alias("prev1"),
        F.coalesce("_r1", n1).alias("next1"), second("_r2", "_r1", n1, n2).alias("next2"),
    )
