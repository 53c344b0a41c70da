"""Exact per-record sliding windows [t-W, t] without sliding frames.

A RANGE frame re-aggregates the whole frame for every row, and a window partitioned by the
key alone puts a hot key into one task. Both are avoided here:

* time is cut into chunks, so one key is spread over many tasks, and narrow rows are shuffled
  once, by (key, chunk) (`chunks`);
* sums are differences of prefix sums at the ends of the window;
* a value counts from a record to its next one or until it leaves, so a distinct count is what
  has begun less what has ended.

`tie="peers"` lets records of one instant see each other (independent of arrival order);
`tie="arrival"` orders them by `seq`, as a sequential reader would.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinwatch.operators.chunks import fold_windows, long_field, narrow, window_distinct, window_sum

SECOND = 1000000
SLICES = 64  # of a window's width
BEFORE = -1  # ordering of steps that take effect before any record of the same instant


def bucket_of(ts: Column, width_us: int) -> Column:
    return F.floor(ts / width_us)  # exact: stamps stay below 2^53


def order_column(tie: str) -> Column:
    if tie == "peers":
        return F.lit(0).cast("bigint")
    if tie == "arrival":
        return F.col("seq")
    raise ValueError(f"tie must be 'peers' or 'arrival', not {tie!r}")


def _long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def sliding_features(
    rows: DataFrame,
    keys: dict[str, Column],
    seconds: int,
    sums: dict[str, Column] | None = None,
    distincts: dict[str, tuple[Column, dict[str, Column | int]]] | None = None,
    tie: str = "peers",
    wanted: Column | None = None,
) -> DataFrame:
    """One row per (keys, ts_us[, seq]) with the window's sums and distinct counts.

    sums: output name -> integer value added up over the window.
    distincts: name -> (value, {output name: weight}); weights are summed over the distinct
    values in the window (weight 1 gives a distinct count). A weight must depend on the
    value only. Null values are ignored.
    wanted: instants with no such record are left out of the result.
    """
    sums = {k: _long(v) for k, v in (sums or {}).items()}
    distincts = distincts or {}
    ones = {o for _, outs in distincts.values() for o, w in outs.items() if isinstance(w, int) and w == 1}
    weights = {o: _long(w) for _, outs in distincts.values() for o, w in outs.items() if o not in ones}
    values = {f"_v_{n}": v.cast("string") for n, (v, _) in distincts.items()}
    outs_of = {f"_v_{n}": list(outs) for n, (_, outs) in distincts.items()}
    outputs = [*sums, *[o for outs in outs_of.values() for o in outs]]
    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    added, weighted = list(sums), list(weights)
    columns = [c.alias(n) for n, c in {**sums, **weights, **values}.items()]

    def fold(block, frame, at):
        found = {name: window_sum(block[name], frame, at) for name in added}
        for value, outs in outs_of.items():
            by = [block[o] if o in weighted else None for o in outs]
            found |= dict(zip(outs, window_distinct(block[value], by, frame, at)))
        return found

    base = narrow(rows, keys, tie, wanted, *columns)
    out = fold_windows(base, list(keys), seconds * SECOND, fold, [long_field(o) for o in outputs])
    order = [F.col("_o").alias("seq")] if tie == "arrival" else []
    return out.select(*keys, F.col("_t").alias("ts_us"), *order, *outputs)


def sliding_max(
    rows: DataFrame,
    keys: dict[str, Column],
    seconds: int,
    value: Column,
    out: str,
    tie: str = "peers",
) -> DataFrame:
    """Sliding maximum: running maximum of the own bucket, and what is left of the previous
    bucket's suffix maximum as its records leave."""
    width = seconds * SECOND
    names = list(keys)
    base = (
        rows.select(
            *[c.alias(n) for n, c in keys.items()],
            F.col("ts_us").alias("_t"), order_column(tie).alias("_o"), value.alias("_v"),
        )
        .groupBy(*names, "_t", "_o").agg(F.max("_v").alias("_v"))
        .withColumn("_b", bucket_of(F.col("_t"), width))
    )
    later = Window.partitionBy(*names, "_b").orderBy(F.desc("_t"), F.desc("_o"))
    rest = F.struct(F.max("_v").over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    whole = F.max("_v").over(Window.partitionBy(*names, "_b"))
    base = base.withColumn("_rest", rest).withColumn("_whole", F.struct(whole.alias("m")))
    none = F.lit(None).cast(base.schema["_rest"].dataType)
    none_v = F.lit(None).cast(base.schema["_v"].dataType)
    before = F.lit(BEFORE).cast("bigint")

    def step(bucket, t, o, v, left, hit):
        return F.struct(
            bucket.alias("_b"), t.alias("_t"), o.alias("_o"), F.col("_o").alias("_x"),
            v.alias("_v"), left.alias("_left"), F.lit(hit).alias("_hit"),
        )

    b, t = F.col("_b"), F.col("_t")
    latest = F.col("_rest.m").isNull()  # only the bucket's last record announces the whole
    steps = F.array(
        step(b, t, F.col("_o"), F.col("_v"), none, 1),
        F.when(latest, step(b + 1, (b + 1) * width - 1, before, none_v, F.col("_whole"), 0)),
        step(b + 1, t + width + 1, before, none_v, F.col("_rest"), 0),
    )
    events = (
        base.select(*names, F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("_s"))
        .select(*names, "_s.*")
    )
    run = (
        Window.partitionBy(*names, "_b")
        .orderBy("_t", "_o", "_x")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    order = [F.col("_o").alias("seq")] if tie == "arrival" else []
    return (
        events.select(
            *names, "_t", "_o", "_hit",
            F.max("_v").over(run).alias("_own"),
            F.last("_left", ignorenulls=True).over(run).alias("_ctx"),
        )
        .filter("_hit = 1")
        .select(
            *names, F.col("_t").alias("ts_us"), *order,
            F.greatest(F.col("_own"), F.col("_ctx.m")).alias(out),
        )
    )


def attach(rows: DataFrame, features: DataFrame, keys: list[str], tie: str = "peers") -> DataFrame:
    """Give every record the window values of its (keys, instant).

    There are about as many features as records, and their size is guessed too low for a broadcast to be safe.
    """
    on = keys + ["ts_us"] + (["seq"] if tie == "arrival" else [])
    return rows.join(features.hint("merge"), on, "left")


def window_lookup(rows: DataFrame, key: Column, value, at_us: int, seconds: int) -> DataFrame:
    """The records of one key inside [at - W, at]; a pushed-down point lookup."""
    return rows.filter(
        (key == value) & F.col("ts_us").between(at_us - seconds * SECOND, at_us)
    )


def retained(rows: DataFrame, at_us: int, seconds: int) -> DataFrame:
    """What a store of width W still holds at an instant (append + evict)."""
    return rows.filter(F.col("ts_us").between(at_us - seconds * SECOND, at_us))


def naive_window(keys: list[str], seconds: int):
    """The plain RANGE frame; reference form for tests."""
    return Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(-seconds * SECOND, 0)
