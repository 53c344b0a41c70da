"""Adaptive traffic baseline per target.

An exponentially weighted mean and deviation that only calm values update: what counts as
calm depends on the state so far, so the values of one target form a chain. A target may
hold most of the traffic, so its chain is cut into stretches of time that are folded in
parallel from assumed start states; each round hands the end of a stretch to the next one and
folds those again whose start changed, until none does. Then every stretch started where its
predecessor ended, which is the result of the plain fold. The weight of a start fades as
(1 - alpha)^n; a stretch is therefore as many steps of time as have the values that let it fade,
and two rounds suffice for most targets, long and sparse ones too. There are never more rounds
than stretches.
"""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinwatch.operators.windows import SECOND
from skeinwatch.sources.work import materialize

_STATE = "key string, stretch bigint, m0 double, s0 double, mean double, std double, n bigint"
FADED = 80  # in units of 1 / alpha: e^-80 of a start is left, below what a double keeps


def adaptive_baseline(
    rows: DataFrame, key: Column, pps: Column, mean: float = 50.0, std: float = 30.0,
    alpha: float = 0.02, stretch_seconds: int = 3600,
) -> DataFrame:
    """key, ema_mean, ema_std, n after all values in time order."""
    values = rows.select(
        key.alias("key"), F.floor(F.col("ts_us") / (stretch_seconds * SECOND)).alias("step"),
        "ts_us", "seq", pps.cast("double").alias("pps"),
    )
    before = F.sum("n").over(Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    steps = values.groupBy("key", "step").agg(F.count(F.lit(1)).alias("n"))
    steps = steps.select("key", "step", F.floor(F.coalesce(before, F.lit(0)) / math.ceil(FADED / alpha)).alias("stretch"))
    values = materialize(values.join(steps, ["key", "step"]).drop("step"), "baseline-values")
    first = (F.lit(float(mean)), F.lit(max(float(std), 1.0)))
    starts = values.withColumns({"m0": first[0], "s0": first[1]})
    ends = materialize(_fold(starts, alpha), "baseline")
    order = Window.partitionBy("key").orderBy("stretch")
    while True:
        nexts = ends.select(
            "key", "stretch", "m0", "s0",
            F.coalesce(F.lag("mean").over(order), first[0]).alias("m1"),
            F.coalesce(F.lag("std").over(order), first[1]).alias("s1"),
        )
        moved = nexts.filter("m0 <> m1 OR s0 <> s1").select("key", "stretch", F.col("m1").alias("m0"), F.col("s1").alias("s0"))
        moved = materialize(moved, "baseline-moved")
        if moved.isEmpty():
            break
        again = _fold(values.join(moved, ["key", "stretch"]), alpha)
        ends = materialize(ends.join(moved, ["key", "stretch"], "left_anti").unionByName(again), "baseline")
    return ends.groupBy("key").agg(
        F.max_by("mean", "stretch").alias("ema_mean"), F.max_by("std", "stretch").alias("ema_std"),
        F.sum("n").alias("n"),
    )


def _fold(started: DataFrame, alpha: float) -> DataFrame:
    ordered = started.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "ts_us", "seq")
    names = ["key", "stretch", "m0", "s0", "mean", "std", "n"]

    def run(batches):
        at, m, s, n, start = None, 0.0, 0.0, 0, ()
        for pdf in batches:
            done = []
            for where, part in pdf.groupby(["key", "stretch"], sort=False):
                if where != at:
                    if at is not None:
                        done.append((*at, *start, m, s, n))
                    start = part["m0"].iloc[0], part["s0"].iloc[0]
                    at, m, s, n = where, *start, 0
                n += len(part)
                for x in part["pps"].to_numpy():
                    if x < m * 2.5:
                        d = x - m
                        m += alpha * d
                        s = max(1.0, (s * s * (1 - alpha) + alpha * d * d) ** 0.5)
            if done:
                yield pd.DataFrame(done, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, *start, m, s, n)], columns=names)

    return ordered.mapInPandas(run, _STATE)
