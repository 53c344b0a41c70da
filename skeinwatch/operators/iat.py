"""Inter-arrival statistics of each flow over [t-W, t], from prefix sums.

Of the records in a window, in order of time, the gaps, their squares and the products of
neighbouring gaps are added up as exact integers: each sum is a difference of two prefix sums
(`chunks`), and no list of stamps is ever built. The entropy of the stamps by tenths of a second
adds c log c over the tenths; the first tenth of a window may be cut and is counted by itself. Logarithms are
kept in units of 2^-36, so these sums are exact too.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from skeinwatch.functions.scalars import flow_ratio, rnd, rnd_small
from skeinwatch.operators.chunks import fold_windows, long_field, longs, narrow, prefix, window_sum
from skeinwatch.operators.windows import SECOND

W300 = 300
FEATURES = [
    "f300_count", "f300_bytes_out", "f300_bytes_in", "f300_byte_ratio", "f300_first_us",
    "iat_mean", "iat_variance", "iat_stddev", "iat_autocorr", "iat_concentration",
    "stamp_entropy",
]


_UNIT = float(1 << 36)


def _clog(c: np.ndarray) -> np.ndarray:
    return np.rint(c * np.log2(np.maximum(c, 1)) * _UNIT).astype(np.int64)


def _statistics(block, frame, at):
    t, first, last = frame.t, frame.first[at], frame.last[at]
    opens = np.concatenate([[True], frame.group[1:] != frame.group[:-1]])
    gap = np.where(opens, 0, np.diff(t, prepend=t[:1]))
    squares, products = prefix(gap * gap), prefix(gap * np.concatenate([[0], gap[:-1]]))
    second = np.minimum(first + 1, last)
    third = np.minimum(first + 2, last + 1)
    several = last > first
    # rank of a record in its tenth, and the last record of the tenth
    tenth = (t + 50000) // 100000
    begins = np.flatnonzero(opens | np.concatenate([[True], tenth[1:] != tenth[:-1]]))
    ends = np.append(begins[1:], len(t)) - 1
    run = np.searchsorted(begins, np.arange(len(t)), side="right") - 1
    rank = np.arange(len(t)) - begins[run] + 1
    logs = prefix(_clog(rank) - _clog(rank - 1))
    cut = np.minimum(ends[run[first]], last)
    ent = _clog(cut - first + 1) + logs[last + 1] - logs[cut + 1]
    return {
        "n": pa.array(last - first + 1),
        "bo": window_sum(block["bo"], frame, at), "bi": window_sum(block["bi"], frame, at),
        "q": pa.array(squares[last + 1] - squares[first + 1]),
        "p": pa.array(products[last + 1] - products[third]),
        "ent": pa.array(ent / _UNIT),
        "opener": pa.array(t[first]),
        "d_first": pa.array(np.where(several, gap[second], 0)), "d_last": pa.array(np.where(several, gap[last], 0)),
    }


def flow_window(
    rows: DataFrame, seconds: int = W300, tie: str = "peers", key: str = "flow_id"
) -> DataFrame:
    """One row per (flow, instant) with FEATURES."""
    stamps = narrow(
        rows, {key: F.col(key)}, tie, F.lit(True),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in (("bytes_out", "bo"), ("bytes_in", "bi"))],
    )
    counts = [long_field(c) for c in ("n", "bo", "bi", "q", "p", "opener", "d_first", "d_last")]
    sums = fold_windows(stamps, [key], seconds * SECOND, _statistics, [*counts, StructField("ent", DoubleType())])
    return _finish(sums, key, tie)


def _finish(sums: DataFrame, key: str, tie: str) -> DataFrame:
    n, gaps_n = F.col("n"), (F.col("n") - 1)
    span = (F.col("_t") - F.col("opener")).cast("double")
    enough = n >= 3
    mean_us = F.try_divide(span, gaps_n.cast("double"))
    var_us = F.greatest(
        F.try_divide(F.col("q").cast("double"), gaps_n.cast("double")) - mean_us * mean_us,
        F.lit(0.0),
    )
    var = F.when(enough, var_us / 1e12).otherwise(0.0)
    s = sums.select("*", span.alias("span"), mean_us.alias("mu"), var.alias("var"))
    mu, var = F.col("mu"), F.col("var")
    num = (
        F.col("p").cast("double")
        - mu * (2 * F.col("span") - F.col("d_first") - F.col("d_last"))
        + (n - 2) * mu * mu
    ) / 1e12
    den = F.greatest(var * gaps_n, F.lit(1e-6))
    autocorr = F.when(var <= 1e-6, F.lit(1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), num / den))
    )
    mean_s = mu / 1e6
    jitter = F.sqrt(var) / F.greatest(mean_s, F.lit(1e-4))
    entropy = F.log2(n.cast("double")) - F.col("ent") / n
    order = [F.col("_o").alias("seq")] if tie == "arrival" else []
    return s.select(
        key, F.col("_t").alias("ts_us"), *order,
        n.alias("f300_count"),
        F.col("bo").alias("f300_bytes_out"),
        F.col("bi").alias("f300_bytes_in"),
        flow_ratio(F.col("bo"), F.col("bi")).alias("f300_byte_ratio"),
        F.col("opener").alias("f300_first_us"),
        F.when(enough, mean_s).otherwise(0.0).alias("iat_mean"),
        rnd_small(var, 6).alias("iat_variance"),
        F.sqrt(var).alias("iat_stddev"),
        F.when(enough, rnd_small(autocorr, 4)).otherwise(0.0).alias("iat_autocorr"),
        F.when(enough, rnd_small(1 - F.least(jitter, F.lit(1.0)), 4)).otherwise(0.0).alias("iat_concentration"),
        F.when(n <= 1, F.lit(0.0)).otherwise(F.abs(rnd_small(entropy, 4))).alias("stamp_entropy"),
    )
