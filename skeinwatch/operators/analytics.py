"""Analyst queries over flows and alerts."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import rnd
from skeinwatch.operators.prefix import before_slices
from skeinwatch.operators.windows import SECOND

_DAY_US = 86400 * SECOND


def recent_alerts(alerts: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, with a stable tie-break."""
    return alerts.orderBy(F.desc("ts_us"), "alert_id").offset(offset).limit(n)


def archive_page(alerts: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """One page; `has_next` comes from fetching one row more than the page shows."""
    fetched = recent_alerts(alerts, size + 1, page * size).withColumn(
        "_rn", F.row_number().over(Window.orderBy(F.desc("ts_us"), "alert_id"))
    )
    return (
        fetched.withColumn("has_next", F.max("_rn").over(Window.partitionBy()) > size)
        .filter(F.col("_rn") <= size)
        .drop("_rn")
    )


def _capped(alerts: DataFrame, max_alerts: int | None) -> DataFrame:
    return alerts if max_alerts is None else recent_alerts(alerts, max_alerts)


def trends(
    alerts: DataFrame,
    as_of_us: int,
    window_minutes: int = 60,
    bucket_minutes: int = 5,
    max_alerts: int | None = None,
) -> DataFrame:
    """Alerts per class in aligned buckets, empty buckets included: window/bucket + 1 points."""
    width = bucket_minutes * 60 * SECOND
    start = (as_of_us - window_minutes * 60 * SECOND) // width * width
    return _bucket_counts(_capped(alerts, max_alerts), width, start, window_minutes // bucket_minutes + 1)


def sliding_trend(alerts: DataFrame, as_of_us: int, window_minutes: int = 5) -> DataFrame:
    """Alerts per class in 30 or 60 slices that end at as_of (slices are not aligned)."""
    points = 30 if window_minutes <= 1 else 60
    span = window_minutes * 60 * SECOND
    kept = alerts.filter(F.col("ts_us").between(as_of_us - span, as_of_us))
    return _bucket_counts(kept, span // points, as_of_us - span, points)


def _bucket_counts(alerts, width, start, points):
    counted = (
        alerts.filter(F.col("ts_us") >= start)
        .groupBy(F.floor((F.col("ts_us") - start) / width).alias("point"))
        .pivot("threat_class", S.THREAT_CLASSES)
        .count()
    )
    grid = alerts.sparkSession.range(points).withColumnRenamed("id", "point")
    return grid.join(counted, "point", "left").select(
        (F.col("point") * width + start).alias("bucket_us"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("bigint")).alias(c) for c in S.THREAT_CLASSES],
    )


def incidents(alerts: DataFrame, limit: int | None = None, with_alerts: bool = False) -> DataFrame:
    """One row per incident, newest first. Alert lists are optional, as they grow with the attack."""
    extra = []
    if with_alerts:
        item = F.struct("ts_us", "alert_id", "flow_id", "threat_class", "confidence_score", "severity")
        extra = [F.sort_array(F.collect_list(item), asc=False).alias("alerts")]
    out = (
        alerts.filter("incident_id IS NOT NULL")
        .groupBy("incident_id")
        .agg(
            F.min(F.coalesce("source_ip", "evidence.source_ip")).alias("source_ip"),
            F.min("ts_us").alias("first_seen_us"),
            F.max("ts_us").alias("last_seen_us"),
            F.array_sort(F.collect_set("threat_class")).alias("threat_classes"),
            F.count(F.lit(1)).alias("alert_count"),
            *extra,
        )
    )
    if limit is None:
        return out
    return out.orderBy(F.desc("last_seen_us"), "incident_id").limit(limit)


def iocs(
    alerts: DataFrame,
    since_us: Column | None = None,
    distinct: bool = False,
    max_alerts: int | None = None,
) -> DataFrame:
    """Indicators: source addresses, generated domains, malware fingerprints."""
    rows = _capped(alerts, max_alerts)
    if since_us is not None:
        rows = rows.filter(F.col("ts_us") >= since_us)
    cls, ev = F.col("threat_class"), F.col("evidence")

    def item(kind, value, applies=F.lit(True)):
        return F.when(
            applies & value.isNotNull() & (value != ""),
            F.struct(F.lit(kind).alias("type"), value.alias("value")),
        )

    found = F.array(
        item("source_ip", F.coalesce(F.col("source_ip"), ev["source_ip"])),
        item("dns_domain", ev["dns_query"], cls == S.DGA),
        item("ja3", ev["ja3_hash"], cls == S.MALWARE),
        item("ja4", ev["ja4_hash"], cls == S.MALWARE),
    )
    out = rows.select(
        "threat_class", "ts_us", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")
    ).select("i.type", "i.value", "threat_class", "ts_us")
    if not distinct:
        return out
    return out.groupBy("type", "value", "threat_class").agg(F.max("ts_us").alias("ts_us"))


def _traffic() -> tuple[Column, Column]:
    out = F.coalesce(F.nullif("packets_out", F.lit(0)), F.lit(1).cast("bigint"))
    packets = out + F.coalesce("packets_in", F.lit(0).cast("bigint"))
    size = F.coalesce("bytes_out", F.lit(0).cast("bigint")) + F.coalesce("bytes_in", F.lit(0).cast("bigint"))
    return packets, size


def _rates(df: DataFrame, elapsed: Column, keep: list[str]) -> DataFrame:
    per = {
        "flows_per_sec": rnd(F.col("total_flows") / elapsed, 2),
        "packets_per_sec": rnd(F.col("total_packets") / elapsed, 2),
        "bytes_per_sec": rnd(F.col("total_bytes") / elapsed, 2),
    }
    return df.select(
        *keep, "total_flows", "total_packets", "total_bytes",
        *[v.alias(k) for k, v in per.items()],
        rnd(per["bytes_per_sec"] * 8 / 1000000, 3).alias("megabits_per_sec"),
    )


def throughput(flows: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """Totals and per-second rates over a set of flows."""
    packets, size = _traffic()
    totals = flows.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.coalesce(F.sum(packets), F.lit(0)).alias("total_packets"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        ((F.max("ts_us") - F.min("ts_us")) / SECOND).alias("_span"),
    )
    given = F.lit(elapsed_seconds).cast("double") if elapsed_seconds is not None else F.col("_span")
    totals = totals.withColumn(
        "elapsed_seconds", rnd(F.greatest(F.coalesce(given, F.lit(1.0)), F.lit(1.0)), 1)
    )
    span = F.greatest(F.coalesce(given, F.lit(1.0)), F.lit(1.0))
    return _rates(totals, span, ["elapsed_seconds"])


def throughput_series(flows: DataFrame, seconds: int = 60) -> DataFrame:
    """Rates per tumbling window; works on batch and streaming frames."""
    packets, size = _traffic()
    totals = flows.groupBy(F.window("ts", f"{seconds} seconds")).agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum(packets).alias("total_packets"),
        F.sum(size).alias("total_bytes"),
    )
    totals = totals.withColumn("bucket_us", F.unix_micros("window.start"))
    return _rates(totals, F.lit(float(seconds)), ["bucket_us"])


def running_peak(series: DataFrame) -> DataFrame:
    """Highest rate so far; one row per bucket, already reduced by the time windows. Days are scanned, one row each, then buckets within a day."""
    daily = series.withColumn("_day", F.floor(F.col("bucket_us") / _DAY_US))
    before = before_slices(daily, [], "_day", {"_before": F.max("megabits_per_sec")}, F.max)
    so_far = Window.partitionBy("_day").orderBy("bucket_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.greatest(F.max("megabits_per_sec").over(so_far), "_before")
    return daily.join(before, "_day").select(*series.columns, peak.alias("peak_megabits_per_sec"))


def downsample(series: DataFrame, limit: int = 140) -> DataFrame:
    """Every k-th bucket and the last one. A bucket's number is its number within its day and the count of the days before."""
    daily = series.withColumn("_day", F.floor(F.col("bucket_us") / _DAY_US))
    days, every = daily.groupBy("_day").agg(F.count(F.lit(1)).alias("_c")), Window.partitionBy(F.lit(0))
    earlier = F.sum("_c").over(every.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("_day", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_c").over(every).alias("_n"))
    at = F.row_number().over(Window.partitionBy("_day").orderBy("bucket_us")) - 1 + F.col("_before")
    numbered = daily.join(days, "_day").withColumn("_i", at)
    step = F.greatest(F.ceil(F.col("_n") / limit), F.lit(1))
    keep = (F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)
    return numbered.filter((F.col("_n") <= limit) | keep).select(*series.columns)


def class_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("threat_class").agg(F.count(F.lit(1)).alias("n"))


def top_vector(alerts: DataFrame) -> DataFrame:
    return class_counts(alerts).orderBy(F.desc("n"), "threat_class").limit(1)


def kpis(alerts: DataFrame) -> DataFrame:
    """Critical and high counts, mean confidence in percent, most frequent class: one pass."""
    per_class = alerts.groupBy("threat_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "critical").alias("c"),
        F.count_if(F.col("severity") == "high").alias("h"),
        F.sum(F.col("confidence_score").cast("decimal(18,2)")).alias("s"),
    )
    top = F.max_by("threat_class", F.struct(F.col("n"), _reverse_rank()))
    return per_class.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("critical_count"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("high_count"),
        F.coalesce(
            rnd(F.sum("s").cast("double") / F.sum("n") * 100, 4), F.lit(0.0)
        ).alias("avg_confidence_pct"),
        F.coalesce(top, F.lit("None Detected")).alias("top_vector"),
    )


def _reverse_rank() -> Column:
    ranks = {c: -i for i, c in enumerate(sorted(S.THREAT_CLASSES))}
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("threat_class")), F.lit(-99))


def severity_histogram(alerts: DataFrame) -> DataFrame:
    """Alerts per severity with share; `dominant` marks the largest band."""
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # at most four rows reach this window
    return counts.select(
        "severity", "n",
        rnd(F.col("n") / F.sum("n").over(every), 4).alias("share"),
        (F.col("n") == F.max("n").over(every)).alias("dominant"),
    )


def alert_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"))


def detector_counts(candidates: DataFrame) -> DataFrame:
    """How many detectors agree on a record, and which."""
    fired = F.array_join(F.array_sort(F.transform("candidates", lambda c: c["threat_class"])), ",")
    return candidates.select(fired.alias("detectors_fired"), F.size("candidates").alias("detector_count")).groupBy(
        "detectors_fired", "detector_count"
    ).agg(F.count(F.lit(1)).alias("records"))
