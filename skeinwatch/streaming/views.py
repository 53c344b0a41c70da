"""Streaming forms that Spark's own stateful operators express."""

from pyspark.sql import DataFrame, functions as F

from skeinwatch.operators import analytics as an
from skeinwatch.operators.detectors import detect_one, dns, dns_lexical, malware, signature_match


def throughput(records: DataFrame, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """Rates per tumbling window."""
    return an.throughput_series(records.withWatermark("ts", delay), seconds)


def trends(alerts: DataFrame, bucket_minutes: int = 5, delay: str = "1 minute") -> DataFrame:
    """Alerts per class and bucket."""
    return (
        alerts.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", f"{bucket_minutes} minutes"), "threat_class")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("window.start").alias("bucket_us"), "threat_class", "n")
    )


def incidents(alerts: DataFrame, gap_seconds: int = 300, delay: str = "1 minute") -> DataFrame:
    """Sessions of alerts per source; stamps exactly one gap apart still belong together."""
    return (
        alerts.withWatermark("timestamp", delay)
        .groupBy("source_ip", F.session_window("timestamp", f"{gap_seconds} seconds").alias("w"))
        .agg(
            F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"),
            F.array_sort(F.collect_set("threat_class")).alias("threat_classes"),
            F.count(F.lit(1)).alias("alert_count"),
        )
        .drop("w")
    )


def dedup(alerts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return alerts.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["alert_id"])


def dns_findings(records: DataFrame, th=None) -> DataFrame:
    """The DNS detector needs no history."""
    return detect_one(records.select("*", *dns_lexical()), dns, th)


def malware_findings(records: DataFrame, th=None, signatures=None) -> DataFrame:
    return detect_one(signature_match(records, signatures), malware, th)


def enrich_by_uid(conn: DataFrame, side: DataFrame, value: str, delay: str = "1 minute", within: str = "5 minutes") -> DataFrame:
    """Connections joined with one side log by session inside a time range, missing values filled.

    A session seen twice in the side log within the range would repeat its connection, so the
    side is reduced to one record per session first.
    """
    right = (
        side.filter("uid IS NOT NULL AND uid <> ''")
        .select(F.col("uid").alias("_uid"), F.col("ts").alias("_ts"), F.col(value).alias("_value"))
        .withWatermark("_ts", delay)
        .dropDuplicatesWithinWatermark(["_uid"])
    )
    left = conn.withWatermark("ts", delay)
    hit = F.expr(
        f"uid = _uid AND _ts BETWEEN ts - INTERVAL {within} AND ts + INTERVAL {within}"
    )
    filled = F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_value"))
    return left.join(right, hit, "leftOuter").withColumn(value, filled).drop("_uid", "_ts", "_value")
