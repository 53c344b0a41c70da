"""Captures or logs through a pipeline of their own, tagged as replay."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinwatch.operators.packets import flows_from_packets
from skeinwatch.plans.pipeline import alert_pipeline
from skeinwatch.sources.captures import capture_files, scan_captures
from skeinwatch.sources.logs import correlated_records, scan_logs


def replay_captures(spark: SparkSession, directory: str, **options) -> DataFrame:
    """Alerts of all captures in a folder, read as one recording."""
    flows = flows_from_packets(scan_captures(capture_files(spark, directory)), source="replay")
    return alert_pipeline(flows.drop("file"), **options)


def replay_logs(spark: SparkSession, conn: str, dns: str | None = None, ssl: str | None = None, **options) -> DataFrame:
    """Alerts of recorded logs; the join by session makes the reading order irrelevant."""
    empty = scan_logs(spark, "conn", conn).limit(0)
    parts = {
        "conn": scan_logs(spark, "conn", conn),
        "dns": scan_logs(spark, "dns", dns) if dns else empty,
        "ssl": scan_logs(spark, "ssl", ssl) if ssl else empty,
    }
    records = correlated_records(**parts).withColumn("source", F.lit("replay"))
    return alert_pipeline(records, **options)
