"""The alert archive: Parquet by month, notes, indicator exports."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_RUN = "_archive_run"


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def archive_layout(alerts: DataFrame) -> DataFrame:
    """Rows as archived. Hashing on (month, class, hour) spreads a busy month over many files."""
    return (
        alerts.withColumn("month", month_of(F.col("timestamp")))
        .repartition("month", "threat_class", F.date_trunc("hour", "timestamp"))
        .sortWithinPartitions("threat_class", "timestamp", "flow_id")
    )


def write_archive(alerts: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Writes alerts by month.

    With the name of a `run` its alerts are a part of their own, which a repeated run replaces as a whole: running twice leaves the rows of one run, and
    a run that was ended leaves none, as files count from its commit on. An archive is written with run names throughout or without.
    """
    if run is None:
        archive_layout(alerts).write.partitionBy("month").mode(mode).parquet(path)
        return
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError(f"a run's name is made of letters, digits, _ and -: {run!r}")
    archive_layout(alerts).write.partitionBy("month").mode("overwrite").parquet(f"{path}/{_RUN}={run}")


def read_archive(
    spark: SparkSession, path: str, since=None, until=None, threat_class: str | None = None
) -> DataFrame:
    """Archived alerts; columns added later are null in old files. A time range prunes months."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    df = df.drop(_RUN).withColumn("month", F.col("month").cast("string"))
    if since is not None:
        since = F.lit(since).cast("timestamp")
        df = df.filter((F.col("month") >= month_of(since)) & (F.col("timestamp") >= since))
    if until is not None:
        until = F.lit(until).cast("timestamp")
        df = df.filter((F.col("month") <= month_of(until)) & (F.col("timestamp") <= until))
    if threat_class:
        df = df.filter(F.col("threat_class") == threat_class)
    return df


NOTE = "flow_id string, text string, created_at timestamp"


def write_notes(notes: DataFrame, path: str) -> DataFrame:
    """Append notes of 1 to 10,000 characters; the others come back as refused."""
    fits = F.coalesce(F.length("text").between(1, 10000), F.lit(False))
    notes.filter(fits).write.mode("append").parquet(path)
    return notes.filter(~fits)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTE).parquet(path)


def _indicator_rows(iocs: DataFrame) -> DataFrame:
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return iocs.select("type", "value", "threat_class", stamp.alias("timestamp"))


def export_iocs_csv(iocs: DataFrame, path: str) -> None:
    _indicator_rows(iocs).write.mode("overwrite").option("header", "true").csv(path)


def export_iocs_json(iocs: DataFrame, path: str) -> None:
    _indicator_rows(iocs).write.mode("overwrite").json(path)


def indicator_lines(iocs: DataFrame) -> DataFrame:
    """Indicators as CSV text lines."""
    return _indicator_rows(iocs).select(
        F.to_csv(F.struct("type", "value", "threat_class", "timestamp")).alias("line")
    )
