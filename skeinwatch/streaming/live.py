"""Streams of records to alerts: the batch operators on micro-batches plus recent history.

Each micro-batch is scored together with the records of the last 300 s (and the allowed
delay), kept in Parquet folders by hour; only its own records raise alerts. Open incidents
are carried in a small table. Every output of batch N goes to a folder of its own and is
overwritten when N is retried, and N reads only what earlier batches wrote, so a lost
executor or a restart gives the same tables.

Records later than the delay are dropped. Alerts already issued are not revised.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from skeinwatch.operators.alerts import assemble, correlate_onto, with_latency
from skeinwatch.operators.suppression import deliverable, mark_suppressed
from skeinwatch.operators.thresholds import Thresholds
from skeinwatch.operators.windows import SECOND
from skeinwatch.plans.pipeline import candidate_records

HOUR_US = 3600 * SECOND
LONGEST_WINDOW = 300


@dataclass
class AlertStream:
    """Folders and settings of one running stream.

    rules / thresholds are called once per micro-batch, so changed tables take effect with
    the next batch. `on_batch` receives every batch of records (throughput counters).
    """

    root: str
    delay_seconds: int = 60
    rules: Callable[[SparkSession], DataFrame] | None = None
    thresholds: Callable[[], Thresholds] = Thresholds
    as_of: Callable[[], Column] = F.current_timestamp
    detectors: list | None = None
    tie: str = "peers"
    on_batch: Callable[[DataFrame, int], None] | None = None

    def alerts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/alerts")

    def delivered(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/delivered")

    def start(self, records: DataFrame, trigger: dict | None = None):
        """Attach to a stream of flow records; `trigger` defaults to draining what is there."""
        return (
            records.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    # --- one micro-batch ---------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = self._previous(spark, "progress", batch_id)
        newest = seen.first()["max_us"] if seen is not None else None
        if newest is not None:
            batch = batch.filter(F.col("ts_us") >= newest - self.delay_seconds * SECOND)
        if self.on_batch is not None:
            self.on_batch(batch, batch_id)
        hour = F.floor(F.col("ts_us") / HOUR_US)
        stamps = Observation()
        batch = batch.observe(stamps, F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
        batch.withColumn("hour", hour).withColumn("batch_id", F.lit(batch_id)).write.partitionBy(
            "hour", "batch_id"
        ).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/history")
        span = stamps.get
        if span.get("lo") is None:
            self._keep(spark, batch_id)
            return
        now_max = max(span["hi"], newest or span["hi"])
        self._score(spark, batch_id, span, now_max)
        spark.range(1).select(F.lit(now_max).cast("bigint").alias("max_us")).write.mode("overwrite").parquet(
            self._path("progress", batch_id)
        )

    def _score(self, spark, batch_id, span, now_max):
        th = self.thresholds()
        window = self._history(spark, batch_id, span)
        own = F.col("batch_id") == batch_id
        found = candidate_records(window, th, self.tie, self.detectors, emit=own)
        state = self._previous(spark, "incidents", batch_id)
        correlated, carried = correlate_onto(
            found, state, th.value("correlation.window_seconds"), now_max - self.delay_seconds * SECOND
        )
        rules = self.rules(spark) if self.rules is not None else None
        alerts = mark_suppressed(assemble(correlated), rules, self.as_of())
        alerts = with_latency(alerts, F.current_timestamp())
        path = f"{self.root}/alerts/batch_id={batch_id}"
        alerts.write.mode("overwrite").parquet(path)
        issued = spark.read.schema(alerts.schema).parquet(path)
        deliverable(issued).write.mode("overwrite").parquet(f"{self.root}/delivered/batch_id={batch_id}")
        carried.write.mode("overwrite").parquet(self._path("incidents", batch_id))

    def _history(self, spark, batch_id, span) -> DataFrame:
        """This batch and what earlier batches left inside its windows."""
        since = span["lo"] - LONGEST_WINDOW * SECOND
        hours = range(since // HOUR_US, span["hi"] // HOUR_US + 1)
        folders = f"{self.root}/history/hour={{{','.join(str(h) for h in hours)}}}"
        rows = spark.read.option("basePath", f"{self.root}/history").parquet(folders)
        return rows.filter(
            F.col("ts_us").between(since, span["hi"]) & (F.col("batch_id") <= batch_id)
        ).drop("hour")

    # --- versioned side tables ---------------------------------------------

    def _path(self, name, batch_id):
        return f"{self.root}/{name}/v{batch_id}"

    def _previous(self, spark, name, batch_id) -> DataFrame | None:
        if batch_id == 0:
            return None
        try:
            return spark.read.parquet(self._path(name, batch_id - 1))
        except AnalysisException:
            return None

    def _keep(self, spark, batch_id):
        """An empty batch passes the side tables on."""
        for name in ("progress", "incidents"):
            table = self._previous(spark, name, batch_id)
            if table is not None:
                table.write.mode("overwrite").parquet(self._path(name, batch_id))
