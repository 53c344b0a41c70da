"""Flow records in, scored alerts out."""

from pyspark.sql import Column, DataFrame, functions as F

from skeinwatch.operators.alerts import assemble, class_mask, correlate
from skeinwatch.operators.detectors import detect, with_features
from skeinwatch.operators.suppression import mark_suppressed
from skeinwatch.operators.thresholds import Thresholds
from skeinwatch.sources.work import materialize


# what alert assembly reads of a record
RECORD_COLUMNS = [
    "seq", "ts_us", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
    "bytes_out", "bytes_in", "packets_out", "packets_in", "dns_query", "dns_query_type",
    "ja4_hash", "sni", "splt_packet_sizes", "splt_interarrival_times", "source",
]


def candidate_records(
    flows: DataFrame, th=None, tie: str = "peers", detectors=None, emit: Column | None = None
) -> DataFrame:
    """Records on which a detector fires, with `candidates` and their class `mask`.

    Written once to the shared work folder: this is a small part of the traffic, everything
    after it works on that part only and reads it more than once.
    """
    th = th or Thresholds()
    found = detect(with_features(flows, th, tie, emit), th, detectors).select(*RECORD_COLUMNS, "candidates")
    return materialize(found.withColumn("mask", class_mask(F.col("candidates"))), "candidates")


def alerts_from_candidates(found: DataFrame, th=None) -> DataFrame:
    th = th or Thresholds()
    return assemble(correlate(found, th.value("correlation.window_seconds")))


def alert_pipeline(
    flows: DataFrame,
    th: Thresholds | None = None,
    rules: DataFrame | None = None,
    as_of: Column | None = None,
    tie: str = "peers",
    detectors=None,
) -> DataFrame:
    """All alerts of a set of flow records, suppressed ones included and marked.

    The records are written once to the shared work folder: each group of features reads the few columns it
    needs from there, and logs or captures are read, parsed and joined a single time.
    """
    th = th or Thresholds()
    records = materialize(flows, "records")
    alerts = alerts_from_candidates(candidate_records(records, th, tie, detectors), th)
    return mark_suppressed(alerts, rules, as_of if as_of is not None else F.current_timestamp())
