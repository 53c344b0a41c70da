"""From candidates to alerts: corroboration, incidents, attack chains, evidence, identity."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import rnd, rnd_small, severity
from skeinwatch.operators.windows import SECOND, bucket_of

BIT = {name: 1 << i for i, name in enumerate(S.THREAT_CLASSES)}


def class_mask(candidates: Column) -> Column:
    """One bit per threat class present in an array of candidates."""
    bits = F.create_map(*[F.lit(x) for pair in BIT.items() for x in pair])
    return F.aggregate(
        candidates, F.lit(0),
        lambda acc, c: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, c["threat_class"]), F.lit(0))),
    )


def incident_id(src_ip: Column, start_us: Column) -> Column:
    return F.when(
        src_ip.isNotNull(), F.sha2(F.concat_ws("|", src_ip, start_us.cast("string")), 256)
    )


_FIRSTS = [f"_first{bit}" for bit in BIT.values()]
STATE_COLUMNS = ["_src", "_b", "_lo", "_hi", *_FIRSTS]


def _keyed(rows: DataFrame, width: int) -> DataFrame:
    src = F.coalesce(F.nullif(F.col("src_ip"), F.lit("")), F.lit(""))
    return rows.withColumn("_src", src).withColumn("_b", bucket_of(F.col("ts_us"), width))


def _here() -> Column:
    return F.struct(F.col("ts_us").alias("t"), F.col("seq").alias("s"))


def _summaries(keyed: DataFrame) -> DataFrame:
    """Per (source, bucket): first and last stamp, first sighting of every class."""
    return keyed.groupBy("_src", "_b").agg(
        F.min("ts_us").alias("_lo"),
        F.max("ts_us").alias("_hi"),
        *[
            F.min(F.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, _here())).alias(name)
            for name, bit in zip(_FIRSTS, BIT.values())
        ],
    )


def _islands(summary: DataFrame, width: int) -> DataFrame:
    """Summaries with the extent and first sightings of their incident."""
    by_time = Window.partitionBy("_src").orderBy("_b")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_time) > width, F.lit(True))
    # records without a source share one stage set and no incident
    summary = summary.withColumn("_opens", (opens & (F.col("_src") != "")).cast("int"))
    summary = summary.withColumn("_island", F.sum("_opens").over(by_time))
    island = Window.partitionBy("_src", "_island")
    return summary.select(
        "_src", "_b", "_island",
        F.min("_lo").over(island).alias("_start"),
        F.max("_hi").over(island).alias("_end"),
        *[F.min(name).over(island).alias(name) for name in _FIRSTS],
    )


def _apply_islands(keyed: DataFrame, islands: DataFrame) -> DataFrame:
    mask = F.lit(0)
    for name, bit in zip(_FIRSTS, BIT.values()):
        mask = mask + F.when(F.col(name) <= _here(), F.lit(bit)).otherwise(0)
    return (
        keyed.join(islands, ["_src", "_b"])
        .withColumn("incident_id", incident_id(F.nullif(F.col("src_ip"), F.lit("")), F.col("_start")))
        .withColumn("stage_mask", mask)
        .drop("_src", "_b", "_island", "_start", "_end", *_FIRSTS)
    )


def correlate(rows: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Adds incident_id and stage_mask (classes seen in the incident up to this record).

    rows: seq, ts_us, src_ip, mask. Records of one source that fall into one bucket of the
    correlation window always belong together, so each (source, bucket) is first reduced to
    its first and last stamp and the first sighting of every class; only these summaries are
    ordered per source. A source that raises a third of all alerts is a few summaries per
    window of time, and the join back splits on (source, bucket).
    """
    width = window_seconds * SECOND
    keyed = _keyed(rows, width)
    return _apply_islands(keyed, _islands(_summaries(keyed), width))


def correlate_onto(
    rows: DataFrame, state: DataFrame | None, window_seconds: int, horizon_us: int
) -> tuple[DataFrame, DataFrame]:
    """`correlate` for one micro-batch: open incidents come in and go out as `state`.

    An incident that has not ended before the horizon is carried as a single summary.
    """
    width = window_seconds * SECOND
    keyed = _keyed(rows, width)
    summary = _summaries(keyed)
    if state is not None:
        summary = summary.unionByName(state).groupBy("_src", "_b").agg(
            F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.min(f).alias(f) for f in _FIRSTS]
        )
    islands = _islands(summary, width)
    carried = (
        islands.groupBy("_src", "_island")
        .agg(
            F.min("_start").alias("_lo"), F.max("_end").alias("_hi"),
            *[F.min(f).alias(f) for f in _FIRSTS],
        )
        .filter(F.col("_hi") >= horizon_us - width)
        .withColumn("_b", bucket_of(F.col("_hi"), width))
        .select(*STATE_COLUMNS)
    )
    return _apply_islands(keyed, islands), carried


def stage_names(mask: Column) -> Column:
    present = F.array(
        *[F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in sorted(BIT.items())]
    )
    return F.filter(present, lambda x: x.isNotNull())


def corroboration_bonus(n: Column) -> Column:
    return F.when(n > 1, 0.03).otherwise(0.0)


def chain_bonus(stages: Column) -> Column:
    return F.when(stages >= 3, 0.05).when(stages == 2, 0.02).otherwise(0.0)


def final_confidence(score: Column) -> Column:
    return rnd_small(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2)


def alert_id(flow_id: Column, ts_us: Column, seq: Column, threat_class: Column) -> Column:
    return F.sha2(
        F.concat_ws("|", flow_id, ts_us.cast("string"), seq.cast("string"), threat_class), 256
    )


def alert_identity(alert_id_: Column, flow_id: Column, ts: Column, threat_class: Column) -> Column:
    """The id, or flow, time and class for rows written before ids existed."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.coalesce(alert_id_, F.concat_ws("|", flow_id, stamp, threat_class))


def evidence(c: Column, details: Column, basis: Column, fired: Column) -> Column:
    """Candidate values, clamped and rounded, overlaid with the record's own fields."""
    zero = F.lit(0.0)
    query = F.nullif(F.col("dns_query"), F.lit(""))
    fields = {
        "inter_arrival_variance": rnd_small(F.greatest(zero, c["inter_arrival_variance"]), 6),
        "shannon_entropy": rnd_small(F.greatest(zero, c["shannon_entropy"]), 4),
        "byte_ratio": rnd(F.greatest(zero, c["byte_ratio"]), 4),
        "fan_out_count": F.greatest(F.lit(0).cast("bigint"), c["fan_out_count"]),
        "ja3_hash": c["ja3_hash"],
        "ja4_hash": F.col("ja4_hash"),
        "sni": F.col("sni"),
        "splt_packet_sizes": F.col("splt_packet_sizes"),
        "splt_interarrival_times": F.col("splt_interarrival_times"),
        "fft_concentration": c["fft_concentration"],
        "beacon_period_seconds": c["beacon_period_seconds"],
        "inter_arrival_stddev": c["inter_arrival_stddev"],
        "dns_query": F.col("dns_query"),
        "dns_query_length": F.length(query),
        "dns_query_type": F.col("dns_query_type"),
        "ngram_score": c["ngram_score"],
        "packets_per_second": c["packets_per_second"],
        "z_score": c["z_score"],
        "source_ip_entropy": c["source_ip_entropy"],
        "unique_destination_hosts": c["unique_destination_hosts"],
        "unique_destination_ports": c["unique_destination_ports"],
        "window_10s_fan_out": c["window_10s_fan_out"],
        "window_60s_fan_out": c["window_60s_fan_out"],
        "unique_source_count": c["unique_source_count"],
        "total_uploaded_bytes": c["total_uploaded_bytes"],
        "detectors_fired": fired,
        "detector_count": F.size(fired),
        "confidence_basis": basis,
        "details": details,
        "packets_in": F.col("packets_in"),
        "packets_out": F.col("packets_out"),
        "inbound_connections": c["inbound_connections"],
        "outbound_connections": c["outbound_connections"],
        "port_connections": c["port_connections"],
        "inbound_bytes": F.col("bytes_in"),
        "outbound_bytes": F.col("bytes_out"),
        "source_ip": F.col("src_ip"),
        "source_port": F.col("src_port"),
        "destination_ip": F.col("dst_ip"),
        "destination_port": F.col("dst_port"),
        "protocol": F.col("protocol"),
        "observation_window_seconds": c["observation_window_seconds"],
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def assemble(correlated: DataFrame) -> DataFrame:
    """One alert per candidate of a correlated record."""
    fired = F.transform("candidates", lambda c: c["threat_class"])
    n, stages = F.size("candidates"), F.bit_count("stage_mask")
    ready = correlated.select(
        "*",
        fired.alias("fired"),
        corroboration_bonus(n).alias("corroboration"),
        chain_bonus(stages).alias("chain"),
        F.when(stages > 1, F.array_join(stage_names(F.col("stage_mask")), " -> ")).alias("chain_text"),
        F.format_string(
            "%d detectors corroborated (+%.2f); Attack chain stages: %d (+%.2f)",
            n, corroboration_bonus(n), stages, chain_bonus(stages),
        ).alias("basis"),
    ).withColumn("c", F.explode("candidates"))
    c = F.col("c")
    details = F.when(
        F.col("chain_text").isNotNull(),
        F.concat(F.lit("[Attack Chain: "), F.col("chain_text"), F.lit("] "), c["details"]),
    ).otherwise(c["details"])
    score = final_confidence(c["confidence"] + F.col("corroboration") + F.col("chain"))
    scored = ready.withColumn("confidence_score", score)
    return scored.select(
        "seq", "ts_us",
        F.timestamp_micros("ts_us").alias("timestamp"),
        alert_id(F.col("flow_id"), F.col("ts_us"), F.col("seq"), c["threat_class"]).alias("alert_id"),
        "flow_id",
        F.col("src_ip").alias("source_ip"), F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"), F.col("dst_port").alias("destination_port"),
        "protocol",
        c["threat_class"].alias("threat_class"),
        "confidence_score",
        severity(F.col("confidence_score")).alias("severity"),
        F.lit("new").alias("status"),
        "incident_id",
        F.lit(False).alias("suppressed"),
        F.lit(None).cast("string").alias("suppression_rule_id"),
        F.coalesce("source", F.lit("live")).alias("source"),
        F.lit(None).cast("double").alias("ingest_latency_ms"),
        F.lit(None).cast("double").alias("processing_latency_ms"),
        evidence(c, details, F.col("basis"), F.col("fired")).alias("evidence"),
    )


def calibrate_missing(alerts: DataFrame) -> DataFrame:
    """Fill a missing severity from the score; keep one that was stored."""
    return alerts.withColumn("severity", F.coalesce("severity", severity(F.col("confidence_score"))))


def with_latency(alerts: DataFrame, processed_at: Column) -> DataFrame:
    """Event time to processing time in milliseconds, not below zero."""
    late = (F.unix_micros(processed_at) - F.col("ts_us")) / 1000.0
    return alerts.withColumn("processing_latency_ms", F.greatest(F.lit(0.0), rnd(late, 3)))


def dedup(alerts: DataFrame, identity: Column | None = None) -> DataFrame:
    """One row per identity: the newest. A grouped aggregate, so repeats merge map-side."""
    key = identity if identity is not None else F.col("alert_id")
    columns = alerts.columns
    newest = F.max_by(F.struct(*columns), F.struct("ts_us", "seq"))
    return alerts.groupBy(key.alias("_identity")).agg(newest.alias("_a")).select("_a.*")


def newest(alerts: DataFrame, n: int = 200) -> DataFrame:
    """The live buffer: the n newest alerts."""
    return alerts.orderBy(F.desc("ts_us"), F.desc("seq"), "threat_class").limit(n)


def merge_live_archive(live: DataFrame, archive: DataFrame, n: int = 200) -> DataFrame:
    """Live rows, then archived rows not among them, cut to n."""
    missing = archive.join(live.select("alert_id"), "alert_id", "left_anti")
    both = live.withColumn("_origin", F.lit(0)).unionByName(missing.withColumn("_origin", F.lit(1)))
    return (
        both.orderBy("_origin", F.desc("ts_us"), F.desc("seq"), "threat_class").limit(n).drop("_origin")
    )
