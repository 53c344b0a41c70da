"""Filters and display columns of the alert table."""

from pyspark.sql import Column, DataFrame, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import rnd


def by_class(alerts: DataFrame, threat_class: str) -> DataFrame:
    return alerts.filter(F.col("threat_class") == threat_class)


def by_status(alerts: DataFrame, status: str) -> DataFrame:
    return alerts.filter(F.col("status") == status)


def by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.filter(F.lower("severity") == severity)


def by_confidence(alerts: DataFrame, minimum: float) -> DataFrame:
    return alerts.filter(F.col("confidence_score") >= minimum)


def near(alerts: DataFrame, instant_us: int, tolerance_us: int = 5000000) -> DataFrame:
    return alerts.filter(F.col("ts_us").between(instant_us - tolerance_us, instant_us + tolerance_us))


def search(alerts: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over id, class, details and addresses; blank finds all."""
    needle = text.strip().lower()
    if not needle:
        return alerts
    fields = F.concat_ws(
        "\u0001",
        "flow_id", "threat_class", "evidence.details",
        F.coalesce(F.nullif("source_ip", F.lit("")), "evidence.source_ip"),
        F.coalesce(F.nullif("destination_ip", F.lit("")), "evidence.destination_ip"),
    )
    return alerts.filter(F.lower(fields).contains(needle))


def matches_class(threat_class: Column, selected: str) -> Column:
    """Class equals, contains, or is contained in an alias of the selected class."""
    if not selected or selected == "ALL":
        return F.lit(True)
    target = selected.strip().lower()
    aliases = next((a for c, a in S.CLASS_ALIASES.items() if c.lower() == target), [target])
    name = F.trim(F.lower(F.coalesce(threat_class, F.lit(""))))
    hit = name == target
    for alias in aliases:
        hit = hit | name.contains(alias) | F.lit(alias).contains(name)
    return hit


def by_class_alias(alerts: DataFrame, selected: str) -> DataFrame:
    return alerts.filter(matches_class(F.col("threat_class"), selected))


def short_name(threat_class: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in S.SHORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, threat_class), threat_class)


def evidence_tags(ev: Column) -> Column:
    def text(name):
        return F.coalesce(ev[name] != "", F.lit(False))

    def some(name):
        return ev[name].isNotNull()

    tags = [
        (text("ja3_hash") | text("ja4_hash") | text("sni"), "TLS"),
        (some("splt_packet_sizes") | some("splt_interarrival_times"), "SPLT"),
        (some("fft_concentration"), "FFT"),
        (text("dns_query") | some("ngram_score"), "DNS"),
        (some("z_score"), "Z-SCORE"),
        (some("unique_destination_hosts"), "FAN-OUT"),
        (some("total_uploaded_bytes"), "EGRESS"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in tags]), lambda x: x.isNotNull())


def direction_ratio(ev: Column) -> Column:
    ratio = rnd(ev["outbound_bytes"] / F.greatest(ev["inbound_bytes"], F.lit(1)), 1)
    return F.when(
        ev["inbound_bytes"].isNotNull() & ev["outbound_bytes"].isNotNull(),
        F.format_string("1:%.1f", ratio),
    )


def latency_band(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), "UNAVAILABLE")
        .when(ms <= 10, "WITHIN NORMAL")
        .when(ms <= 100, "ELEVATED")
        .otherwise("DEGRADED")
    )


def validate_alerts(alerts: DataFrame) -> DataFrame:
    """Adds `valid` and `reason`; split on it to quarantine bad rows."""
    ev = F.col("evidence")

    def bad_port(c):
        return c.isNotNull() & ~c.between(0, 65535)

    checks = [
        (F.col("flow_id").isNull(), "flow_id missing"),
        (~F.coalesce(F.col("threat_class").isin(S.THREAT_CLASSES), F.lit(False)), "unknown threat class"),
        (~F.coalesce(F.col("confidence_score").between(0.0, 1.0), F.lit(False)), "confidence out of range"),
        (F.col("severity").isNotNull() & ~F.col("severity").isin(S.SEVERITIES), "unknown severity"),
        (~F.coalesce(F.col("status").isin(S.STATUSES), F.lit(False)), "unknown status"),
        (bad_port(F.col("source_port")) | bad_port(F.col("destination_port")), "port out of range"),
        (
            bad_port(ev["source_port"]) | bad_port(ev["destination_port"]), "port out of range",
        ),
        (F.coalesce(F.col("processing_latency_ms") < 0, F.lit(False)), "negative latency"),
        (ev.isNull() | ev["details"].isNull(), "evidence missing"),
    ]
    not_negative = [
        "inter_arrival_variance", "shannon_entropy", "byte_ratio", "fan_out_count",
        "fft_concentration", "beacon_period_seconds", "inter_arrival_stddev", "ngram_score",
        "packets_per_second", "source_ip_entropy", "unique_source_count", "total_uploaded_bytes",
        "packets_in", "packets_out", "inbound_bytes", "outbound_bytes",
    ]
    for name in not_negative:
        checks.append((F.coalesce(ev[name] < 0, F.lit(False)), f"negative {name}"))
    checks.append((F.coalesce(ev["fft_concentration"] > 1, F.lit(False)), "concentration above 1"))
    checks.append((F.coalesce(ev["detector_count"] < 1, F.lit(False)), "no detector"))
    reason = F.lit(None).cast("string")
    for bad, text in reversed(checks):
        reason = F.when(bad, F.lit(text)).otherwise(reason)
    return alerts.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
