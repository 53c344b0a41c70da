"""The six detectors over a record and its window features.

A detector is a function `(th) -> Finding`: helper columns in layers (each layer may use the
one before, so nothing is computed twice), a condition used to drop the silent bulk of the
traffic early, and a struct of schema CANDIDATE that is null when the detector stays silent.
`th` resolves thresholds. `DETECTORS` is the default registry; any list of such functions
can replace it.
"""

from functools import reduce
from inspect import signature
from itertools import count, zip_longest
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import (
    endpoint, first_label, flow_ratio, ngram_uniqueness, rnd, rnd_small, shannon_entropy,
    target_key, z_score,
)
from skeinwatch.operators.iat import flow_window
from skeinwatch.operators.thresholds import Thresholds
from skeinwatch.operators.windows import attach, sliding_features

col = F.col


class Finding(NamedTuple):
    fires: Column
    candidate: Column
    layers: list[dict[str, Column]] = []


def candidate(
    fires: Column, threat_class: str, confidence: Column, details: Column,
    layers: list[dict[str, Column]] | None = None, **fields,
) -> Finding:
    """Uniform candidate struct; unnamed fields are 0 or null as the evidence contract says."""
    values = {
        "inter_arrival_variance": F.lit(0.0), "shannon_entropy": F.lit(0.0),
        "byte_ratio": F.lit(0.0), "fan_out_count": F.lit(1),
    }
    values.update(
        fields, threat_class=F.lit(threat_class), confidence=rnd_small(confidence, 4), details=details
    )
    struct = F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CANDIDATE.fields]
    )
    return Finding(F.coalesce(fires, F.lit(False)), F.when(fires, struct), layers or [])


def _count(name: str) -> Column:
    return F.coalesce(col(name), F.lit(0).cast("bigint"))


def _packets(name: str, default: int) -> Column:
    return F.coalesce(col(name), F.lit(default).cast("bigint"))


def _bytes_ok() -> Column:
    """A negative byte count silences a detector, as it has no ratio."""
    return (_count("bytes_out") >= 0) & (_count("bytes_in") >= 0)


def has_flag(name: str) -> Column:
    return F.coalesce(F.array_contains("flags", name), F.lit(False))


def _record_ratio() -> tuple[Column, dict[str, Column]]:
    """Byte ratio of the record itself, one column shared by the detectors that report it."""
    return col("_ratio"), {"_ratio": flow_ratio(_count("bytes_out"), _count("bytes_in"))}


def ddos(th, name: str = "_dd", window: str = "t10") -> Finding:
    pin, pout = _packets("packets_in", 0), _packets("packets_out", 0)
    win_pps = rnd_small(_count(f"{window}_count") / 10, 2)
    is_syn = has_flag("SYN") & ~has_flag("ACK")
    sigma = th("ddos.sigma_threshold")
    pps, syn, syn_count, z, syn_ratio, strong, flood, udp = (
        col(f"{name}_{x}") for x in ("pps", "syn", "syn_count", "z", "syn_ratio", "strong", "flood", "udp")
    )
    ratio, shared = _record_ratio()
    layers = [
        {
            **shared,
            f"{name}_pps": F.greatest(pin.cast("double"), pout.cast("double"), win_pps),
            f"{name}_syn": is_syn,
            f"{name}_syn_count": _count(f"{window}_syn") + is_syn.cast("bigint"),
        },
        {
            f"{name}_z": z_score(pps, th("ddos.baseline_pps_mean"), th("ddos.baseline_pps_std")),
            f"{name}_syn_ratio": F.when(
                syn, syn_count / F.greatest(_count(f"{window}_count"), F.lit(1))
            ).otherwise(0.0),
            f"{name}_strong": pps >= th("ddos.min_surge_pps"),
        },
        {
            f"{name}_flood": (syn & (pin >= th("ddos.syn_packet_burst")))
            | ((syn_ratio >= th("ddos.syn_ratio_threshold")) & strong),
            f"{name}_udp": (col("protocol") == "UDP") & (pps >= th("ddos.min_udp_pps")) & (z >= sigma),
        },
    ]
    conf = F.least(F.lit(0.99), 0.75 + F.least(F.lit(0.24), (z - 3.0) * 0.03))
    sources = F.coalesce(col(f"{window}_sources"), F.lit(1).cast("bigint"))
    label = (
        F.when(flood & (sources > 1), "Distributed SYN Flood")
        .when(flood, "SYN Flood / DoS")
        .when(udp, "UDP Storm")
        .otherwise("Volumetric PPS Surge")
    )
    details = F.format_string(
        "%s detected targeting %s: %.1f PPS from %d source(s) (Z-score=%.2f > %.1fσ, SYN ratio=%.2f).",
        label, col("dst_ip"), rnd(pps, 1), sources, rnd(z, 2), rnd(sigma, 1), rnd(syn_ratio, 2),
    )
    return candidate(
        (pin > pout) & (((z >= sigma) & strong) | flood | udp) & _bytes_ok(), S.DDOS,
        F.when(flood, F.greatest(conf, F.lit(0.92))).otherwise(conf), details, layers,
        byte_ratio=ratio, inbound_connections=syn_count, outbound_connections=pout,
        observation_window_seconds=F.lit(10), packets_per_second=pps, z_score=z,
        source_ip_entropy=col("source_ip_entropy"), unique_source_count=sources,
    )


def beacon(th) -> Finding:
    n, period = _count("f300_count"), F.coalesce("iat_mean", F.lit(0.0))
    var = F.coalesce("iat_variance", F.lit(0.0))
    conc, auto = F.coalesce("iat_concentration", F.lit(0.0)), F.coalesce("iat_autocorr", F.lit(0.0))
    max_var = th("beaconing.max_variance_threshold")
    regular = (var <= max_var) | (conc >= 0.85) | (auto >= 0.70)
    fires = (
        (n >= th("beaconing.min_heartbeats"))
        & (n >= 2)
        & (period >= th("beaconing.min_period_seconds"))
        & regular
    )
    conf = F.least(
        F.lit(0.99),
        0.82
        + F.least(F.lit(0.12), (max_var - F.least(var, max_var)) * 2.0)
        + F.least(F.lit(0.05), (n - 3) * 0.01),
    )
    details = F.format_string(
        "Periodic C2 beaconing detected at %.1fs intervals via FFT harmonic analysis "
        "(%d heartbeats, IAT variance=%.6fs², concentration=%.2f).",
        rnd(period, 1), n, var, rnd_small(conc, 2),
    )
    return candidate(
        fires, S.BEACON, conf, details,
        inter_arrival_variance=var, shannon_entropy=col("stamp_entropy"),
        byte_ratio=col("f300_byte_ratio"), ja3_hash=col("ja3_hash"),
        fft_concentration=conc, beacon_period_seconds=period,
        inter_arrival_stddev=col("iat_stddev"),
    )


def dns_lexical() -> DataFrame | list[Column]:
    """Lexical columns of the query name: entropy, bigram and trigram uniqueness."""
    q = col("dns_query")
    return [
        F.when(F.length(q) > 0, F.greatest(shannon_entropy(q), shannon_entropy(first_label(q)))).alias("dns_entropy"),
        F.when(F.length(q) > 0, ngram_uniqueness(q, 2)).alias("dns_bigrams"),
        F.when(F.length(q) > 0, ngram_uniqueness(q, 3)).alias("dns_trigrams"),
    ]


def dns(th) -> Finding:
    ratio, shared = _record_ratio()
    q, h = col("dns_query"), col("dns_entropy")
    length = F.length(q)
    qtype = F.upper(F.coalesce(F.nullif(col("dns_query_type"), F.lit("")), F.lit("A")))
    carrier = qtype.isin("TXT", "NULL")
    limit = th("dns.entropy_threshold")
    long_name = length >= th("dns.tunnel_length_threshold")
    txt_tunnel = carrier & (
        (length >= th("dns.txt_tunnel_length")) | (h >= th("dns.txt_entropy_threshold"))
    )
    conf = F.least(
        F.lit(0.99),
        0.80
        + F.least(F.lit(0.12), F.greatest(F.lit(0.0), (h - limit) * 0.3))
        + F.when(long_name, 0.06).otherwise(0.0)
        + F.when(carrier, 0.05).otherwise(0.0)
        + F.when(col("dns_trigrams") > 0.80, 0.03).otherwise(0.0),
    )
    mechanism = F.when(long_name | txt_tunnel, "DNS Tunneling (TXT/Payload)").otherwise("DGA Generation")
    details = F.format_string(
        "%s detected on query '%s': Shannon entropy=%.2f (threshold=%.2f), length=%d chars, record_type=%s.",
        mechanism, F.substring(q, 1, 50), rnd_small(h, 2), rnd(limit, 2), length, qtype,
    )
    return candidate(
        (length > 0) & ((h >= limit) | long_name | txt_tunnel) & _bytes_ok(), S.DGA, conf, details, [shared],
        shannon_entropy=h, byte_ratio=ratio,
        ngram_score=rnd_small(col("dns_bigrams"), 4),
    )


def signature_tables(custom_ja3: dict[str, str] | None = None) -> tuple[dict, dict]:
    return {**S.JA3_SIGNATURES, **(custom_ja3 or {})}, dict(S.JA4_SIGNATURES)


def signature_match(rows: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Adds `family`: JA3 first, then JA4, null when neither is known.

    signatures (kind, hash, family) goes before the built-in table and is joined on the hash, whatever its
    size; kinds other than ja3 and ja4 match nothing. Of a repeated hash the row with the greatest `seq`
    holds (where the table has that column), then the greatest family.
    """
    families = []
    for kind, table in zip(("ja3", "ja4"), signature_tables()):
        key = F.lower(col(f"{kind}_hash"))
        if signatures is not None:
            seq = col("seq") if "seq" in signatures.columns else F.lit(0)
            own = signatures.filter(col("kind") == kind).groupBy(col("hash").alias(f"_{kind}")).agg(
                F.max_by("family", F.struct(seq.alias("seq"), "family")).alias(f"_{kind}_family")
            )
            rows = rows.join(own, key == col(f"_{kind}"), "left")
            families.append(col(f"_{kind}_family"))
        known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        families.append(F.when(key.isNotNull(), F.try_element_at(known, key)))
    return rows.withColumn("family", F.coalesce(*families)).drop("_ja3", "_ja4", "_ja3_family", "_ja4_family")


def malware(th) -> Finding:
    ratio, shared = _record_ratio()
    details = F.format_string(
        "Malicious TLS ClientHello fingerprint matched (%s): attributed to %s (ports: %d).",
        F.coalesce(F.nullif(col("ja3_hash"), F.lit("")), col("ja4_hash")),
        col("family"), F.coalesce(col("dst_port"), F.lit(0)),
    )
    return candidate(
        col("family").isNotNull() & _bytes_ok(), S.MALWARE, F.lit(0.96), details, [shared],
        byte_ratio=ratio, ja3_hash=col("ja3_hash"),
    )


def probe_profile(th) -> Column:
    """Small SYN-like record; absent packet counts count as one packet."""
    return (
        (has_flag("SYN") | (_count("bytes_in") == 0))
        & (_count("bytes_out") <= th("reconnaissance.max_probe_bytes"))
        & (_packets("packets_out", 1) <= 2)
    )


def recon(th, name: str = "_rc") -> Finding:
    ports, ips, fan = _count("s60_ports"), _count("s60_ips"), _count("s10_fan_out")
    card, shown = col(f"{name}_card"), col(f"{name}_shown")
    ratio, shared = _record_ratio()
    layers = [
        {**shared, f"{name}_card": F.greatest(ports, ips, fan)},
        {f"{name}_shown": F.greatest(card, F.lit(3).cast("bigint"))},
    ]
    minimum = th("reconnaissance.min_target_cardinality")
    conf = F.least(F.lit(0.98), 0.80 + F.least(F.lit(0.18), (shown - minimum) * 0.03))
    details = F.format_string(
        "Reconnaissance %s detected from %s: %d unique target endpoints probed in window "
        "(target: %s:%d, bytes_out=%d).",
        F.when(ports >= ips, "Port Scan").otherwise("Subnet Sweep"), col("src_ip"), shown,
        col("dst_ip"), F.coalesce(col("dst_port"), F.lit(0)), _count("bytes_out"),
    )
    # entropy of the two tokens (address, port): one bit unless they are the same text
    pair_entropy = F.when(col("dst_ip") == col("dst_port").cast("string"), 0.0).otherwise(1.0)
    return candidate(
        (card >= minimum) & probe_profile(th) & _bytes_ok(), S.RECON, conf, details, layers,
        shannon_entropy=pair_entropy, byte_ratio=ratio, fan_out_count=shown,
        port_connections=ports, observation_window_seconds=F.lit(60),
        unique_destination_hosts=ips, unique_destination_ports=ports,
        window_10s_fan_out=fan, window_60s_fan_out=F.greatest(ips, ports),
    )


def exfil(th, name: str = "_ex") -> Finding:
    out, inn, ratio = (col(f"{name}_{x}") for x in ("out", "in", "ratio"))
    layers = [
        {
            f"{name}_out": F.greatest(_count("bytes_out"), _count("f300_bytes_out")),
            f"{name}_in": F.greatest(_count("bytes_in"), _count("f300_bytes_in")),
        },
        {f"{name}_ratio": flow_ratio(out, inn)},
    ]
    leak = (out >= th("exfiltration.min_egress_bytes")) & (ratio >= th("exfiltration.min_ratio_threshold"))
    bulk = (out >= th("exfiltration.massive_upload_bytes")) & (ratio >= th("exfiltration.massive_upload_ratio"))
    conf = F.least(
        F.lit(0.99),
        0.82
        + F.least(F.lit(0.12), (out / 10000000) * 0.05)
        + F.least(F.lit(0.05), (ratio / 100.0) * 0.05),
    )
    details = F.format_string(
        "Data exfiltration anomaly detected from %s -> %s: %,d bytes egressed with %.1fx outbound asymmetry ratio.",
        col("src_ip"), col("dst_ip"), out, rnd(ratio, 1),
    )
    return candidate(
        leak | bulk, S.EXFIL, conf, details, layers,
        byte_ratio=ratio, inbound_connections=F.lit(1), outbound_connections=F.lit(1),
        observation_window_seconds=F.lit(300), total_uploaded_bytes=out,
    )


_instances = count()
DETECTORS = [ddos, beacon, dns, malware, recon, exfil]


def with_overrides(detector, overrides: dict):
    """The same detector with thresholds of its own; helper columns get names of their own."""
    own = Thresholds(overrides)
    names = {"name": f"_own{next(_instances)}"} if "name" in signature(detector).parameters else {}

    def run(th):
        return detector(lambda key: own(key) if key in overrides else th(key), **names)

    return run


# --- features the detectors read ------------------------------------------


def target_window(rows: DataFrame, tie: str = "peers", wanted: Column | None = None) -> DataFrame:
    """10 s window of each target `dst:port`."""
    return sliding_features(
        rows, {"target": target_key(col("dst_ip"), col("dst_port"))}, 10,
        sums={"t10_count": F.lit(1), "t10_syn": has_flag("SYN").cast("bigint"), "t10_bytes": _count("bytes_out")},
        distincts={"src": (F.nullif(col("src_ip"), F.lit("")), {"t10_sources": 1})},
        tie=tie, wanted=wanted,
    )


def source_window(rows: DataFrame, tie: str = "peers", wanted: Column | None = None) -> DataFrame:
    """10 s window of each source: volume and distinct endpoints."""
    return sliding_features(
        rows, {"src_ip": col("src_ip")}, 10,
        sums={"s10_count": F.lit(1), "s10_syn": has_flag("SYN").cast("bigint"), "s10_bytes": _count("bytes_out")},
        distincts={
            "endpoint": (endpoint(col("dst_ip"), col("dst_port")), {"s10_fan_out": 1}),
            "src": (F.nullif(col("src_ip"), F.lit("")), {"s10_sources": 1}),
        },
        tie=tie, wanted=wanted,
    )


def source_fan_out(rows: DataFrame, tie: str = "peers", wanted: Column | None = None) -> DataFrame:
    """Only the distinct endpoints of `source_window`."""
    return sliding_features(
        rows, {"src_ip": col("src_ip")}, 10,
        distincts={"endpoint": (endpoint(col("dst_ip"), col("dst_port")), {"s10_fan_out": 1})},
        tie=tie, wanted=wanted,
    )


def probe_window(rows: DataFrame, tie: str = "peers", wanted: Column | None = None, count: bool = False) -> DataFrame:
    """60 s window of each source: distinct hosts and ports (0 and '' do not count)."""
    return sliding_features(
        rows, {"src_ip": col("src_ip")}, 60,
        sums={"s60_probes": F.lit(1)} if count else None,
        distincts={
            "ip": (F.nullif(col("dst_ip"), F.lit("")), {"s60_ips": 1}),
            "port": (F.nullif(col("dst_port"), F.lit(0)), {"s60_ports": 1}),
        },
        tie=tie, wanted=wanted,
    )


def with_features(rows: DataFrame, th, tie: str = "peers", emit: Column | None = None) -> DataFrame:
    """Records with everything the default detectors need.

    Only instants that can matter leave the windows: inbound-heavy records for the target
    window, probe-shaped records for the source windows. With `emit`, the other records only
    fill the windows (history of a stream).
    """
    emit = F.lit(True) if emit is None else emit
    inbound = emit & (_packets("packets_in", 0) > _packets("packets_out", 0))
    probes = emit & probe_profile(th)
    target = target_window(rows, tie, wanted=inbound)
    fan = source_fan_out(rows, tie, wanted=probes)
    sweep = probe_window(rows, tie, wanted=probes)
    flow = flow_window(rows, tie=tie)
    full = rows.filter(emit).withColumn("target", target_key(col("dst_ip"), col("dst_port")))
    # between joins: a filter on it is pushed below a projection after them, and would compute it once for each mention
    entropy, *ngrams = dns_lexical()
    full = attach(full, target, ["target"], tie).select("*", entropy)
    full = attach(full, fan, ["src_ip"], tie)
    full = attach(full, sweep, ["src_ip"], tie)
    full = attach(full, flow, ["flow_id"], tie)
    # records that carried no flow id of their own never find their flow's window
    masked = [
        F.when(col("flow_id_raw").isNotNull(), col(c)).alias(c) if c in _FLOW_FEATURES else col(c)
        for c in full.columns
    ]
    full = signature_match(full.select(*masked))
    return full.select("*", *ngrams)


_FLOW_FEATURES = {
    "f300_count", "f300_bytes_out", "f300_bytes_in", "f300_byte_ratio", "iat_mean",
    "iat_variance", "iat_stddev", "iat_autocorr", "iat_concentration", "stamp_entropy",
}


def _with_layers(rows: DataFrame, findings: list[Finding]) -> DataFrame:
    for layer in zip_longest(*[f.layers for f in findings], fillvalue={}):
        columns = {k: v for part in layer for k, v in part.items()}
        if columns:
            rows = rows.withColumns(columns)
    return rows


def detect(rows: DataFrame, th=None, detectors=None) -> DataFrame:
    """Records on which at least one detector fires, with `candidates` in registry order."""
    findings = [d(th or Thresholds()) for d in (detectors or DETECTORS)]
    fired = _with_layers(rows, findings).filter(reduce(lambda a, b: a | b, [f.fires for f in findings]))
    found = F.array(*[f.candidate for f in findings])
    return fired.withColumn("candidates", F.filter(found, lambda c: c.isNotNull()))


def detect_one(rows: DataFrame, detector, th=None) -> DataFrame:
    """The candidates of a single detector."""
    finding = detector(th or Thresholds())
    return _with_layers(rows, [finding]).filter(finding.fires).withColumn("candidate", finding.candidate)
