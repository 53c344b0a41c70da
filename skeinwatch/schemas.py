"""Schemas and fixed vocabulary of the data model."""

from pyspark.sql import types as T

# --- fixed values (contract of the alert records) -------------------------
DDOS = "Volumetric & Protocol DDoS"
BEACON = "Botnet C2 Beaconing"
DGA = "DGA & DNS Tunneling"
MALWARE = "Encrypted Malware"
RECON = "Reconnaissance Scan"
EXFIL = "Data Exfiltration"

THREAT_CLASSES = [DDOS, BEACON, DGA, MALWARE, RECON, EXFIL]
STATUSES = ["new", "acknowledged", "investigating", "resolved", "false_positive"]
SEVERITIES = ["critical", "high", "moderate", "low"]

SEVERITY_CRITICAL = 0.95
SEVERITY_HIGH = 0.90
SEVERITY_MODERATE = 0.80

SHORT_NAMES = {
    DDOS: "Volumetric DDoS",
    BEACON: "Botnet C2",
    DGA: "DGA / DNS",
    MALWARE: "Encrypted Malware",
    RECON: "Recon Scan",
    EXFIL: "Data Exfil",
}

CLASS_ALIASES = {
    DDOS: ["volumetric & protocol ddos", "volumetric_dos", "protocol dos", "syn flood", "ddos", "dos"],
    BEACON: ["botnet c2 beaconing", "botnet_c2", "c2 beaconing", "botnet c2", "beaconing"],
    DGA: ["dga & dns tunneling", "dga_dns", "dns tunneling", "dga"],
    MALWARE: ["encrypted malware", "encrypted_malware", "malware"],
    RECON: ["reconnaissance scan", "recon_scan", "recon sweep", "port scan", "subnet sweep", "reconnaissance"],
    EXFIL: ["data exfiltration", "data_exfil", "exfiltration", "exfil"],
}

JA3_SIGNATURES = {
    "6734f37431670b3ab4292b8f60f29984": "TrickBot Banking Trojan",
    "a0e9f5d64349fb13191bc781f81f42e1": "Cobalt Strike HTTPS Beacon",
    "4d7a28d6f22da2e8ee7038a0dd777ecd": "Emotet Malware Dropper",
    "b386946a5a44d1ddcc843bc75336df1a": "Metasploit Meterpreter Reverse HTTPS",
    "b384b6559d81d2f70b7410313df2ce4f": "AsyncRAT Remote Access Trojan",
    "fd5998f49a3ae2d42eb7e89139a0fa95": "QakBot / Pinkslipbot Modular Trojan",
}
JA4_SIGNATURES = {
    "t13d151600_8daaf6152771_000000000000": "Cobalt Strike Malleable C2 (JA4)",
    "t12d190800_2828a2a2a2a2_112233445566": "Metasploit Stager HTTPS (JA4)",
}
# --- end of fixed values --------------------------------------------------

# One log line. Numbers are read as text because the logs write "-" for null.
LOG_ENTRY = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "ts", "uid", "`id.orig_h`", "`id.orig_p`", "`id.resp_h`", "`id.resp_p`",
            "src_ip", "src_port", "dst_ip", "dst_port", "proto", "protocol",
            "orig_bytes", "orig_ip_bytes", "bytes_out", "resp_bytes", "resp_ip_bytes",
            "bytes_in", "orig_pkts", "packets_out", "resp_pkts", "packets_in",
            "history", "dns_query", "dns_query_type", "ja3", "ja3_hash", "ja3s", "ja4",
            "query", "qtype_name", "qclass_name", "server_name", "version", "cipher",
        )
    ]
    + [
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("answers", T.ArrayType(T.StringType())),
    ]
)
LOG_ENTRY = T.StructType(
    [T.StructField(f.name.strip("`"), f.dataType) for f in LOG_ENTRY.fields]
)

FLOW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("record_kind", T.StringType()),
        T.StructField("flow_id_raw", T.StringType()),
        T.StructField("flow_id", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("bytes_out", T.LongType()),
        T.StructField("bytes_in", T.LongType()),
        T.StructField("packets_out", T.LongType()),
        T.StructField("packets_in", T.LongType()),
        T.StructField("dns_query", T.StringType()),
        T.StructField("dns_query_type", T.StringType()),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("qclass_name", T.StringType()),
        T.StructField("server_name", T.StringType()),
        T.StructField("sni", T.StringType()),
        T.StructField("ja3_hash", T.StringType()),
        T.StructField("ja3s_hash", T.StringType()),
        T.StructField("ja4_hash", T.StringType()),
        T.StructField("tls_version", T.StringType()),
        T.StructField("cipher", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("source_ip_entropy", T.DoubleType()),
        T.StructField("splt_packet_sizes", T.ArrayType(T.IntegerType())),
        T.StructField("splt_interarrival_times", T.ArrayType(T.DoubleType())),
        T.StructField("source", T.StringType()),
    ]
)

PACKET = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("wire_len", T.LongType()),
        T.StructField("dns_query", T.StringType()),
        T.StructField("tls_sni", T.StringType()),
    ]
)

# What a detector may report. Detector columns are nullable structs of this type.
CANDIDATE = T.StructType(
    [
        T.StructField("threat_class", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("inter_arrival_variance", T.DoubleType()),
        T.StructField("shannon_entropy", T.DoubleType()),
        T.StructField("byte_ratio", T.DoubleType()),
        T.StructField("fan_out_count", T.LongType()),
        T.StructField("ja3_hash", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("inbound_connections", T.LongType()),
        T.StructField("outbound_connections", T.LongType()),
        T.StructField("port_connections", T.LongType()),
        T.StructField("observation_window_seconds", T.IntegerType()),
        T.StructField("fft_concentration", T.DoubleType()),
        T.StructField("beacon_period_seconds", T.DoubleType()),
        T.StructField("inter_arrival_stddev", T.DoubleType()),
        T.StructField("ngram_score", T.DoubleType()),
        T.StructField("packets_per_second", T.DoubleType()),
        T.StructField("z_score", T.DoubleType()),
        T.StructField("source_ip_entropy", T.DoubleType()),
        T.StructField("unique_destination_hosts", T.LongType()),
        T.StructField("unique_destination_ports", T.LongType()),
        T.StructField("window_10s_fan_out", T.LongType()),
        T.StructField("window_60s_fan_out", T.LongType()),
        T.StructField("unique_source_count", T.LongType()),
        T.StructField("total_uploaded_bytes", T.LongType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rule_seq", T.LongType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("threat_class", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)
