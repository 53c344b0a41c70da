"""Flow records derived from the `events` table.

A deterministic projection (no join, no shuffle) of two columns of `events`, in which
the event id picks a traffic role. `FLOWS_SQL` is the same projection for a plain SQL
engine and serves the correctness checks.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import flow_key, uid_hash

BASE_US = 1704067200000000
STEP_US = 250000


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flows_from_events(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    e = events.select(
        eid,
        uid,
        (eid % 40).alias("role"),
        F.floor(eid / 40).alias("j"),
        F.floor(eid / 10).alias("tens"),
        F.md5(eid.cast("string")).alias("em"),
        F.md5(uid.cast("string")).alias("um"),
    )
    role, j, eid = F.col("role"), F.col("j"), F.col("event_id")

    def text(x):
        return F.lit(x) if isinstance(x, str) else x

    def pick(default, *cases):
        out = F.when(F.lit(False), text(default))
        for roles, value in cases:
            out = out.when(role.isin(roles), text(value))
        return out.otherwise(text(default))

    def octet(x):
        return x.cast("string")

    scan, flood = [1, 2, 3], [4, 14, 24, 34]
    src_ip = pick(
        F.concat(F.lit("10.24."), octet(F.col("user_id") % 15 + 1), F.lit("."), octet(F.col("user_id") % 200 + 2)),
        ([0], "192.168.1.150"),
        ([20], "192.168.1.151"),
        (scan + [10, 11], "10.42.9.88"),
        (flood, F.concat(F.lit("203.0.113."), octet(F.col("tens") % 20 + 1))),
    )
    src_port = pick(eid % 30000 + 30000, ([0], F.lit(49500)), ([20], F.lit(49501)))
    dst_ip = pick(
        "142.250.190.46",
        ([0, 20], "198.51.100.77"),
        (scan, "10.24.12.20"),
        (flood, "10.24.8.10"),
        ([5, 6, 10], "8.8.8.8"),
    )
    dst_port = pick(
        F.lit(443),
        ([0, 20], F.lit(8443)),
        (scan, eid % 500 + 1000),
        (flood, F.lit(80)),
        ([5, 6, 10], F.lit(53)),
    )
    no_flags = F.array().cast("array<string>")
    syn = F.array(F.lit("SYN"))
    dga = F.concat(F.substring(F.col("em"), 1, 22), F.lit(".biz"))
    known = F.array(*[F.lit(h) for h in S.JA3_SIGNATURES])
    bulk_out = (eid % 17) * 1000000 + 1000000
    bulk_in = (eid % 7) * 20000 + 1000

    shaped = e.select(
        eid.alias("seq"),
        (
            F.lit(BASE_US) + eid * STEP_US + F.when(role == 20, (j * 3) % 5 * 100000).otherwise(0)
        ).cast("bigint").alias("ts_us"),
        src_ip.alias("src_ip"),
        src_port.cast("int").alias("src_port"),
        dst_ip.alias("dst_ip"),
        dst_port.cast("int").alias("dst_port"),
        pick("TCP", ([5, 6, 10], "UDP")).alias("protocol"),
        pick(
            F.array(F.lit("ACK"), F.lit("PSH")),
            (scan + flood, syn),
            ([5, 6, 10], no_flags),
            ([9], F.array(F.lit("ACK"))),
        ).alias("flags"),
        pick(
            eid % 3000 + 200,
            ([0, 20], F.lit(128)),
            (scan, F.lit(44)),
            (flood, F.lit(40)),
            ([5, 6, 10], F.lit(66)),
            ([7, 11], bulk_out),
        ).cast("bigint").alias("bytes_out"),
        pick(
            eid % 30000 + 1200,
            ([0, 20], F.lit(64)),
            (scan + flood + [10], F.lit(0)),
            ([5, 6], F.lit(120)),
            ([7, 11], bulk_in),
        ).cast("bigint").alias("bytes_in"),
        pick(
            eid % 10 + 4,
            ([0, 20] + flood, F.lit(2)),
            (scan + [5, 6, 10], F.lit(1)),
            ([9], F.lit(5)),
        ).cast("bigint").alias("packets_out"),
        pick(
            eid % 20 + 6,
            ([0, 20], F.lit(2)),
            (scan, F.lit(0)),
            (flood, eid % 700 + 200),
            ([5, 6, 10], F.lit(1)),
            ([9], eid % 100 + 100),
        ).cast("bigint").alias("packets_in"),
        F.when(role.isin([5, 10]), dga)
        .when(role == 6, F.concat(F.col("em"), F.col("um"), F.lit(".exfil-tun.net")))
        .alias("dns_query"),
        F.when(role.isin([5, 10]), "A").when(role == 6, "TXT").alias("dns_query_type"),
        F.when(role == 8, F.element_at(known, (j % 6 + 1).cast("int"))).alias("ja3_hash"),
    )
    key = flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    return shaped.select(
        "seq",
        F.timestamp_micros("ts_us").alias("ts"),
        "ts_us",
        F.lit("conn").alias("record_kind"),
        key.alias("flow_id_raw"),
        key.alias("flow_id"),
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flags",
        "bytes_out", "bytes_in", "packets_out", "packets_in",
        "dns_query", "dns_query_type",
        F.lit(None).cast("array<string>").alias("answers"),
        F.lit(None).cast("string").alias("qclass_name"),
        F.lit(None).cast("string").alias("server_name"),
        F.lit(None).cast("string").alias("sni"),
        "ja3_hash",
        F.lit(None).cast("string").alias("ja3s_hash"),
        F.lit(None).cast("string").alias("ja4_hash"),
        F.lit(None).cast("string").alias("tls_version"),
        F.lit(None).cast("string").alias("cipher"),
        uid_hash(key).alias("uid"),
        F.lit(None).cast("double").alias("source_ip_entropy"),
        F.lit(None).cast("array<int>").alias("splt_packet_sizes"),
        F.lit(None).cast("array<double>").alias("splt_interarrival_times"),
        F.lit("live").alias("source"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(read_events(spark, sf_dir))


_JA3_LIST = ", ".join(f"'{h}'" for h in S.JA3_SIGNATURES)

# CTEs `ev`, `fl` for a plain SQL engine; flags stay text there.
FLOWS_SQL = f"""
ev AS (
  SELECT event_id, user_id, event_id % 40 AS role,
         CAST(floor(event_id / 40.0) AS BIGINT) AS j,
         CAST(floor(event_id / 10.0) AS BIGINT) AS tens,
         md5(CAST(event_id AS VARCHAR)) AS em, md5(CAST(user_id AS VARCHAR)) AS um
  FROM events),
fl0 AS (
  SELECT event_id AS seq, role,
    CAST({BASE_US} + event_id * {STEP_US}
         + CASE WHEN role = 20 THEN ((j * 3) % 5) * 100000 ELSE 0 END AS BIGINT) AS ts_us,
    CASE WHEN role = 0 THEN '192.168.1.150' WHEN role = 20 THEN '192.168.1.151'
         WHEN role IN (1, 2, 3, 10, 11) THEN '10.42.9.88'
         WHEN role IN (4, 14, 24, 34) THEN concat('203.0.113.', CAST(tens % 20 + 1 AS VARCHAR))
         ELSE concat('10.24.', CAST(user_id % 15 + 1 AS VARCHAR), '.', CAST(user_id % 200 + 2 AS VARCHAR))
    END AS src_ip,
    CAST(CASE WHEN role = 0 THEN 49500 WHEN role = 20 THEN 49501
         ELSE event_id % 30000 + 30000 END AS INTEGER) AS src_port,
    CASE WHEN role IN (0, 20) THEN '198.51.100.77' WHEN role IN (1, 2, 3) THEN '10.24.12.20'
         WHEN role IN (4, 14, 24, 34) THEN '10.24.8.10' WHEN role IN (5, 6, 10) THEN '8.8.8.8'
         ELSE '142.250.190.46' END AS dst_ip,
    CAST(CASE WHEN role IN (0, 20) THEN 8443 WHEN role IN (1, 2, 3) THEN event_id % 500 + 1000
         WHEN role IN (4, 14, 24, 34) THEN 80 WHEN role IN (5, 6, 10) THEN 53
         ELSE 443 END AS INTEGER) AS dst_port,
    CASE WHEN role IN (5, 6, 10) THEN 'UDP' ELSE 'TCP' END AS protocol,
    CASE WHEN role IN (1, 2, 3, 4, 14, 24, 34) THEN 'SYN' WHEN role IN (5, 6, 10) THEN ''
         WHEN role = 9 THEN 'ACK' ELSE 'ACK,PSH' END AS flags,
    CAST(CASE WHEN role IN (0, 20) THEN 128 WHEN role IN (1, 2, 3) THEN 44
         WHEN role IN (4, 14, 24, 34) THEN 40 WHEN role IN (5, 6, 10) THEN 66
         WHEN role IN (7, 11) THEN 1000000 + (event_id % 17) * 1000000
         ELSE 200 + event_id % 3000 END AS BIGINT) AS bytes_out,
    CAST(CASE WHEN role IN (0, 20) THEN 64 WHEN role IN (1, 2, 3, 4, 14, 24, 34, 10) THEN 0
         WHEN role IN (5, 6) THEN 120 WHEN role IN (7, 11) THEN 1000 + (event_id % 7) * 20000
         ELSE 1200 + event_id % 30000 END AS BIGINT) AS bytes_in,
    CAST(CASE WHEN role IN (0, 20, 4, 14, 24, 34) THEN 2 WHEN role IN (1, 2, 3, 5, 6, 10) THEN 1
         WHEN role = 9 THEN 5 ELSE 4 + event_id % 10 END AS BIGINT) AS packets_out,
    CAST(CASE WHEN role IN (0, 20) THEN 2 WHEN role IN (1, 2, 3) THEN 0
         WHEN role IN (4, 14, 24, 34) THEN 200 + event_id % 700 WHEN role IN (5, 6, 10) THEN 1
         WHEN role = 9 THEN 100 + event_id % 100 ELSE 6 + event_id % 20 END AS BIGINT) AS packets_in,
    CASE WHEN role IN (5, 10) THEN concat(substr(em, 1, 22), '.biz')
         WHEN role = 6 THEN concat(em, um, '.exfil-tun.net') END AS dns_query,
    CASE WHEN role IN (5, 10) THEN 'A' WHEN role = 6 THEN 'TXT' END AS dns_query_type,
    CASE WHEN role = 8 THEN list_extract([{_JA3_LIST}], CAST(j % 6 + 1 AS BIGINT)) END AS ja3_hash
  FROM ev),
fl AS (
  SELECT *, concat(src_ip, ':', CAST(src_port AS VARCHAR), '->', dst_ip, ':', CAST(dst_port AS VARCHAR)) AS flow_id
  FROM fl0)
"""
