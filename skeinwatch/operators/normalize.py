"""Log records to flow records, and the join of the three logs by session id."""

from pyspark.sql import Column, DataFrame, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import flow_key, history_to_flags, parse_event_time, safe_int, safe_port

TOPICS = {"conn": "traffic-flows", "dns": "dns-queries", "ssl": "ssl-metadata"}

_TYPES = {f.name: f.dataType for f in S.FLOW.fields}


def _given(*names: str) -> Column:
    """First field that is present and not empty; numbers that are zero are left out when lines are parsed."""
    return F.coalesce(*[F.nullif(F.col(f"e.`{x}`"), F.lit("")) for x in names])


def _flow_row(kind: str, fields: dict[str, Column]) -> list[Column]:
    base = {"seq": F.col("seq"), "record_kind": F.lit(kind), "source": F.lit("live"), **fields}
    base["ts_us"] = F.unix_micros(base["ts"])
    return [base.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()]


def _ends(default_port: int) -> dict[str, Column]:
    return {
        "src_ip": F.coalesce(_given("id.orig_h", "src_ip"), F.lit("0.0.0.0")),
        "src_port": safe_port(_given("id.orig_p", "src_port")),
        "dst_ip": F.coalesce(_given("id.resp_h", "dst_ip"), F.lit("0.0.0.0")),
        "dst_port": safe_port(_given("id.resp_p", "dst_port"), default_port),
    }


def _keyed(ends: dict[str, Column]) -> Column:
    return flow_key(ends["src_ip"], ends["src_port"], ends["dst_ip"], ends["dst_port"])


def normalize_conn(entries: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """entries: seq and `e`, a struct of schema LOG_ENTRY."""
    ends = _ends(0)
    key = _keyed(ends)
    history = F.coalesce("e.history", F.lit(""))
    flags = history_to_flags(history)
    flags = F.when(F.size(flags) > 0, flags).otherwise(
        F.coalesce("e.flags", F.array().cast("array<string>"))
    )
    bytes_out = safe_int(_given("orig_bytes", "orig_ip_bytes", "bytes_out"))
    bytes_in = safe_int(_given("resp_bytes", "resp_ip_bytes", "bytes_in"))
    packets_out = safe_int(F.coalesce(_given("orig_pkts", "packets_out"), F.lit("1")))
    packets_in = safe_int(_given("resp_pkts", "packets_in"))
    one_way = one_way_syn(history, packets_in)
    pairs = swap_one_way(one_way, bytes_out, bytes_in, packets_out, packets_in)
    return entries.select(
        *_flow_row(
            "conn",
            {
                **ends, **pairs,
                "ts": parse_event_time(F.col("e.ts"), _now(ingest_ts)),
                "flow_id_raw": key, "flow_id": key,
                "protocol": F.upper(F.coalesce(_given("proto", "protocol"), F.lit("TCP"))),
                "flags": flags,
                "dns_query": F.col("e.dns_query"),
                "dns_query_type": F.col("e.dns_query_type"),
                "ja3_hash": _given("ja3", "ja3_hash"),
                "ja4_hash": F.col("e.ja4"),
                "uid": F.col("e.uid"),
            },
        )
    )


def one_way_syn(history: Column, packets_in: Column) -> Column:
    """A SYN that got no answer: its packets are shown as arriving at the target."""
    return (
        history.contains("S") & ~history.contains("h") & ~history.contains("A") & (packets_in == 0)
    )


def swap_one_way(one_way, bytes_out, bytes_in, packets_out, packets_in) -> dict[str, Column]:
    return {
        "bytes_out": F.when(one_way, bytes_in).otherwise(bytes_out),
        "bytes_in": F.when(one_way, bytes_out).otherwise(bytes_in),
        "packets_out": F.when(one_way, packets_in).otherwise(packets_out),
        "packets_in": F.when(one_way, packets_out).otherwise(packets_in),
    }


def _now(ingest_ts: Column | None) -> Column:
    return F.current_timestamp() if ingest_ts is None else ingest_ts


def normalize_dns(entries: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    ends = _ends(53)
    return entries.select(
        *_flow_row(
            "dns",
            {
                **ends, "flow_id": _keyed(ends),
                "ts": parse_event_time(F.col("e.ts"), _now(ingest_ts)),
                "dns_query": F.col("e.query"),
                "dns_query_type": F.coalesce("e.qtype_name", F.lit("A")),
                "answers": F.coalesce("e.answers", F.array().cast("array<string>")),
                "qclass_name": F.coalesce("e.qclass_name", F.lit("C_INTERNET")),
                "uid": F.col("e.uid"),
            },
        )
    )


def normalize_ssl(entries: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    ends = _ends(443)
    return entries.select(
        *_flow_row(
            "ssl",
            {
                **ends, "flow_id": _keyed(ends),
                "ts": parse_event_time(F.col("e.ts"), _now(ingest_ts)),
                "server_name": F.col("e.server_name"),
                "ja3_hash": F.col("e.ja3"), "ja3s_hash": F.col("e.ja3s"), "ja4_hash": F.col("e.ja4"),
                "tls_version": F.col("e.version"), "cipher": F.col("e.cipher"),
                "uid": F.col("e.uid"),
            },
        )
    )


NORMALIZERS = {"conn": normalize_conn, "dns": normalize_dns, "ssl": normalize_ssl}


def union_records(*frames: DataFrame) -> DataFrame:
    """All record kinds as one stream of flow records."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def enrich_by_uid(conn: DataFrame, dns: DataFrame, ssl: DataFrame) -> DataFrame:
    """Connections take the query and fingerprint of their session where they have none.

    The side logs are reduced to one row per session before the join; sessions without an id
    are kept apart, so they do not meet in one partition.
    """
    session = F.col("uid").isNotNull() & (F.col("uid") != "")
    order = F.struct("ts_us", "seq")
    names = dns.filter(session).groupBy("uid").agg(
        F.max_by(F.struct("dns_query", "dns_query_type"), order).alias("_dns")
    )
    prints = ssl.filter(session).groupBy("uid").agg(F.max_by("ja3_hash", order).alias("_ja3"))
    meta = names.join(prints, "uid", "full_outer")
    joined = conn.filter(session).join(meta, "uid", "left")

    def missing(name):
        return F.coalesce(F.col(name) == "", F.lit(True))

    take = missing("dns_query") & F.coalesce(F.col("_dns.dns_query") != "", F.lit(False))
    enriched = (
        joined.withColumn(
            "dns_query_type",
            F.when(take, F.coalesce("_dns.dns_query_type", F.lit("A"))).otherwise(F.col("dns_query_type")),
        )
        .withColumn("dns_query", F.when(take, F.col("_dns.dns_query")).otherwise(F.col("dns_query")))
        .withColumn(
            "ja3_hash",
            F.when(missing("ja3_hash") & F.coalesce(F.col("_ja3") != "", F.lit(False)), F.col("_ja3"))
            .otherwise(F.col("ja3_hash")),
        )
        .select(*conn.columns)
    )
    return enriched.unionByName(conn.filter(~F.coalesce(session, F.lit(False))))


def rebase_time(rows: DataFrame, as_of_us: int) -> DataFrame:
    """Move a recording so that its last record is at as_of; spacing is kept."""
    last = rows.agg(F.max("ts_us").alias("_last"))
    moved = rows.crossJoin(F.broadcast(last)).withColumn("ts_us", F.col("ts_us") + (F.lit(as_of_us) - F.col("_last")))
    return moved.withColumn("ts", F.timestamp_micros("ts_us")).drop("_last")
