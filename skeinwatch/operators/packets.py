"""Packets to bidirectional flow records."""

from pyspark.sql import DataFrame, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.scalars import endpoint, uid_hash


def flows_from_packets(packets: DataFrame, source: str = "live") -> DataFrame:
    """One flow per file and pair of endpoints; the first packet fixes the direction.

    One grouped aggregate: every output is a sum, minimum or maximum with map-side combine,
    so a capture that is one single conversation is reduced before the shuffle. The
    direction is not known before the reduction, so both directions are summed and swapped
    afterwards.
    """
    a = endpoint(F.col("src_ip"), F.col("src_port"))
    b = endpoint(F.col("dst_ip"), F.col("dst_port"))
    p = packets.select(
        "file", "seq", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "flags",
        "wire_len", F.nullif("dns_query", F.lit("")).alias("dns_query"),
        F.nullif("tls_sni", F.lit("")).alias("tls_sni"),
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (a <= b).alias("up"),
    )
    up = F.col("up")

    def by_side(value):
        return [F.sum(F.when(side, value).otherwise(0)) for side in (up, ~up)]

    def first_of(name, side):
        return F.min_by(name, F.when(side & F.col(name).isNotNull(), F.col("seq")))

    sizes, counts = by_side(F.col("wire_len")), by_side(F.lit(1))
    opener = F.struct(
        "src_ip", "src_port", "dst_ip", "dst_port", "proto", "flags", "wire_len", "up", "dns_query",
    )
    seen = ["SYN", "ACK", "FIN", "RST", "PSH"]
    first_seen = [
        F.min(F.when(F.array_contains("flags", f), F.col("seq") * 8 + i)).alias(f"at_{f}")
        for i, f in enumerate(seen)
    ]
    g = p.groupBy("file", "lo", "hi").agg(
        F.min_by(opener, "seq").alias("o"),
        F.min("seq").alias("seq"),
        F.max_by("ts_us", "seq").alias("ts_us"),
        sizes[0].alias("bytes_up"), sizes[1].alias("bytes_down"),
        counts[0].alias("packets_up"), counts[1].alias("packets_down"),
        first_of("dns_query", up).alias("dns_up"), first_of("dns_query", ~up).alias("dns_down"),
        first_of("tls_sni", up).alias("sni_up"), first_of("tls_sni", ~up).alias("sni_down"),
        *first_seen,
    )
    forward = F.col("o.up")
    # an unanswered SYN counts as a packet that arrived at the target
    syn = F.array_contains("o.flags", "SYN") & ~F.array_contains("o.flags", "ACK")
    moved, size = syn.cast("bigint"), F.when(syn, F.col("o.wire_len")).otherwise(0)

    def pick(x, y):
        return F.when(forward, F.col(x)).otherwise(F.col(y))

    key = F.concat(
        endpoint(F.col("o.src_ip"), F.col("o.src_port")), F.lit("->"),
        endpoint(F.col("o.dst_ip"), F.col("o.dst_port")),
    )
    flags = F.transform(
        F.array_sort(
            F.filter(
                F.array(*[F.struct(F.col(f"at_{f}").alias("s"), F.lit(f).alias("f")) for f in seen]),
                lambda x: x["s"].isNotNull(),
            )
        ),
        lambda x: x["f"],
    )
    sni = pick("sni_up", "sni_down")
    values = {
        "seq": F.col("seq"), "ts": F.timestamp_micros("ts_us"), "ts_us": F.col("ts_us"),
        "record_kind": F.lit("conn"), "flow_id_raw": key, "flow_id": key,
        "src_ip": F.col("o.src_ip"), "src_port": F.col("o.src_port"),
        "dst_ip": F.col("o.dst_ip"), "dst_port": F.col("o.dst_port"),
        "protocol": F.col("o.proto"), "flags": flags,
        "bytes_out": pick("bytes_up", "bytes_down") - size,
        "bytes_in": pick("bytes_down", "bytes_up") + size,
        "packets_out": pick("packets_up", "packets_down") - moved,
        "packets_in": pick("packets_down", "packets_up") + moved,
        "dns_query": pick("dns_up", "dns_down"),
        # the type is known only when the opening packet carried the query
        "dns_query_type": F.when(F.col("o.dns_query").isNotNull(), "A"),
        "server_name": sni, "ja3_hash": F.md5(sni), "uid": uid_hash(key),
        "source": F.lit(source),
    }
    return g.select(
        "file", *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.FLOW.fields]
    )
