import json

import pytest
from pyspark.sql import functions as F

from skeinwatch import schemas as S
from skeinwatch.operators.normalize import TOPICS, rebase_time
from skeinwatch.plans.replay import replay_logs
from skeinwatch.sources import logs, topics


def conn(**kw):
    base = {"id.orig_h": "172.20.1.1", "id.orig_p": 40_000, "id.resp_h": "192.0.2.10", "id.resp_p": 7_000, "proto": "tcp", "history": "ShADF"}
    return {**base, **kw}


@pytest.fixture
def write(tmp_path):
    def put(name, entries):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        lines = ["#separator \\x09"] + [e if isinstance(e, str) else json.dumps(e) for e in entries]
        (folder / "part.log").write_text("\n".join(lines) + "\n")
        return str(folder)

    return put


def norm(spark, kind, *entries):
    lines = spark.createDataFrame([(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)], "seq bigint, value string")
    return [r.asDict() for r in logs.normalize_lines(lines, kind, F.timestamp_micros(F.lit(1))).orderBy("seq").collect()]


def test_conn_fields(spark):
    host, port, peer, service = "172.20.3.9", 33071, "192.0.2.200", 8883
    given = conn(ts=1_650_000_321.25, uid="S-conn-1", orig_bytes=731, resp_bytes=90_017, orig_pkts=6, resp_pkts=71, history="ShAdDaFr",
                 **{"id.orig_h": host, "id.orig_p": port, "id.resp_h": peer, "id.resp_p": service})
    (r,) = norm(spark, "conn", given)
    assert r["ts_us"] == given["ts"] * 1_000_000 and r["uid"] == given["uid"]
    assert (r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["protocol"]) == (host, port, peer, service, "TCP")
    assert r["flow_id"] == f"{host}:{port}->{peer}:{service}"
    assert [r[f"{n}_{d}"] for n in ("bytes", "packets") for d in ("out", "in")] == [given[k] for k in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")]
    assert {"SYN", "ACK", "FIN"} <= set(r["flags"])


def test_one_way_syn_is_inbound(spark):
    n, size = 217, 9_331
    (r,) = norm(spark, "conn", conn(orig_bytes=size, resp_bytes=0, orig_pkts=n, resp_pkts=0, history="S"))
    assert [r[c] for c in ("packets_out", "packets_in", "bytes_out", "bytes_in")] == [0, n, 0, size]


def test_defaults_and_aliases(spark):
    rows = norm(
        spark, "conn",
        {"ts": "-", "orig_bytes": "-", "resp_bytes": 0, "resp_ip_bytes": 77, "orig_pkts": 0},
        {"src_ip": "1.2.3.4", "src_port": 5, "dst_ip": "4.3.2.1", "dst_port": 6, "protocol": "udp", "bytes_out": 3, "flags": ["SYN"], "ja3_hash": "x"},
    )
    a, b = rows
    assert (a["src_ip"], a["src_port"], a["protocol"], a["bytes_out"], a["bytes_in"], a["packets_out"], a["ts_us"]) == ("0.0.0.0", 0, "TCP", 0, 77, 1, 1)
    assert (b["src_ip"], b["dst_port"], b["protocol"], b["bytes_out"], b["flags"], b["ja3_hash"]) == ("1.2.3.4", 6, "UDP", 3, ["SYN"], "x")


def test_dns_and_ssl_fields(spark):
    asked = {"ts": 77.5, "id.orig_h": "172.20.3.9", "id.resp_h": "192.0.2.53", "id.resp_p": "-", "query": "mail.sample.test", "answers": ["192.0.2.8", "192.0.2.9"]}
    (q,) = norm(spark, "dns", asked)
    assert (q["dst_port"], q["dns_query_type"], q["qclass_name"], q["flow_id_raw"]) == (53, "A", "C_INTERNET", None)
    assert (q["dns_query"], q["answers"]) == (asked["query"], asked["answers"])
    shown = {"server_name": "login.sample.test", "ja3": "0f" * 16, "ja3s": "e1" * 16, "version": "TLSv13", "cipher": "AES"}
    (t,) = norm(spark, "ssl", {"ts": 78.5, "id.orig_h": "172.20.3.9", **shown})
    assert [t[c] for c in ("server_name", "ja3_hash", "ja3s_hash", "tls_version", "cipher")] == list(shown.values())


def test_bad_lines_are_set_aside(spark, write):
    path = write("conn", [conn(ts=1.0), "", "# note", "{broken", '{"ts": 1.0, "uid": "x"', "[1, 2]"])
    lines = logs.read_lines(spark, path)
    assert logs.normalize_lines(lines, "conn").count() == 1
    assert {r["value"] for r in logs.rejected_lines(lines).collect()} == {"{broken", '{"ts": 1.0, "uid": "x"', "[1, 2]"}


def test_session_join(spark):
    c = spark.createDataFrame([(0, json.dumps(conn(ts=10.5, uid="C1"))), (1, json.dumps(conn(ts=11.0, uid="C2", ja3="own"))), (2, json.dumps(conn(ts=12.0)))], "seq bigint, value string")
    d = spark.createDataFrame([(0, json.dumps({"ts": 9.0, "uid": "C1", "query": "old.org"})), (1, json.dumps({"ts": 10.0, "uid": "C1", "query": "new.org", "qtype_name": "TXT"}))], "seq bigint, value string")
    s = spark.createDataFrame([(0, json.dumps({"ts": 10.0, "uid": u, "ja3": "a0e9"})) for u in ("C1", "C2")], "seq bigint, value string")
    parts = {k: logs.normalize_lines(v, k) for k, v in {"conn": c, "dns": d, "ssl": s}.items()}
    from skeinwatch.operators.normalize import enrich_by_uid

    rows = {r["ts_us"]: r for r in enrich_by_uid(**parts).collect()}
    assert len(rows) == 3
    assert (rows[10500000]["dns_query"], rows[10500000]["dns_query_type"], rows[10500000]["ja3_hash"]) == ("new.org", "TXT", "a0e9")
    assert rows[11000000]["ja3_hash"] == "own" and rows[12000000]["ja3_hash"] is None


def session(uid, t, src, dst, sport, dport, out=(0, 1), back=(0, 0), **kw):
    """A connection entry; `out` and `back` are (bytes, packets)."""
    ends = {"id.orig_h": src, "id.orig_p": sport, "id.resp_h": dst, "id.resp_p": dport}
    return conn(ts=t, uid=uid, orig_bytes=out[0], orig_pkts=out[1], resp_bytes=back[0], resp_pkts=back[1], **ends, **kw)


def test_replayed_attacks(spark, write):
    signature = sorted(S.JA3_SIGNATURES)[0]
    ports, calls = 60, 7
    flooder, caller, scanner, leaker, infected, tunnel = (f"172.20.9.{i}" for i in range(6))
    entries = [session(f"f{i}", 500 + i / 8, flooder, "172.20.0.1", 20_000 + i, 443, (19_000, 475), history="S") for i in range(14)]
    entries += [session(f"b{i}", 500.0 + 22 * i, caller, "192.0.2.66", 41_000, 4_444, (200, 5), (310, 4)) for i in range(calls)]
    entries += [session(f"s{i}", 500 + i / 25, scanner, "172.20.0.7", 52_000, 2_000 + i, (44, 1), history="S") for i in range(ports)]
    entries += [session("x", 500.0, leaker, "192.0.2.90", 40_001, 443, (61_500_000, 43_000), (900, 12))]
    entries += [session("m", 501.5, infected, "192.0.2.91", 40_002, 443, (2_000, 9), (5_500, 11))]
    asked = {"ts": 500.0, "uid": "q", "id.orig_h": tunnel, "id.resp_h": "192.0.2.53", "id.resp_p": 53, "query": "k3z8w1q7x5v0j2h9d4g6f8s1p3.relay.test", "qtype_name": "TXT"}
    hello = {"ts": 501.25, "uid": "m", "id.orig_h": infected, "id.resp_h": "192.0.2.91", "id.resp_p": 443, "ja3": signature}
    alerts = replay_logs(spark, write("conn", entries), write("dns", [asked]), write("ssl", [hello])).collect()
    found = {}
    for a in alerts:
        assert a["source"] == "replay"
        found.setdefault((a["threat_class"], a["source_ip"]), []).append(a)
    of = lambda threat, ip, name: [a["evidence"][name] for a in found[threat, ip]]
    assert "SYN" in of(S.DDOS, flooder, "details")[-1]
    assert of(S.BEACON, caller, "inter_arrival_variance")[-1] <= 0.05
    assert max(of(S.RECON, scanner, "fan_out_count")) == ports
    assert of(S.EXFIL, leaker, "byte_ratio")[0] > 100 and of(S.DGA, tunnel, "shannon_entropy")[0] >= 3.8
    assert len(found[S.MALWARE, infected]) == 2  # the tls record itself and the enriched connection


def test_rebase_keeps_spacing(make_flows):
    flows = make_flows([dict(t=10.0), dict(t=25.0), dict(t=11.0)])
    assert sorted(r["ts_us"] for r in rebase_time(flows, 100_000_000).collect()) == [85_000_000, 86_000_000, 100_000_000]


def test_log_round_trip(spark, make_flows, tmp_path):
    flows = make_flows([dict(flags=["SYN", "ACK"], bytes_out=5, bytes_in=6, packets_out=2, packets_in=3, dns_query="a.b", dns_query_type="TXT", uid="U"), dict(t=6000.25)])
    logs.write_logs(flows, str(tmp_path / "out"))
    back = logs.scan_logs(spark, "conn", str(tmp_path / "out" / "conn")).orderBy("ts_us").collect()
    assert [(r["ts_us"], r["bytes_out"], r["flags"]) for r in back] == [(5_000_000_000, 5, ["SYN", "ACK"]), (6_000_250_000, 0, [])]
    assert logs.scan_logs(spark, "dns", str(tmp_path / "out" / "dns")).first()["dns_query_type"] == "TXT"
    assert logs.scan_logs(spark, "ssl", str(tmp_path / "out" / "ssl")).count() == 0


def test_topics_round_trip(spark, make_flows, tmp_path):
    flows = make_flows([dict(flags=["SYN"]), dict(record_kind="dns", dns_query="a.b")])
    topics.emit_to_files(flows, str(tmp_path / "t"))
    back = topics.decode(spark.read.parquet(str(tmp_path / "t"))).orderBy("seq")
    assert [r["topic"] for r in back.collect()] == [TOPICS["conn"], TOPICS["dns"]]
    assert back.drop("topic").collect() == flows.orderBy("seq").collect()


def test_list_fields_given_as_text(spark):
    lines = [
        '{"ts": 1, "uid": "a", "id.orig_h": "10.9.0.1", "query": "x.test", "answers": "192.0.2.1"}',
        '{"ts": 2, "uid": "b", "id.orig_h": "10.9.0.1", "query": "x.test", "answers": ["192.0.2.1", "192.0.2.2"]}',
        '{"ts": 3, "uid": "c", "id.orig_h": "10.9.0.1", "query": "x.test"}',
        '{"ts": 4, "uid": "d", "id.orig_h": "10.9.0.1", "query": "x.test", "answers": "[cut"}',
    ]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq bigint")
    got = [r["answers"] for r in logs.normalize_lines(df, "dns").orderBy("seq").collect()]
    assert got == [["192.0.2.1"], ["192.0.2.1", "192.0.2.2"], [], ["[cut"]]
    assert logs.rejected_lines(df).count() == 0


def test_numbers_keep_their_json_type(spark):
    """A number loses its fraction, the number 0 is missing, the text "0" is a value, other text is the default."""
    lines = [
        '{"id.orig_p":77.0,"orig_bytes":2750.0,"resp_bytes":3e3,"orig_pkts":"0","resp_pkts":"12.7"}',
        '{"id.orig_p":"80","orig_bytes":0,"bytes_out":9,"resp_bytes":"","bytes_in":5,"orig_pkts":0,"resp_pkts":0.5,"packets_in":4}',
        '{"id.orig_p":99999999999,"orig_bytes":1e30,"resp_bytes":null,"orig_pkts":true,"resp_pkts":[1]}',
    ]
    rows = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    got = logs.normalize_lines(rows, "conn").orderBy("seq")
    assert [tuple(r) for r in got.select("src_port", "bytes_out", "bytes_in", "packets_out", "packets_in").collect()] == [
        (77, 2750, 3000, 0, 0), (80, 9, 5, 1, 0), (0, 0, 0, 1, 0),
    ]
