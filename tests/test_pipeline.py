"""Detectors and alert assembly on scripted traffic."""

import pytest
from pyspark.sql import functions as F

from skeinwatch import schemas as S
from skeinwatch.operators import alerts as al, detectors as det
from skeinwatch.operators.thresholds import Thresholds
from skeinwatch.plans import pipeline
from skeinwatch.plans.pipeline import alert_pipeline

SYN = ["SYN"]
SCENES = {}


def scene(rows):
    """Register scripted traffic. All scenes run in one pass, far apart in time."""
    SCENES[rows.__name__] = rows
    return rows


@pytest.fixture(scope="module")
def story(make_flows):
    rows, owner = [], []
    for i, (name, build) in enumerate(SCENES.items()):
        for r in build():
            rows.append({**r, "t": r.get("t", 5000.0) + i * 100_000})
            owner.append(name)
    told = {name: [] for name in SCENES}
    for alert in run(make_flows(rows), tie="arrival"):
        told[owner[alert["seq"]]].append(alert)
    return told


def run(flows, **kw):
    return [r.asDict(True) for r in alert_pipeline(flows, **kw).orderBy("ts_us", "seq", "threat_class").collect()]


def of(alerts, cls):
    return [a for a in alerts if a["threat_class"] == cls]


def train(src, stamps, **kw):
    base = dict(src_ip=src, src_port=5555, dst_ip="198.51.100.44", dst_port=8443, bytes_out=500, bytes_in=400,
                packets_out=2, packets_in=2, flags=["PSH", "ACK"])
    return [{**base, **kw, "t": t} for t in stamps]


def scan(src, ports, t=6000.0, **kw):
    return [
        dict(src_ip=src, dst_ip="10.0.0.99", dst_port=p, flags=SYN, bytes_out=44, bytes_in=0, packets_out=1, packets_in=0, t=t, **kw)
        for p in ports
    ]


@scene
def benign_traffic_is_silent():
    rows = [
        dict(src_ip=f"10.0.1.{i}", src_port=40000 + i, dst_ip="142.250.190.46", flags=["ACK", "PSH"], bytes_out=800,
             bytes_in=4500, packets_out=8, packets_in=12, t=1000.0 + i)
        for i in range(25)
    ]
    return rows


def test_benign_traffic_is_silent(story):
    assert story["benign_traffic_is_silent"] == []


@scene
def distributed_flood_counts_sources():
    rows = [
        dict(src_ip=f"203.0.113.{i}", dst_ip="10.0.0.1", dst_port=80, flags=SYN, packets_in=400, packets_out=0,
             bytes_in=16000, t=2000.0 + i * 0.1)
        for i in range(1, 6)
    ]
    return rows


def test_distributed_flood_counts_sources(story):
    last = story["distributed_flood_counts_sources"][-1]
    assert last["threat_class"] == S.DDOS
    assert "Distributed SYN Flood" in last["evidence"]["details"] and "5 source(s)" in last["evidence"]["details"]
    assert last["evidence"]["unique_source_count"] == 5
    assert last["confidence_score"] >= 0.92


@scene
def outbound_heavy_is_no_flood():
    rows = [dict(flags=["ACK", "PSH"], packets_in=1, packets_out=2000, bytes_in=10, bytes_out=10)]
    return rows


def test_outbound_heavy_is_no_flood(story):
    assert of(story["outbound_heavy_is_no_flood"], S.DDOS) == []


@scene
def weak_surge_is_low():
    rows = [dict(src_ip="203.0.113.50", dst_ip="10.0.0.1", dst_port=80, packets_in=145, packets_out=5, bytes_in=60000, bytes_out=2000, flags=["ACK"], t=3000.0)]
    return rows


def test_weak_surge_is_low(story):
    (a,) = story["weak_surge_is_low"]
    assert a["threat_class"] == S.DDOS and a["confidence_score"] < 0.8 and a["severity"] == "low"
    assert "Volumetric PPS Surge" in a["evidence"]["details"]


@scene
def udp_storm_label():
    rows = [dict(protocol="UDP", packets_in=900, packets_out=1, bytes_in=100, bytes_out=10)]
    return rows


def test_udp_storm_label(story):
    assert "UDP Storm" in of(story["udp_storm_label"], S.DDOS)[0]["evidence"]["details"]


@scene
def negative_bytes_silence_the_detector():
    rows = [dict(packets_in=900, packets_out=1, bytes_in=-5, bytes_out=10)]
    return rows


def test_negative_bytes_silence_the_detector(story):
    assert of(story["negative_bytes_silence_the_detector"], S.DDOS) == []


@scene
def beacon_trains():
    rows = train("10.7.7.7", [7000.0, 7014.85, 7030.0, 7044.85]) + train("10.7.7.8", [8000.0, 8015.0, 8030.0, 8045.0])
    return rows


def test_beacon_trains(story):
    found = of(story["beacon_trains"], S.BEACON)
    jittered = [a for a in found if a["source_ip"] == "10.7.7.7"][-1]
    exact = [a for a in found if a["source_ip"] == "10.7.7.8"][-1]
    # gaps 14.85, 15.15, 14.85: population variance 0.02
    assert jittered["evidence"]["inter_arrival_variance"] == pytest.approx(0.02, abs=1e-6)
    assert jittered["confidence_score"] == pytest.approx(0.89, abs=0.011)
    assert exact["confidence_score"] == 0.93 and exact["evidence"]["inter_arrival_variance"] == 0.0
    assert exact["evidence"]["beacon_period_seconds"] == 15.0
    assert "Periodic C2 beaconing detected at 15.0s intervals" in exact["evidence"]["details"]


@scene
def records_without_flow_id_see_no_flow_window():
    rows = train("10.7.7.9", [7000.0, 7015.0, 7030.0, 7045.0], record_kind="ssl")
    return rows


def test_records_without_flow_id_see_no_flow_window(story):
    assert of(story["records_without_flow_id_see_no_flow_window"], S.BEACON) == []


@scene
def dns_findings():
    rows = [
        dict(src_ip="10.8.8.8", dst_ip="8.8.8.8", dst_port=53, bytes_out=400, bytes_in=600, dns_query="abcdefghijklmn.example.com", dns_query_type="A"),
        dict(src_ip="10.8.8.9", dst_ip="8.8.4.4", dst_port=53, bytes_out=500, bytes_in=100, dns_query="v8xq9p2m1k0z4w7y9l3n6c5b2r8t.tunnel-exfil.biz", dns_query_type="TXT"),
        dict(src_ip="10.8.8.7", dst_ip="8.8.4.4", dst_port=53, bytes_out=50, bytes_in=100, dns_query="example.com", dns_query_type="A"),
        dict(src_ip="10.8.8.6", dst_ip="8.8.4.4", dst_port=53, bytes_out=50, bytes_in=100),
    ]
    return rows


def test_dns_findings(story):
    found = {a["source_ip"]: a for a in of(story["dns_findings"], S.DGA)}
    assert set(found) == {"10.8.8.8", "10.8.8.9"}
    assert found["10.8.8.8"]["confidence_score"] == 0.9
    assert found["10.8.8.9"]["evidence"]["shannon_entropy"] >= 3.8
    assert found["10.8.8.9"]["evidence"]["dns_query_type"] == "TXT"


def test_fingerprints(make_flows, spark):
    rows = [
        dict(src_ip="10.1.0.1", ja3_hash="6734F37431670B3AB4292B8F60F29984", bytes_out=1, bytes_in=5000, packets_out=5),
        dict(src_ip="10.1.0.2", ja4_hash="t13d151600_8daaf6152771_000000000000", bytes_out=2000, bytes_in=5000, packets_out=5),
        dict(src_ip="10.1.0.3", ja3_hash="feed", bytes_out=2000, bytes_in=5000, packets_out=5),
    ]
    flows = make_flows(rows)
    found = {a["source_ip"]: a for a in run(flows)}
    assert set(found) == {"10.1.0.1", "10.1.0.2"}
    assert found["10.1.0.1"]["confidence_score"] == 0.96 and found["10.1.0.1"]["severity"] == "critical"
    assert "TrickBot" in found["10.1.0.1"]["evidence"]["details"] and "Cobalt Strike" in found["10.1.0.2"]["evidence"]["details"]
    custom = spark.createDataFrame([("ja3", "feed", "House Worm")], "kind string, hash string, family string")
    more = [("ja3", "feed", "House Worm", 2), ("ja3", "feed", "Zebra Worm", 1), ("tls", "feed", "Nothing", 9)]
    ordered = spark.createDataFrame(more, "kind string, hash string, family string, seq int")
    for table in (custom, ordered):
        got = det.signature_match(flows, table).orderBy("src_ip").select("family").collect()
        assert [r[0] for r in got] == ["TrickBot Banking Trojan", "Cobalt Strike Malleable C2 (JA4)", "House Worm"]


@scene
def scans():
    rows = scan("192.168.1.201", [21, 22, 80, 443]) + scan("192.168.1.202", [21, 22, 23, 80, 443, 8080, 9000])
    return rows


def test_scans(story):
    found = of(story["scans"], S.RECON)
    by_source = {}
    for a in found:
        by_source.setdefault(a["source_ip"], []).append(a)
    # with arrival order the first two probes stay below three ports
    assert len(by_source["192.168.1.201"]) == 2 and len(by_source["192.168.1.202"]) == 5
    assert by_source["192.168.1.201"][-1]["confidence_score"] == 0.83
    assert by_source["192.168.1.201"][-1]["severity"] == "moderate"
    assert by_source["192.168.1.202"][-1]["confidence_score"] == 0.92
    assert "Port Scan" in found[0]["evidence"]["details"]


@scene
def sweep_label():
    rows = [dict(src_ip="10.3.3.3", dst_ip=f"10.0.0.{i}", dst_port=22, flags=SYN, bytes_out=44, packets_out=1, t=100 + i) for i in range(4)]
    return rows


def test_sweep_label(story):
    assert "Subnet Sweep" in of(story["sweep_label"], S.RECON)[-1]["evidence"]["details"]


@scene
def exfiltration():
    rows = [
        dict(src_ip="10.9.9.9", src_port=40004, dst_ip="203.0.113.99", bytes_out=1_050_000, bytes_in=50_000, packets_out=100, packets_in=10),
        dict(src_ip="10.9.9.10", src_port=40005, dst_ip="203.0.113.99", bytes_out=25_000_000, bytes_in=250_000, packets_out=2000, packets_in=20),
        dict(src_ip="10.9.9.11", src_port=40006, dst_ip="203.0.113.99", bytes_out=900_000, bytes_in=10, packets_out=2000, packets_in=20),
    ]
    return rows


def test_exfiltration(story):
    found = {a["source_ip"]: a for a in of(story["exfiltration"], S.EXFIL)}
    assert set(found) == {"10.9.9.9", "10.9.9.10"}
    assert found["10.9.9.9"]["confidence_score"] == pytest.approx(0.84, abs=0.011)
    assert found["10.9.9.10"]["confidence_score"] == 0.99
    assert "25,000,000 bytes" in found["10.9.9.10"]["evidence"]["details"]
    assert found["10.9.9.10"]["evidence"]["byte_ratio"] == 100.0


@scene
def attack_chain():
    src = "192.168.1.188"
    rows = scan(src, [21, 22, 80, 443, 8080], t=2000.0)
    rows += [dict(src_ip=src, ja3_hash="a0e9f5d64349fb13191bc781f81f42e1", bytes_out=10, bytes_in=10, packets_out=9, t=2000.0)]
    rows += [dict(src_ip=src, bytes_out=30_000_000, bytes_in=1000, packets_out=2000, t=2000.0)]
    return rows


def test_attack_chain(story):
    src = "192.168.1.188"
    found = story["attack_chain"]
    exfil = of(found, S.EXFIL)[0]
    assert exfil["evidence"]["details"].startswith("[Attack Chain: Data Exfiltration -> Encrypted Malware -> Reconnaissance Scan] ")
    assert "stages: 3 (+0.05)" in exfil["evidence"]["confidence_basis"]
    assert len({a["incident_id"] for a in found}) == 1
    first = of(found, S.RECON)[0]
    assert not first["evidence"]["details"].startswith("[Attack Chain")


@scene
def corroboration():
    rows = [dict(ja3_hash="6734f37431670b3ab4292b8f60f29984", bytes_out=30_000_000, bytes_in=1000, packets_out=2000)]
    return rows


def test_corroboration(story):
    found = story["corroboration"]
    assert {a["threat_class"] for a in found} == {S.MALWARE, S.EXFIL}
    assert all(a["evidence"]["detector_count"] == 2 and "(+0.03)" in a["evidence"]["confidence_basis"] for a in found)
    assert len({a["alert_id"] for a in found}) == 2
    assert of(found, S.MALWARE)[0]["confidence_score"] == 1.0


@scene
def incidents_split_after_the_gap():
    hash_ = "6734f37431670b3ab4292b8f60f29984"
    stamps = [0.0, 300.0, 600.000001, 650.0, 1500.0]
    rows = [dict(ja3_hash=hash_, bytes_out=10, bytes_in=10, packets_out=9, t=1000 + t) for t in stamps]
    rows += [dict(src_ip="10.0.0.9", ja3_hash=hash_, bytes_out=10, bytes_in=10, packets_out=9, t=1100.0)]
    return rows


def test_incidents_split_after_the_gap(story):
    found = story["incidents_split_after_the_gap"]
    ids = [a["incident_id"] for a in found if a["source_ip"] == "10.0.0.1"]
    assert ids[0] == ids[1] and ids[1] != ids[2] and ids[2] == ids[3] and ids[3] != ids[4]
    assert len({a["incident_id"] for a in found}) == 4


@scene
def missing_source_has_no_incident():
    rows = [dict(src_ip="", ja3_hash="6734f37431670b3ab4292b8f60f29984", bytes_out=10, bytes_in=10, packets_out=9)]
    return rows


def test_missing_source_has_no_incident(story):
    assert story["missing_source_has_no_incident"][0]["incident_id"] is None


@scene
def six_classes_spread_over_severities():
    rows = [
        dict(src_ip="203.0.113.50", dst_ip="10.0.0.1", dst_port=80, packets_in=145, packets_out=5, bytes_in=60000, bytes_out=2000, flags=["ACK"]),
        dict(src_ip="203.0.113.51", dst_ip="10.0.0.2", dst_port=80, packets_in=250, packets_out=5, bytes_in=100000, bytes_out=2000, flags=["ACK"]),
        dict(src_ip="203.0.113.52", dst_ip="10.0.0.3", dst_port=80, packets_in=4000, packets_out=1, bytes_in=100000, flags=SYN),
        dict(src_ip="10.8.8.8", dst_ip="8.8.8.8", dst_port=53, bytes_out=400, bytes_in=600, dns_query="abcdefghijklmn.example.com", dns_query_type="A"),
        dict(src_ip="10.1.0.1", ja3_hash="6734f37431670b3ab4292b8f60f29984", bytes_out=1, bytes_in=5000, packets_out=5),
        dict(src_ip="10.9.9.9", bytes_out=1_050_000, bytes_in=50_000, packets_out=100, packets_in=10),
        dict(src_ip="10.9.9.10", bytes_out=25_000_000, bytes_in=250_000, packets_out=2000, packets_in=20),
    ]
    rows += train("10.7.7.7", [7000.0, 7014.85, 7030.0, 7044.85]) + scan("192.168.1.201", [21, 22, 80, 443])
    return rows


def test_six_classes_spread_over_severities(story):
    found = story["six_classes_spread_over_severities"]
    assert {a["threat_class"] for a in found} == set(S.THREAT_CLASSES)
    bands = {}
    for a in found:
        bands[a["severity"]] = bands.get(a["severity"], 0) + 1
    assert len(bands) >= 3 and max(bands.values()) / len(found) < 0.8


def test_threshold_overrides_change_decisions(make_flows):
    surge = make_flows([dict(src_ip="203.0.113.50", dst_port=80, packets_in=150, packets_out=5, bytes_in=60000, bytes_out=2000, flags=["ACK"])])
    assert len(run(surge)) == 1
    assert run(surge, th=Thresholds({"ddos.sigma_threshold": 20.0})) == []
    beacons = make_flows(train("10.7.7.8", [8000.0 + 15 * i for i in range(6)]))
    assert len(run(beacons)) == 4
    assert run(beacons, th=Thresholds({"beaconing.min_heartbeats": 50})) == []
    own = det.with_overrides(det.ddos, {"ddos.sigma_threshold": 20.0})
    assert run(surge, detectors=[own]) == []


def test_custom_detector_list(make_flows):
    flows = make_flows([dict(packets_in=900, packets_out=1, bytes_in=5, bytes_out=10), dict(bytes_out=25_000_000, bytes_in=2500)])

    def big_upload(th):
        return det.candidate(F.col("bytes_out") > 1000, S.EXFIL, F.lit(0.5), F.lit("big"))

    found = run(flows, detectors=[big_upload])
    assert [(a["threat_class"], a["evidence"]["details"], a["severity"]) for a in found] == [(S.EXFIL, "big", "low")]


def test_order_and_partitioning_do_not_matter(make_flows):
    rows = scan("192.168.1.202", range(20, 60), t=6000.0) + train("10.7.7.7", [7000.0 + 15 * i for i in range(30)])
    flows = make_flows(rows)
    a = run(flows)
    b = run(flows.orderBy(F.desc("ts_us")).repartition(13, "seq"))
    assert a == b and len(a) > 40


def test_dedup_and_merge(make_flows):
    rows = [dict(src_ip=f"10.0.0.{i}", ja3_hash="6734f37431670b3ab4292b8f60f29984", bytes_out=1, bytes_in=9, packets_out=9, t=100 + i) for i in range(9)]
    alerts = alert_pipeline(make_flows(rows))
    twice = alerts.unionByName(alerts)
    assert al.dedup(twice).count() == 9
    live = al.newest(alerts, 4)
    merged = al.merge_live_archive(live, alerts, 6).collect()
    assert [r["ts_us"] for r in merged] == [(108 - i) * 1_000_000 for i in range(6)]


def test_stored_severity_is_kept(make_flows):
    rows = [dict(src_ip=f"10.0.0.{i}", ja3_hash="6734f37431670b3ab4292b8f60f29984", bytes_out=1, bytes_in=9, packets_out=9) for i in range(2)]
    alerts = alert_pipeline(make_flows(rows)).withColumn("severity", F.when(F.col("source_ip") == "10.0.0.1", "low"))
    got = {r["source_ip"]: r["severity"] for r in al.calibrate_missing(alerts).collect()}
    assert got == {"10.0.0.0": "critical", "10.0.0.1": "low"}


def test_records_are_written_once_before_features_read_them(make_flows, monkeypatch):
    seen = []

    def spy(records, *args):
        seen.append(records)
        return candidates(records, *args)

    candidates = pipeline.candidate_records
    monkeypatch.setattr(pipeline, "candidate_records", spy)
    alert_pipeline(make_flows(train("10.9.9.9", [1000.0, 1001.0])))
    files = seen[0].inputFiles()
    assert files and all("/skeinwatch/records-" in f for f in files)


def test_no_filter_computes_the_entropy_of_names(make_flows):
    """A filter on it, pushed below its projection, computed it once for each mention, and was left out of code generation."""
    flows = make_flows([{"t": 1.0, "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "dst_port": 53, "dns_query": "a.example"}])
    found = det.detect(det.with_features(flows, Thresholds()), Thresholds())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and "LOG2(" in plan
    assert not [line for line in filters if "LOG2(" in line]
