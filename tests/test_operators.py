"""Suppression, thresholds, lifecycle, triage, analytics and the archive."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skeinwatch import schemas as S
from skeinwatch.operators import analytics as an, lifecycle as life, suppression as sup, thresholds as thr, triage as tri
from skeinwatch.plans.pipeline import alert_pipeline
from skeinwatch.sources import archive

UTC = dt.timezone.utc
HASH = "6734f37431670b3ab4292b8f60f29984"
START = 1_700_000_000


@pytest.fixture(scope="module")
def alerts(make_flows, tmp_path_factory, spark):
    """Eight malware alerts over an hour, one per source, in an archive."""
    ips = ["192.168.1.55", "203.0.113.88", "10.1.2.3", "10.1.200.3", "2001:db8:1::5", "172.16.0.9", "host-a", "10.99.0.1"]
    rows = [
        dict(src_ip=ip, dst_ip="198.51.100.7" if i % 2 else "198.51.100.9", ja3_hash=HASH, bytes_out=10, bytes_in=20, packets_out=9, t=START + i * 450)
        for i, ip in enumerate(ips)
    ]
    path = str(tmp_path_factory.mktemp("archive") / "alerts")
    archive.write_archive(alert_pipeline(make_flows(rows)), path)
    return archive.read_archive(spark, path)


def rule(i, kind, source=None, dest=None, cls=None, enabled=True, expires=None):
    t = dt.datetime.fromtimestamp(START + i, UTC)
    return (f"r{i}", i, kind, "d", source, dest, cls, enabled, t, t, expires)


def as_of():
    return F.timestamp_seconds(F.lit(START))


def test_suppression(spark, alerts):
    past, future = dt.datetime(2020, 1, 1, tzinfo=UTC), dt.datetime(2040, 1, 1, tzinfo=UTC)
    rules = spark.createDataFrame(
        [
            rule(1, "source_ip", "192.168.1.0/24"), rule(2, "source_ip", "192.168.0.0/16"),
            rule(3, "source_ip_threat_class", "10.1.77.7/17", cls=S.MALWARE), rule(4, "source_ip_threat_class", "172.16.0.0/12", cls=S.RECON),
            rule(5, "source_ip", "2001:db8::/32"), rule(6, "source_ip", "host-a"), rule(7, "source_ip", "203.0.113.88", enabled=False),
            rule(8, "source_ip", "203.0.113.88", expires=past), rule(9, "source_ip_threat_class", "10.99.0.1", expires=future),
        ],
        S.RULE,
    )
    marked = sup.mark_suppressed(alerts, rules, as_of())
    got = {r["source_ip"]: (r["suppression_rule_id"], r["suppressed"]) for r in marked.collect()}
    want = {"192.168.1.55": "r1", "10.1.2.3": "r3", "2001:db8:1::5": "r5", "host-a": "r6", "10.99.0.1": "r9"}
    assert got == {ip: (want.get(ip), ip in want) for ip in got} and len(got) == 8
    assert sup.deliverable(marked).count() == 3
    assert marked.filter("suppressed AND evidence.details IS NULL").count() == 0


def test_destination_and_catch_all_rules(spark, alerts):
    rules = spark.createDataFrame([rule(1, "destination_ip", dest="198.51.100.7"), rule(2, "source_ip", "0.0.0.0/0")], S.RULE)
    got = {r["source_ip"]: r["suppression_rule_id"] for r in sup.mark_suppressed(alerts, rules, as_of()).collect()}
    assert got["203.0.113.88"] == "r1" and got["192.168.1.55"] == "r2" and got["2001:db8:1::5"] is None
    assert sup.mark_suppressed(alerts, None, as_of()) is alerts
    unnamed = alerts.withColumn("alert_id", F.lit(None).cast("string"))
    again = {r["source_ip"]: r["suppression_rule_id"] for r in sup.mark_suppressed(unnamed, rules, as_of()).collect()}
    assert again == got
    tied = spark.createDataFrame([("r9", *rule(1, "source_ip", "0.0.0.0/0")[1:]), rule(1, "source_ip", "203.0.113.0/24")], S.RULE)
    assert sup.mark_suppressed(alerts, tied, as_of()).filter("source_ip = '203.0.113.88'").first()["suppression_rule_id"] == "r1"


def test_rule_validation(spark):
    rules = spark.createDataFrame(
        [rule(1, "source_ip", " 10.0.0.0/8 "), rule(2, "source_ip", "10.0.0.0/40"), rule(3, "destination_ip", "10.0.0.1"), rule(4, "other", "10.0.0.1"),
         rule(5, "source_ip_threat_class", "::1", cls="Weather")], S.RULE)
    got = [r["reason"] for r in sup.validate_rules(rules).orderBy("rule_seq").collect()]
    assert got == [None, "invalid source_ip", "destination_ip missing", "unknown rule type", "unknown threat class"]
    assert [r["id"] for r in sup.newest_first(rules).collect()] == ["r5", "r4", "r3", "r2", "r1"]


def test_threshold_table(spark):
    specs = thr.spec_table(spark)
    assert specs.count() == 22
    changes = [
        ("ddos.sigma_threshold", "20"), ("dns.entropy_threshold", "9"), ("beaconing.min_heartbeats", "2.5"), ("nonsense", "1"),
        ("malware.tls_ports", "443,443"), ("exfiltration.min_egress_bytes", "0"), ("dns.txt_tunnel_length", "nan"), ("ddos.min_udp_pps", "200"),
    ]
    eff = thr.effective_thresholds(specs, spark.createDataFrame(changes, "key string, value string"))
    assert {(r["key"], r["value"]) for r in thr.modified_thresholds(eff).collect()} == {("ddos.sigma_threshold", "20.0"), ("exfiltration.min_egress_bytes", "0")}
    row = thr.thresholds_row(eff).first()
    assert row["th_ddos_sigma_threshold"] == 20.0 and row["th_malware_tls_ports"] == [443, 8443, 9001, 4443]


def test_last_valid_override_holds(spark):
    rows = [("beaconing.min_heartbeats", "50", 1), ("beaconing.min_heartbeats", "9", 2), ("beaconing.min_heartbeats", "-1", 3)]
    changes = spark.createDataFrame(rows, "key string, value string, seq int")
    for overrides, want in ((changes, "9"), (changes.drop("seq"), "50")):
        eff = thr.effective_thresholds(thr.spec_table(spark), overrides)
        assert eff.count() == 22
        assert [r["value"] for r in thr.modified_thresholds(eff).collect()] == [want]


def test_thresholds_asof(spark, make_flows):
    flows = make_flows([dict(t=float(t)) for t in (10, 20, 30, 200000, 400000)])

    def seen(changes, key="ddos.sigma_threshold", schema="effective_us bigint, value string"):
        df = thr.thresholds_asof(flows, spark.createDataFrame(changes, schema), key, "s")
        return [r["s"] for r in df.orderBy("ts_us").collect()]

    assert seen([(20_000_000, "5"), (150_000_000_000, "7")]) == [3.0, 5.0, 5.0, 7.0, 7.0]
    assert seen([(20_000_000, "5"), (20_000_000, "20"), (25_000_000, "-7"), (150_000_000_000, "x")]) == [3.0, 20.0, 20.0, 20.0, 20.0]
    tied = [(20_000_000, "20", 1), (20_000_000, "5", 2), (30_000_000, "6", 3)]
    assert seen(tied, schema="effective_us bigint, value string, seq int") == [3.0, 5.0, 6.0, 6.0, 6.0]
    assert seen([(30_000_000, "8443, 993")], "malware.tls_ports")[1:3] == [[443, 8443, 9001, 4443], [8443, 993]]
    assert seen([]) == [3.0] * 5


def test_status_and_notes(spark, alerts, tmp_path):
    flow = alerts.filter("source_ip = 'host-a'").first()["flow_id"]
    t = dt.datetime(2024, 1, 1, tzinfo=UTC)
    changes = spark.createDataFrame(
        [(flow, "resolved", t + dt.timedelta(minutes=2)), (flow, "acknowledged", t)], "flow_id string, status string, changed_at timestamp"
    )
    current = life.latest_status(alerts, changes)
    assert tri.by_status(current, "resolved").count() == 1 and tri.by_status(current, "new").count() == 7
    path = str(tmp_path / "notes")
    rows = [(flow, "second", t + dt.timedelta(hours=1)), (flow, "first", t), (flow, "", t), ("other", "x", t)]
    archive.write_notes(spark.createDataFrame(rows, archive.NOTE), path)
    stored = archive.read_notes(spark, path)
    assert [r["text"] for r in life.notes_of(stored, flow).collect()] == ["first", "second"]
    noted = {r["source_ip"]: len(r["notes"]) for r in life.alerts_with_notes(alerts, stored).collect()}
    assert noted["host-a"] == 2 and sum(noted.values()) == 2


def test_trends_shape(alerts):
    until = (START + 3600) * 1_000_000
    points = an.trends(alerts, until, 60, 5).orderBy("bucket_us").collect()
    assert len(points) == 13 and sum(p[S.MALWARE] for p in points) == 8 and sum(p[S.RECON] for p in points) == 0
    assert points[0]["bucket_us"] % 300_000_000 == 0
    assert sum(p[S.MALWARE] for p in an.trends(alerts, until, 60, 5, max_alerts=3).collect()) == 3
    assert an.sliding_trend(alerts, until, 1).count() == 30 and an.sliding_trend(alerts, until, 60).count() == 60


def test_incidents_and_indicators(spark, alerts, tmp_path):
    first = an.incidents(alerts, limit=3, with_alerts=True).first()
    assert first["source_ip"] == "10.99.0.1" and len(first["alerts"]) == 1
    kinds = {r["type"]: r["count"] for r in an.iocs(alerts).groupBy("type").count().collect()}
    assert kinds == {"source_ip": 8, "ja3": 8}
    assert an.iocs(alerts, distinct=True).filter("type = 'ja3'").count() == 1
    assert an.iocs(alerts, F.lit((START + 7 * 450) * 1_000_000)).count() == 2
    archive.export_iocs_csv(an.iocs(alerts), str(tmp_path / "csv"))
    archive.export_iocs_json(an.iocs(alerts), str(tmp_path / "json"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["type", "value", "threat_class", "timestamp"]
    assert spark.read.json(str(tmp_path / "json")).count() == 16


def test_summary_queries(alerts):
    k = an.kpis(alerts).first()
    assert (k["critical_count"], k["high_count"], k["avg_confidence_pct"], k["top_vector"]) == (8, 0, 96.0, S.MALWARE)
    empty = an.kpis(alerts.filter("false")).first()
    assert (empty["critical_count"], empty["avg_confidence_pct"], empty["top_vector"]) == (0, 0.0, "None Detected")
    page = an.archive_page(alerts, 1, 5).collect()
    assert len(page) == 3 and not page[0]["has_next"] and an.archive_page(alerts, 0, 5).first()["has_next"]
    bands = an.severity_histogram(alerts).collect()
    assert [(b["severity"], b["share"], b["dominant"]) for b in bands] == [("critical", 1.0, True)]


def test_throughput(make_flows):
    flows = make_flows([dict(t=0.0, packets_out=0, packets_in=4, bytes_out=100, bytes_in=900), dict(t=2.0, packets_out=3, packets_in=0, bytes_out=1000)])
    r = an.throughput(flows).first()
    assert (r["total_packets"], r["total_bytes"], r["flows_per_sec"], r["bytes_per_sec"]) == (8, 2000, 1.0, 1000.0)
    assert an.throughput(flows, 0.1).first()["flows_per_sec"] == 2.0


def test_downsample(spark):
    series = spark.range(500).select(F.col("id").alias("bucket_us"))
    kept = [r[0] for r in an.downsample(series, 140).orderBy("bucket_us").collect()]
    assert kept == sorted(set(range(0, 500, 4)) | {499})
    assert an.downsample(series.limit(140), 140).count() == 140


def test_triage(alerts):
    assert tri.search(alerts, " TRICKBOT ").count() == 8 and tri.search(alerts, "host-a").count() == 1 and tri.search(alerts, " ").count() == 8
    assert tri.by_class_alias(alerts, "Encrypted Malware").count() == 8 and tri.by_class_alias(alerts, "ALL").count() == 8
    assert tri.by_class_alias(alerts, "Data Exfiltration").count() == 0
    assert tri.near(alerts, (START + 450) * 1_000_000).count() == 1
    r = alerts.select(tri.evidence_tags(F.col("evidence")).alias("t"), tri.direction_ratio(F.col("evidence")).alias("d"), tri.short_name(F.col("threat_class")).alias("n")).first()
    assert (r["t"], r["d"], r["n"]) == (["TLS"], "1:0.5", "Encrypted Malware")


def test_validation(alerts):
    bad = alerts.withColumn("confidence_score", F.when(F.col("source_ip") == "host-a", 2.0).otherwise(F.col("confidence_score")))
    got = tri.validate_alerts(bad)
    assert got.filter("valid").count() == 7 and got.filter("NOT valid").first()["reason"] == "confidence out of range"


def test_archive_prunes_months_and_merges_columns(spark, alerts, tmp_path):
    path = str(tmp_path / "a")
    old = alerts.drop("month", "severity")
    archive.write_archive(old, path)
    later = alerts.drop("month").withColumn("timestamp", F.expr("timestamp + INTERVAL 70 DAYS"))
    archive.write_archive(later, path)
    df = archive.read_archive(spark, path)
    assert df.count() == 16 and df.filter("severity IS NULL").count() == 8
    recent = archive.read_archive(spark, path, since="2023-12-01 00:00:00", threat_class=S.MALWARE)
    assert recent.count() == 8
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [" in plan


def test_baseline_in_stretches_equals_plain_fold(spark):
    import random

    from skeinwatch.operators.baseline import adaptive_baseline

    rnd = random.Random(5)
    rows = [(i, i * 500_000, "hot" if i % 3 else "b", float(rnd.choice([20, 60, 110, 400]))) for i in range(900)]
    df = spark.createDataFrame(rows, "seq bigint, ts_us bigint, k string, pps double")
    got = {r["key"]: r for r in adaptive_baseline(df, F.col("k"), F.col("pps"), stretch_seconds=150).collect()}
    for key in ("hot", "b"):
        m, s = 50.0, 30.0
        for r in rows:
            if r[2] == key and r[3] < m * 2.5:
                d = r[3] - m
                m, s = m + 0.02 * d, max(1.0, (s * s * 0.98 + 0.02 * d * d) ** 0.5)
        assert got[key]["ema_mean"] == pytest.approx(m, abs=1e-9) and got[key]["ema_std"] == pytest.approx(s, abs=1e-9)


def test_sparse_baseline_needs_few_rounds(spark, monkeypatch):
    """A target with two values an hour for 300 hours beside a busy one: equal to the plain fold, in rounds that do not grow with time."""
    import random

    from skeinwatch.operators import baseline

    rnd = random.Random(7)
    rows = [(i, i * 1_800_000_000, "sparse", float(rnd.choice([20, 60, 110, 400]))) for i in range(600)]
    rows += [(1000 + i, i * 1_000_000, "busy", float(rnd.choice([20, 60, 110]))) for i in range(13_000)]
    df = spark.createDataFrame(rows, "seq bigint, ts_us bigint, k string, pps double")
    folds, plain = [], baseline._fold
    monkeypatch.setattr(baseline, "_fold", lambda *a: folds.append(1) or plain(*a))
    got = {r["key"]: r for r in baseline.adaptive_baseline(df, F.col("k"), F.col("pps")).collect()}
    assert len(folds) <= 3
    for key in ("sparse", "busy"):
        m, s = 50.0, 30.0
        for x in (r[3] for r in rows if r[2] == key):
            if x < m * 2.5:
                d = x - m
                m, s = m + 0.02 * d, max(1.0, (s * s * 0.98 + 0.02 * d * d) ** 0.5)
        assert (got[key]["ema_mean"], got[key]["ema_std"]) == pytest.approx((m, s), abs=1e-9)
    assert {k: r["n"] for k, r in got.items()} == {"sparse": 600, "busy": 13_000}


def test_long_notes_are_shown_once_a_flow_and_spread(spark):
    """A flow with long notes and many alerts: each alert has them all, made once a flow; its alerts meet them in several parts."""
    noted = spark.range(3000).select(F.when(F.col("id") < 2900, "long").when(F.col("id") < 2990, "short").alias("flow_id"), F.format_string("note %040d", "id").alias("text"), F.timestamp_seconds(3000 - F.col("id")).alias("created_at"))
    flows = spark.range(400).select(F.concat(F.lit("a"), "id").alias("alert_id"), F.when(F.col("id") < 300, "long").when(F.col("id") < 350, "short").when(F.col("id") < 390, "none").alias("flow_id"))
    joined = life.alerts_with_notes(flows, noted, lambda n: F.array_join(F.transform(n, lambda x: x["text"]), ","))
    text = lambda ids: ",".join(f"note {i:040d}" for i in ids)
    wanted = {"long": text(range(2899, -1, -1)), "short": text(range(2989, 2899, -1))}
    got = joined.collect()
    assert len(got) == 400 and all(r["notes"] == wanted.get(r["flow_id"], "") for r in got)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(flow_id" in line and "_part" in line for line in plan.splitlines())


def test_a_repeated_run_leaves_the_archive_as_it_was(spark, tmp_path):
    def alerts(ids, month="2024-01"):
        rows = spark.createDataFrame([(i, f"{month}-15 10:00:00") for i in ids], "flow_id string, t string")
        return rows.select("flow_id", F.to_timestamp("t").alias("timestamp"), F.lit("ddos").alias("threat_class"))

    path = str(tmp_path / "archive")
    flows = lambda **o: sorted(r["flow_id"] for r in archive.read_archive(spark, path, **o).collect())
    archive.write_archive(alerts(["a", "b"]), path, run="001")
    archive.write_archive(alerts(["c"], "2024-02").withColumn("more", F.lit(1)), path, run="002")
    archive.write_archive(alerts(["a", "b"]), path, run="001")
    assert flows() == ["a", "b", "c"]
    assert flows(since="2024-02-01 00:00:00") == ["c"]
    assert set(archive.read_archive(spark, path).columns) == {"flow_id", "timestamp", "threat_class", "more", "month"}
    archive.write_archive(alerts(["a"], "2024-03"), path, run="001")  # the run found less, in another month
    assert flows() == ["a", "c"]

    def ends(batches):
        raise RuntimeError("ended")
        yield

    broken = alerts(["x"], "2024-04")
    with pytest.raises(Exception, match="ended"):
        archive.write_archive(broken.mapInPandas(ends, broken.schema), path, run="003")
    assert flows() == ["a", "c"]
    with pytest.raises(ValueError):
        archive.write_archive(broken, path, run="../other")
