"""Streams give what the batch operators give on the same records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skeinwatch import schemas as S
from skeinwatch.operators.detectors import detect_one, dns, dns_lexical
from skeinwatch.operators import analytics as an
from skeinwatch.plans.pipeline import alert_pipeline
from skeinwatch.sources import logs, topics
from skeinwatch.sources.event_flows import flows
from skeinwatch.streaming import views
from skeinwatch.streaming.live import AlertStream

SF = "/root/testdata/sf0.001"
COLUMNS = ["alert_id", "ts_us", "threat_class", "confidence_score", "severity", "incident_id", "evidence"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The flows of sf0.001 as three ordered topic files."""
    path = str(tmp_path_factory.mktemp("topics"))
    records = flows(spark, SF)
    for lo, hi in ((0, 400), (400, 720), (720, 10**9)):
        topics.emit_to_files(records.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1), path)
    return path


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_alert_stream_equals_batch(spark, parts, tmp_path):
    rules = lambda s: s.createDataFrame(
        [("r1", 1, "source_ip", "d", "10.42.0.0/16", None, None, True, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), None)], S.RULE
    )
    counted = []
    stream = AlertStream(str(tmp_path / "s"), rules=rules, on_batch=lambda b, i: counted.append((i, b.count())))
    stream.start(topics.file_topics(spark, parts, files_per_trigger=1).drop("topic")).awaitTermination()
    got = stream.alerts(spark)
    want = alert_pipeline(flows(spark, SF), rules=rules(spark))
    assert got.select("batch_id").distinct().count() == 3
    a = got.select(*COLUMNS, "suppressed").orderBy("alert_id").collect()
    b = want.select(*COLUMNS, "suppressed").orderBy("alert_id").collect()
    assert len(a) == len(b) > 300
    assert a == b
    assert stream.delivered(spark).count() == got.filter("NOT suppressed").count() < len(a)
    assert got.filter("processing_latency_ms IS NULL").count() == 0
    assert sum(n for _, n in counted) == 1000
    # a retried batch rewrites its own folders and nothing else
    third = flows(spark, SF).filter("seq >= 720")
    stream.process(third, 2)
    assert stream.alerts(spark).select(*COLUMNS, "suppressed").orderBy("alert_id").collect() == b


def test_late_and_empty_batches(spark, make_flows, tmp_path):
    hash_ = "6734f37431670b3ab4292b8f60f29984"
    row = lambda t: dict(ja3_hash=hash_, bytes_out=1, bytes_in=9, packets_out=9, t=t)
    stream = AlertStream(str(tmp_path / "s"), delay_seconds=60)
    stream.process(make_flows([row(1000.0)]), 0)
    stream.process(make_flows([row(1.0)]).filter("false"), 1)
    stream.process(make_flows([row(950.0), row(100.0), row(1200.0)]), 2)
    got = stream.alerts(spark).orderBy("ts_us").collect()
    assert [r["ts_us"] for r in got] == [950_000_000, 1_000_000_000, 1_200_000_000]
    assert len({r["incident_id"] for r in got if r["ts_us"] >= 1_000_000_000}) <= 2


def test_stateless_and_windowed_views(spark, parts):
    stream = lambda: topics.file_topics(spark, parts, files_per_trigger=1)
    found = drain(spark, views.dns_findings(stream()).select("seq", "candidate.confidence"), "dns_out")
    want = detect_one(flows(spark, SF).select("*", *dns_lexical()), dns).select("seq", "candidate.confidence")
    assert sorted(found.collect()) == sorted(want.collect())
    assert drain(spark, views.malware_findings(stream()).select("seq"), "mal_out").count() == 25
    rates = drain(spark, views.throughput(stream()), "rate_out", "complete")
    assert sorted(rates.collect()) == sorted(an.throughput_series(flows(spark, SF)).collect())


def test_alert_views(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = alert_pipeline(flows(spark, SF))
    alerts.write.parquet(path)
    stored = spark.read.parquet(path)
    stored.limit(50).write.mode("append").parquet(path)  # repeats, for the dedup
    stream = lambda: views.dedup(spark.readStream.schema(stored.schema).parquet(path))
    per_bucket = drain(spark, stream().groupBy("threat_class").count(), "dedup_out", "complete")
    want = alerts.groupBy("threat_class").count()
    assert sorted(per_bucket.collect()) == sorted(want.collect())
    raw = spark.readStream.schema(stored.schema).parquet(path)
    buckets = drain(spark, views.trends(raw), "trend_out", "complete")
    assert buckets.agg(F.sum("n")).first()[0] == alerts.count() + 50
    sessions = drain(spark, views.incidents(raw), "inc_out", "complete")
    batch = an.incidents(alerts)
    key = lambda df: sorted((r["source_ip"], r["first_seen_us"], r["last_seen_us"]) for r in df.collect())
    assert key(sessions) == key(batch)


def test_tailed_logs_join_by_session(spark, make_flows, tmp_path):
    rows = [dict(t=1000.0 + i, uid=f"C{i}", src_port=1000 + i, dns_query=f"q{i}.example" if i % 2 else None) for i in range(6)]
    logs.write_logs(make_flows(rows), str(tmp_path / "l"))
    conn = logs.normalize_lines(logs.stream_lines(spark, str(tmp_path / "l" / "conn")), "conn")
    dns_ = logs.normalize_lines(logs.stream_lines(spark, str(tmp_path / "l" / "dns")), "dns")
    joined = drain(spark, views.enrich_by_uid(conn, dns_, "dns_query").select("uid", "dns_query"), "join_out")
    assert {(r["uid"], r["dns_query"]) for r in joined.collect() if r["dns_query"]} == {(f"C{i}", f"q{i}.example") for i in (1, 3, 5)}
