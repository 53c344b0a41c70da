"""Every registered query with the SQL that must give the same rows.

All queries run over the whole `events` table. Queries on raw traffic derive their flow
records from it; queries on alerts read an alert archive that the full pipeline writes from
it once per session and scale folder.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions import net, scalars as fn, sql
from skeinwatch.operators import alerts as al, analytics as an, baseline as base, detectors as det, lifecycle as life
from skeinwatch.operators import normalize as norm, packets as pk, suppression as sup, triage as tri
from skeinwatch.operators import thresholds as thr, windows as win
from skeinwatch.operators.iat import flow_window
from skeinwatch.plans import oracle as O
from skeinwatch.plans.pipeline import alert_pipeline, candidate_records
from skeinwatch.sources import archive, captures, logs, tail, topics
from skeinwatch.sources.event_flows import BASE_US, STEP_US, flows
from skeinwatch.sources.work import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
col = F.col


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_archives: dict[tuple[str, str], str] = {}


def archived_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all flows, read from the archive the pipeline wrote."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _archives:
        try:
            return archive.read_archive(spark, _archives[key])
        except AnalysisException:  # the folder is gone
            pass
    path = new_path(spark, "archive")
    archive.write_archive(alert_pipeline(flows(spark, sf_dir)), path)
    _archives[key] = path
    return archive.read_archive(spark, path)


def joined(array) -> F.Column:
    return F.array_join(array, ",")


def stamp_from(sql_expr: str) -> str:
    return f"CAST({sql_expr} AS BIGINT)"


# --- scalar functions -----------------------------------------------------

_MAX = "(SELECT max(ts_us) AS mx FROM fl)"


@query("shannon_entropy", O.FLOWS + f" SELECT seq, {O.entropy('dns_query')} AS h FROM fl WHERE dns_query IS NOT NULL")
def _(spark, d):
    return flows(spark, d).filter("dns_query IS NOT NULL").select("seq", fn.shannon_entropy(col("dns_query")).alias("h"))


@query(
    "shannon_entropy_array",
    O.FLOWS + f" SELECT seq, CASE WHEN src_ip = dst_ip THEN 0.0 ELSE {O.r('list_entropy([src_ip, dst_ip, src_ip, CAST(dst_port AS VARCHAR)])', 4)} END AS h FROM fl",
)
def _(spark, d):
    tokens = F.array("src_ip", "dst_ip", "src_ip", col("dst_port").cast("string"))
    return flows(spark, d).select("seq", fn.shannon_entropy_tokens(tokens).alias("h"))


@query("flow_ratio", O.FLOWS + f" SELECT seq, {O.ratio('bytes_out', 'bytes_in')} AS byte_ratio FROM fl")
def _(spark, d):
    return flows(spark, d).select("seq", fn.flow_ratio(col("bytes_out"), col("bytes_in")).alias("byte_ratio"))


@query(
    "iat_variance",
    "SELECT event_id, CAST(0.0 AS DOUBLE) + " + O.r(
        "((a - m) * (a - m) + (b - m) * (b - m)) / 2", 6) + " AS v FROM (SELECT *, (a + b) / 2 AS m FROM "
    "(SELECT event_id, CAST(user_id % 7 AS DOUBLE) AS a, CAST(event_id % 5 + 1 AS DOUBLE) AS b FROM events))",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t0 = F.lit(0.0)
    t1 = (col("user_id") % 7).cast("double")
    t2 = t1 + (col("event_id") % 5 + 1)
    return e.select("event_id", fn.iat_variance(F.array(t2, t0, t1)).alias("v"))


@query("fan_out", O.FLOWS + " SELECT seq, CASE WHEN src_ip = dst_ip THEN 1 ELSE 2 END AS n FROM fl")
def _(spark, d):
    return flows(spark, d).select("seq", fn.fan_out(F.array("src_ip", "dst_ip", "src_ip")).alias("n"))


@query(
    "ngram_uniqueness",
    O.FLOWS + f" SELECT seq, {O.r(O.ngrams('dns_query', 2), 6)} AS bi, {O.r(O.ngrams('dns_query', 3), 6)} AS tri FROM fl WHERE dns_query IS NOT NULL",
)
def _(spark, d):
    q = col("dns_query")
    return flows(spark, d).filter("dns_query IS NOT NULL").select(
        "seq", fn.rnd(fn.ngram_uniqueness(q, 2), 6).alias("bi"), fn.rnd(fn.ngram_uniqueness(q, 3), 6).alias("tri")
    )


@query(
    "consonant_ratio",
    O.FLOWS + ", l AS (SELECT seq, lower(split_part(dns_query, '.', 1)) AS s FROM fl WHERE dns_query IS NOT NULL) SELECT seq, "
    + O.r("CAST(length(regexp_replace(s, '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) AS DOUBLE) / greatest(length(regexp_replace(s, '[^a-z]', '', 'g')), 1)", 6)
    + " AS ratio FROM l",
)
def _(spark, d):
    label = fn.first_label(col("dns_query"))
    return flows(spark, d).filter("dns_query IS NOT NULL").select("seq", fn.rnd(fn.consonant_ratio(label), 6).alias("ratio"))


@query("first_label", O.FLOWS + " SELECT seq, split_part(dns_query, '.', 1) AS label FROM fl WHERE dns_query IS NOT NULL")
def _(spark, d):
    return flows(spark, d).filter("dns_query IS NOT NULL").select("seq", fn.first_label(col("dns_query")).alias("label"))


@query(
    "ip_in_cidr",
    O.FLOWS + """ SELECT seq, src_ip LIKE '192.168.%' AS in16,
      (src_ip LIKE '203.0.113.%' AND CAST(split_part(src_ip, '.', 4) AS INTEGER) BETWEEN 8 AND 15) AS in29,
      src_ip = '10.42.9.88' AS in_host, FALSE AS in_v6 FROM fl""",
)
def _(spark, d):
    ip = col("src_ip")
    test = lambda c, n: net.ip_in_cidr(ip, F.lit(c)).alias(n)
    return flows(spark, d).select(
        "seq", test("192.168.77.5/16", "in16"), test("203.0.113.8/29", "in29"),
        test("10.42.9.88", "in_host"), test("2001:db8::/32", "in_v6"),
    )


# the same three from SQL text; their SQL is that of the column forms


def _from_sql(spark, d, text: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(text, fl=flows(spark, d))


@query("sql_shannon_entropy", SQL["shannon_entropy"])
def _(spark, d):
    return _from_sql(spark, d, "SELECT seq, shannon_entropy(dns_query) AS h FROM {fl} WHERE dns_query IS NOT NULL")


@query("sql_flow_ratio", SQL["flow_ratio"])
def _(spark, d):
    return _from_sql(spark, d, "SELECT seq, flow_ratio(bytes_out, bytes_in) AS byte_ratio FROM {fl}")


@query("sql_ip_in_cidr", SQL["ip_in_cidr"])
def _(spark, d):
    return _from_sql(
        spark, d,
        "SELECT seq, ip_in_cidr(src_ip, '192.168.77.5/16') AS in16, ip_in_cidr(src_ip, '203.0.113.8/29') AS in29, "
        "ip_in_cidr(src_ip, '10.42.9.88') AS in_host, ip_in_cidr(src_ip, '2001:db8::/32') AS in_v6 FROM {fl}",
    )


@query("clean_ip", O.FLOWS + " SELECT seq, src_ip AS plain, src_ip AS with_port, '2001:db8::1' AS v6 FROM fl")
def _(spark, d):
    return flows(spark, d).select(
        "seq", net.clean_ip(col("src_ip")).alias("plain"),
        net.clean_ip(fn.endpoint(col("src_ip"), col("src_port"))).alias("with_port"),
        net.clean_ip(F.concat(F.lit(" 2001:db8::1"), F.substring("src_ip", 1, 0))).alias("v6"),
    )


@query("z_score", O.FLOWS + f" SELECT seq, {O.r('(packets_in - 50.0) / 30.0', 6)} AS z FROM fl")
def _(spark, d):
    return flows(spark, d).select("seq", fn.rnd(fn.z_score(col("packets_in"), F.lit(50.0), F.lit(30.0)), 6).alias("z"))


@query("uid_hash", O.FLOWS + " SELECT seq, concat('C', substr(sha256(flow_id), 1, 16)) AS uid FROM fl")
def _(spark, d):
    return flows(spark, d).select("seq", fn.uid_hash(col("flow_id")).alias("uid"))


@query("ja3_of_sni", O.FLOWS + " SELECT seq, md5(concat('host', CAST(seq % 97 AS VARCHAR), '.example')) AS ja3 FROM fl")
def _(spark, d):
    return flows(spark, d).select("seq", F.md5(F.concat(F.lit("host"), (col("seq") % 97).cast("string"), F.lit(".example"))).alias("ja3"))


@query(
    "flow_key",
    O.FLOWS + " SELECT seq, flow_id, concat('target:', dst_ip, ':', CAST(dst_port AS VARCHAR)) AS target FROM fl",
)
def _(spark, d):
    return flows(spark, d).select(
        "seq", fn.flow_key(col("src_ip"), col("src_port"), col("dst_ip"), col("dst_port")).alias("flow_id"),
        fn.target_key(col("dst_ip"), col("dst_port")).alias("target"),
    )


@query(
    "severity",
    "SELECT event_id, CASE WHEN s >= 0.95 THEN 'critical' WHEN s >= 0.9 THEN 'high' WHEN s >= 0.8 THEN 'moderate' ELSE 'low' END AS severity "
    "FROM (SELECT event_id, (event_id % 101) / 100.0 AS s FROM events)",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", fn.severity((col("event_id") % 101) / 100.0).alias("severity"))


@query(
    "to_utc",
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM events",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.unix_micros(col("ts").cast("timestamp")).alias("ts_us"))


@query(
    "safe_int",
    "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 7 WHEN event_id % 4 = 1 THEN 7 WHEN event_id % 4 = 2 THEN event_id ELSE 7 END AS BIGINT) AS n FROM events",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    m = col("event_id") % 4
    text = F.when(m == 0, "-").when(m == 1, "bad").when(m == 2, col("event_id").cast("string"))
    return e.select("event_id", fn.safe_int(text, 7).alias("n"))


@query(
    "history_to_flags",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'SYN' WHEN 1 THEN 'SYN,ACK,PSH' WHEN 2 THEN 'SYN,ACK,PSH,FIN'
       WHEN 3 THEN 'RST' ELSE '' END AS flags FROM events""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    texts = ["S", "ShAD", "ShADF", "R", "", None]
    h = F.element_at(F.array(*[F.lit(t) for t in texts]), (col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", F.coalesce(joined(fn.history_to_flags(h)), F.lit("")).alias("flags"))


@query(
    "parse_event_time",
    f"SELECT event_id, CAST(CASE WHEN event_id % 4 = 3 THEN 99000000 ELSE {BASE_US} + event_id * {STEP_US} END AS BIGINT) AS ts_us FROM events",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    us = F.lit(BASE_US) + col("event_id") * STEP_US
    m = col("event_id") % 4
    text = (
        F.when(m == 0, (us / 1000000).cast("string"))
        .when(m == 1, (us / 1000000).cast("decimal(20,6)").cast("string"))
        .when(m == 2, F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise("not a time")
    )
    when = fn.parse_event_time(text, F.timestamp_micros(F.lit(99000000)))
    return e.select("event_id", F.unix_micros(when).alias("ts_us"))


# --- logs, topics, captures -----------------------------------------------


def _lines(spark, d) -> dict[str, DataFrame]:
    """Log lines of all flows; every TLS-fingerprinted flow also has a server name."""
    named = flows(spark, d).withColumn(
        "server_name", F.when(col("ja3_hash").isNotNull(), F.concat(F.lit("h"), (col("seq") % 97).cast("string"), F.lit(".example")))
    )
    return logs.log_lines(named)


def _dirty(lines: DataFrame) -> DataFrame:
    """Each line once, plus a comment, a blank and a cut-off line per ten lines."""
    junk = F.when(
        col("seq") % 10 == 0,
        F.array(F.lit("#separator x09"), F.lit("   "), F.expr("substring(value, 1, length(value) - 9)")),
    ).otherwise(F.array().cast("array<string>"))
    return lines.select("seq", F.explode(F.concat(F.array("value"), junk)).alias("value"))


_CONN_SQL = O.FLOWS + """, cn AS (SELECT *, (flags = 'SYN' AND packets_in = 0) AS swapped FROM fl)
SELECT seq, ts_us, flow_id, src_ip, src_port, dst_ip, dst_port, protocol,
  flags,
  CASE WHEN swapped THEN bytes_in ELSE bytes_out END AS bytes_out,
  CASE WHEN swapped THEN bytes_out ELSE bytes_in END AS bytes_in,
  CASE WHEN swapped THEN packets_in ELSE packets_out END AS packets_out,
  CASE WHEN swapped THEN packets_out ELSE packets_in END AS packets_in,
  concat('C', substr(sha256(flow_id), 1, 16)) AS uid FROM cn"""


def _conn_columns(df):
    return df.select(
        "seq", "ts_us", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
        joined("flags").alias("flags"), "bytes_out", "bytes_in", "packets_out", "packets_in", "uid",
    )


@query("normalize_conn", _CONN_SQL)
def _(spark, d):
    return _conn_columns(logs.normalize_lines(_lines(spark, d)["conn"], "conn"))


@query(
    "normalize_conn_numbers",
    """SELECT event_id AS seq, CAST(trunc(coalesce(value, 0)) AS BIGINT) AS bytes_out, CAST(0 AS BIGINT) AS bytes_in,
       CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS BIGINT) AS packets_out, CAST(0 AS INTEGER) AS src_port FROM events""",
)
def _(spark, d):
    """Counts written as fractions, as text or as zero, and ports out of range."""
    e = spark.read.parquet(f"{d}/events.parquet")
    packets = F.element_at(F.array(F.lit('"0"'), F.lit("0"), F.lit("3.0")), (col("event_id") % 3 + 1).cast("int"))
    line = F.concat(
        F.lit('{"orig_bytes":'), F.coalesce(col("value").cast("string"), F.lit("null")), F.lit(',"resp_bytes":"12.7","orig_pkts":'),
        packets, F.lit(',"id.orig_p":99999999999}'),
    )
    rows = logs.normalize_lines(e.select(col("event_id").alias("seq"), line.alias("value")), "conn")
    return rows.select("seq", "bytes_out", "bytes_in", "packets_out", "src_port")


@query("scan_zeek_logs", _CONN_SQL)
def _(spark, d):
    return _conn_columns(logs.normalize_lines(_dirty(_lines(spark, d)["conn"]), "conn"))


_FOLLOWED = ["ts_us", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flags", "bytes_out", "bytes_in", "packets_out", "packets_in", "uid"]


@query("tail_zeek_logs", f"SELECT {', '.join(_FOLLOWED)} FROM ({_CONN_SQL})")
def _(spark, d):
    """The logs written, followed by a stream from their first byte to their last, and normalised."""
    folder, out = new_path(spark, "followed-logs"), new_path(spark, "followed")
    logs.write_logs(flows(spark, d), folder)
    lines = tail.follow_lines(spark, f"{folder}/conn", "*.txt")
    stream = lines.writeStream.format("parquet").option("checkpointLocation", f"{out}/position").trigger(availableNow=True).start(f"{out}/lines")
    stream.awaitTermination()
    return _conn_columns(logs.normalize_lines(spark.read.schema(lines.schema).parquet(f"{out}/lines"), "conn")).select(*_FOLLOWED)


@query("rejected_log_lines", O.FLOWS + " SELECT count(*) AS n FROM fl WHERE seq % 10 = 0")
def _(spark, d):
    return logs.rejected_lines(_dirty(_lines(spark, d)["conn"])).agg(F.count(F.lit(1)).alias("n"))


@query(
    "swap_one_way_syn",
    O.FLOWS + """ SELECT CASE WHEN flags = 'SYN' AND packets_in = 0 THEN 'swapped' ELSE 'kept' END AS how, count(*) AS n,
      CAST(sum(CASE WHEN flags = 'SYN' AND packets_in = 0 THEN packets_out ELSE packets_in END) AS BIGINT) AS packets_in FROM fl GROUP BY 1""",
)
def _(spark, d):
    f = flows(spark, d)
    history = F.array_join(F.transform("flags", lambda x: F.substring(x, 1, 1)), "")
    one_way = norm.one_way_syn(history, col("packets_in"))
    moved = norm.swap_one_way(one_way, *(col(c) for c in ("bytes_out", "bytes_in", "packets_out", "packets_in")))
    return f.groupBy(F.when(one_way, "swapped").otherwise("kept").alias("how")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(moved["packets_in"]).alias("packets_in")
    )


@query(
    "normalize_dns",
    O.FLOWS + " SELECT seq, ts_us, src_ip, dst_port, dns_query, dns_query_type, 'C_INTERNET' AS qclass_name, 'dns' AS record_kind FROM fl WHERE dns_query IS NOT NULL",
)
def _(spark, d):
    return logs.normalize_lines(_lines(spark, d)["dns"], "dns").select(
        "seq", "ts_us", "src_ip", "dst_port", "dns_query", "dns_query_type", "qclass_name", "record_kind"
    )


@query(
    "normalize_ssl",
    O.FLOWS + " SELECT seq, ts_us, src_ip, dst_port, concat('h', CAST(seq % 97 AS VARCHAR), '.example') AS server_name, ja3_hash, 'ssl' AS record_kind FROM fl WHERE ja3_hash IS NOT NULL",
)
def _(spark, d):
    return logs.normalize_lines(_lines(spark, d)["ssl"], "ssl").select(
        "seq", "ts_us", "src_ip", "dst_port", "server_name", "ja3_hash", "record_kind"
    )


@query(
    "enrich_by_uid",
    O.FLOWS + """, lastq AS (SELECT flow_id, max_by(dns_query, seq) AS q, max_by(dns_query_type, seq) AS t, max_by(ja3_hash, seq) FILTER (WHERE ja3_hash IS NOT NULL) AS j FROM fl GROUP BY flow_id)
    SELECT seq, l.q AS dns_query, l.t AS dns_query_type, l.j AS ja3_hash FROM fl JOIN lastq l USING (flow_id)""",
)
def _(spark, d):
    parts = {k: logs.normalize_lines(v, k) for k, v in _lines(spark, d).items()}
    return norm.enrich_by_uid(parts["conn"], parts["dns"], parts["ssl"]).select("seq", "dns_query", "dns_query_type", "ja3_hash")


@query(
    "union_records",
    O.FLOWS + """ SELECT 'conn' AS record_kind, count(*) AS n FROM fl UNION ALL SELECT 'dns', count(dns_query) FROM fl
    UNION ALL SELECT 'ssl', count(ja3_hash) FROM fl""",
)
def _(spark, d):
    parts = {k: logs.normalize_lines(v, k) for k, v in _lines(spark, d).items()}
    return logs.correlated_records(**parts).groupBy("record_kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_zeek_logs",
    O.FLOWS + """ SELECT 'conn' AS kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS s FROM fl
    UNION ALL SELECT 'dns', count(*), CAST(sum(seq) AS BIGINT) FROM fl WHERE dns_query IS NOT NULL
    UNION ALL SELECT 'ssl', count(*), CAST(sum(seq) AS BIGINT) FROM fl WHERE ja3_hash IS NOT NULL""",
)
def _(spark, d):
    parts = [v.select(F.lit(k).alias("kind"), "seq") for k, v in _lines(spark, d).items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("s"))


@query(
    "emit_topics",
    O.FLOWS + """ SELECT 'traffic-flows' AS topic, seq, flow_id AS key FROM fl
    UNION ALL SELECT 'dns-queries', seq, flow_id FROM fl WHERE dns_query IS NOT NULL
    UNION ALL SELECT 'ssl-metadata', seq, flow_id FROM fl WHERE ja3_hash IS NOT NULL""",
)
def _(spark, d):
    parts = {k: logs.normalize_lines(v, k) for k, v in _lines(spark, d).items()}
    return topics.encode(norm.union_records(*parts.values())).select(
        "topic", F.get_json_object("value", "$.seq").cast("bigint").alias("seq"), "key"
    )


@query(
    "scan_kafka_topics",
    O.FLOWS + " SELECT 'traffic-flows' AS topic, seq, ts_us, flow_id, bytes_out, flags FROM fl",
)
def _(spark, d):
    return topics.decode(topics.encode(flows(spark, d))).select(
        "topic", "seq", "ts_us", "flow_id", "bytes_out", joined("flags").alias("flags")
    )


@query("json_encode_decode", O.ALERTS + " SELECT alert_id, details, fan AS fan_out_count, n AS detector_count FROM al")
def _(spark, d):
    a = archived_alerts(spark, d)
    schema = a.schema["evidence"].dataType
    back = F.from_json(F.to_json("evidence"), schema)
    return a.select("alert_id", back.alias("e")).select(
        "alert_id", "e.details", "e.fan_out_count", col("e.detector_count").cast("bigint").alias("detector_count")
    )


_TAG_NAMES = ["syn_flood.pcap", "c2-Beacon.pcap", "dga_malware.pcapng", "sample.pcap", "office.pcap", "recon_exfil.pcap"]


@query(
    "capture_catalog",
    """SELECT attack_tag, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'SYN Flood' WHEN 1 THEN 'C2 Beaconing'
    WHEN 2 THEN 'DGA & DNS Tunneling + Encrypted Malware' WHEN 3 THEN 'SYN Flood + C2 Beaconing' WHEN 4 THEN 'PCAP Forensic Capture'
    ELSE 'Recon Sweep + Data Exfiltration' END AS attack_tag FROM events) GROUP BY 1""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.element_at(F.array(*[F.lit(n) for n in _TAG_NAMES]), (col("event_id") % 6 + 1).cast("int"))
    files = e.select(
        F.concat(F.lit("/captures/"), name).alias("path"), col("event_id").alias("length"), col("ts").alias("modificationTime")
    )
    return captures.catalog(files).groupBy("attack_tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "capture_header_check",
    """SELECT coalesce(reason, 'accepted') AS verdict, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 6 THEN 'extension'
    WHEN event_id % 7 = 5 THEN 'header' WHEN event_id % 11 = 0 THEN 'too large' END AS reason FROM events) GROUP BY 1""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    heads = list(captures.MAGIC) + [captures.MAGIC_NG, "504B0304", "D4C3B2A1"]
    m = (col("event_id") % 7).cast("int")
    files = e.select(
        F.when(m == 6, "/x/a.txt").otherwise("/x/a.PCAP").alias("path"),
        F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), m + 1)).alias("content"),
        F.when(col("event_id") % 11 == 0, F.lit(captures.MAX_BYTES + 1)).otherwise(F.lit(100)).alias("length"),
    )
    checked = captures.check_headers(files)
    return checked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def flow_packets(spark, d) -> DataFrame:
    """Two packets each way for every flow record, in capture files of 1,000 records."""
    f = flows(spark, d)
    step = F.explode(F.sequence(F.lit(0), F.lit(3)))
    p = f.select(
        F.concat(F.lit("cap"), F.floor(col("seq") / 1000).cast("string"), F.lit(".pcap")).alias("file"),
        "*", step.alias("k"),
    )
    back = col("k") % 2 == 1
    swap = lambda x, y: F.when(back, col(y)).otherwise(col(x))
    return p.select(
        "file", ((col("seq") % 1000) * 4 + col("k")).alias("seq"), (col("ts_us") + col("k") * 1000).alias("ts_us"),
        swap("src_ip", "dst_ip").alias("src_ip"), swap("dst_ip", "src_ip").alias("dst_ip"),
        swap("src_port", "dst_port").alias("src_port"), swap("dst_port", "src_port").alias("dst_port"),
        col("protocol").alias("proto"), F.when(back, F.array(F.lit("ACK"))).otherwise(col("flags")).alias("flags"),
        (col("bytes_out") % 1400 + 40 + col("k")).alias("wire_len"),
        F.when(~back, col("dns_query")).alias("dns_query"),
        F.when(~back & col("ja3_hash").isNotNull(), F.concat(F.lit("h"), (col("seq") % 97).cast("string"))).alias("tls_sni"),
    )


_PACKETS_SQL = O.FLOWS + """, pk AS (
  SELECT concat('cap', CAST(seq // 1000 AS VARCHAR), '.pcap') AS file, flow_id, (seq % 1000) * 4 + k AS pseq,
    ts_us + k * 1000 AS pts, k % 2 = 1 AS back, bytes_out % 1400 + 40 + k AS wire, flags, dns_query, dns_query_type,
    CASE WHEN ja3_hash IS NOT NULL THEN concat('h', CAST(seq % 97 AS VARCHAR)) END AS sni
  FROM fl, (SELECT unnest(range(0, 4)) AS k)),
g AS (SELECT file, flow_id, arg_min(flags, pseq) = 'SYN' AS syn, arg_min(wire, pseq) AS w0, min(pseq) AS seq, arg_max(pts, pseq) AS ts_us,
    sum(CASE WHEN back THEN 0 ELSE wire END) AS o, sum(CASE WHEN back THEN wire ELSE 0 END) AS i,
    sum(CASE WHEN back THEN 0 ELSE 1 END) AS po, sum(CASE WHEN back THEN 1 ELSE 0 END) AS pi,
    arg_min(dns_query, pseq) AS dns_query, arg_min(sni, pseq) AS sni FROM pk GROUP BY file, flow_id)
"""


@query(
    "flows_from_packets",
    _PACKETS_SQL + """SELECT file, flow_id, seq, ts_us,
      CAST(o - CASE WHEN syn THEN w0 ELSE 0 END AS BIGINT) AS bytes_out, CAST(i + CASE WHEN syn THEN w0 ELSE 0 END AS BIGINT) AS bytes_in,
      CAST(po - CASE WHEN syn THEN 1 ELSE 0 END AS BIGINT) AS packets_out, CAST(pi + CASE WHEN syn THEN 1 ELSE 0 END AS BIGINT) AS packets_in,
      dns_query, CASE WHEN dns_query IS NOT NULL THEN 'A' END AS dns_query_type, sni AS server_name, md5(sni) AS ja3_hash,
      concat('C', substr(sha256(flow_id), 1, 16)) AS uid FROM g""",
)
def _(spark, d):
    return pk.flows_from_packets(flow_packets(spark, d)).select(
        "file", "flow_id", "seq", "ts_us", "bytes_out", "bytes_in", "packets_out", "packets_in",
        "dns_query", "dns_query_type", "server_name", "ja3_hash", "uid",
    )


@query(
    "replay_rebased",
    O.FLOWS + f" SELECT seq, CAST(ts_us + 1800000000000000 - (SELECT mx FROM {_MAX}) AS BIGINT) AS ts_us FROM fl",
)
def _(spark, d):
    return norm.rebase_time(flows(spark, d), 1800000000000000).select("seq", "ts_us")


@query("replay_tagged")
def _(spark, d):
    """Capture packets to flows to alerts through a pipeline of their own, tagged as replay."""
    replayed = pk.flows_from_packets(flow_packets(spark, d), source="replay")
    replayed = replayed.withColumn("seq", F.xxhash64("file", "flow_id"))
    return alert_pipeline(replayed.drop("file")).groupBy("source", "threat_class").agg(F.count(F.lit(1)).alias("n"))


# --- windows ---------------------------------------------------------------


def _w(sql: str) -> str:
    return O.WINDOWS + " " + sql


@query(
    "w10_source",
    _w(f"SELECT seq, s10_count, s10_syn, s10_bytes, s10_fan_out, {O.r('s10_count / 10.0', 2)} AS s10_pps, CAST(1 AS BIGINT) AS s10_sources FROM wf"),
)
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, det.source_window(f), ["src_ip"]).select(
        "seq", "s10_count", "s10_syn", "s10_bytes", "s10_fan_out",
        fn.rnd_small(col("s10_count") / 10, 2).alias("s10_pps"), "s10_sources",
    )


@query("w10_target", _w(f"SELECT seq, t10_count, t10_syn, t10_bytes, t10_sources, {O.r('t10_count / 10.0', 2)} AS t10_pps FROM wf"))
def _(spark, d):
    f = flows(spark, d).withColumn("target", fn.target_key(col("dst_ip"), col("dst_port")))
    return win.attach(f, det.target_window(f), ["target"]).select(
        "seq", "t10_count", "t10_syn", "t10_bytes", "t10_sources", fn.rnd_small(col("t10_count") / 10, 2).alias("t10_pps")
    )


@query("w60_recon", _w("SELECT seq, s60_probes, s60_ips, s60_ports FROM wf"))
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, det.probe_window(f, count=True), ["src_ip"]).select("seq", "s60_probes", "s60_ips", "s60_ports")


def dns_window(f: DataFrame) -> DataFrame:
    """60 s window of the queries of each source; port-53 records without a name count too."""
    q = F.nullif(col("dns_query"), F.lit(""))
    named = f.filter(q.isNotNull() | (col("dst_port") == 53)).withColumn("domain", F.coalesce(q, F.lit("unknown.domain")))
    named = named.withColumn("h", fn.shannon_entropy(col("domain")))
    units = F.round(col("h") * 10000).cast("bigint")  # entropies have four decimals: exact sums
    keys = {"src_ip": col("src_ip")}
    counts = win.sliding_features(
        named, keys, 60, sums={"query_count": F.lit(1)},
        distincts={
            "domain": (
                col("domain"),
                {"unique_domains": 1, "_units": units, "high_entropy_domains": (col("h") >= 3.8).cast("bigint")},
            )
        },
    )
    peak = win.sliding_max(named, keys, 60, col("h"), "max_entropy")
    out = win.attach(win.attach(named, counts, ["src_ip"]), peak, ["src_ip"])
    mean = fn.rnd_small(col("_units") / 10000 / col("unique_domains"), 4)
    return out.withColumn("avg_entropy", mean).drop("_units")


@query(
    "w60_dns",
    O.FLOWS + f""", q AS (SELECT *, {O.entropy('dns_query')} AS h FROM fl WHERE dns_query IS NOT NULL OR dst_port = 53),
    q2 AS (SELECT *, count(*) OVER w AS query_count, count(DISTINCT dns_query) OVER w AS unique_domains, max(h) OVER w AS max_entropy,
      list_distinct(list({{'d': dns_query, 'h': h}}) OVER w) AS ds FROM q WINDOW w AS {O.frame('src_ip', 60)})
    SELECT seq, query_count, unique_domains, {O.r("list_sum(list_transform(ds, lambda x: x.h)) / len(ds)", 4)} AS avg_entropy, max_entropy,
      CAST(len(list_filter(ds, lambda x: x.h >= 3.8)) AS BIGINT) AS high_entropy_domains FROM q2""",
)
def _(spark, d):
    return dns_window(flows(spark, d)).select(
        "seq", "query_count", "unique_domains", "avg_entropy", "max_entropy", "high_entropy_domains"
    )


@query("w300_flow", _w("SELECT seq, f300_count, f300_bytes_out, f300_bytes_in, f300_byte_ratio, iat_variance, CAST(0 AS BIGINT) + (SELECT 0) + (CASE WHEN ja3_hash IS NULL THEN 0 ELSE 1 END) AS own_ja3 FROM wf"))
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, flow_window(f), ["flow_id"]).select(
        "seq", "f300_count", "f300_bytes_out", "f300_bytes_in", "f300_byte_ratio", "iat_variance",
        F.when(col("ja3_hash").isNull(), 0).otherwise(1).cast("bigint").alias("own_ja3"),
    )


@query(
    "w300_ja3",
    O.FLOWS + f" SELECT seq, count(DISTINCT ja3_hash) OVER {O.frame('flow_id', 300)} AS ja3_count FROM fl",
)
def _(spark, d):
    f = flows(spark, d)
    w = win.sliding_features(f, {"flow_id": col("flow_id")}, 300, distincts={"ja3": (F.nullif("ja3_hash", F.lit("")), {"ja3_count": 1})})
    return win.attach(f, w, ["flow_id"]).select("seq", "ja3_count")


@query("iat_stats", _w(f"SELECT seq, f300_count AS n, {O.r('iat_mean', 4)} AS iat_mean, iat_variance, {O.r('iat_stddev', 4)} AS iat_stddev FROM wf"))
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, flow_window(f), ["flow_id"]).select(
        "seq", col("f300_count").alias("n"), fn.rnd(col("iat_mean"), 4).alias("iat_mean"), "iat_variance",
        fn.rnd(col("iat_stddev"), 4).alias("iat_stddev"),
    )


@query("iat_autocorr", _w("SELECT seq, iat_autocorr FROM wf"))
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, flow_window(f), ["flow_id"]).select("seq", "iat_autocorr")


@query("iat_concentration", _w("SELECT seq, iat_concentration FROM wf"))
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, flow_window(f), ["flow_id"]).select("seq", "iat_concentration")


@query("timestamp_entropy", _w("SELECT seq, stamp_entropy FROM wf"))
def _(spark, d):
    f = flows(spark, d)
    return win.attach(f, flow_window(f), ["flow_id"]).select("seq", "stamp_entropy")


@query(
    "sliding_distinct",
    O.FLOWS + f" SELECT seq, count(DISTINCT src_ip) OVER {O.frame('dst_ip', 60)} AS sources, count(DISTINCT src_port) OVER {O.frame('dst_ip', 60)} AS ports FROM fl",
)
def _(spark, d):
    f = flows(spark, d)
    w = win.sliding_features(
        f, {"dst_ip": col("dst_ip")}, 60,
        distincts={"s": (col("src_ip"), {"sources": 1}), "p": (col("src_port"), {"ports": 1})},
    )
    return win.attach(f, w, ["dst_ip"]).select("seq", "sources", "ports")


@query(
    "window_arrival_order",
    O.FLOWS + """, z AS (SELECT seq, src_ip, dst_port, ts_us - ts_us % 2000000 AS ts_us FROM fl),
    y AS (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)
      - (count(*) OVER (PARTITION BY src_ip, ts_us) - row_number() OVER (PARTITION BY src_ip, ts_us ORDER BY seq)) AS n FROM z)
    SELECT seq, CAST(n AS BIGINT) AS n FROM y""",
)
def _(spark, d):
    """Stamps cut to two seconds, so that many records tie; each sees only earlier arrivals."""
    f = flows(spark, d).withColumn("ts_us", col("ts_us") - col("ts_us") % 2000000)
    w = win.sliding_features(f, {"src_ip": col("src_ip")}, 10, sums={"n": F.lit(1)}, tie="arrival")
    return win.attach(f, w, ["src_ip"], "arrival").select("seq", "n")


@query(
    "window_append_evict",
    O.FLOWS + f" SELECT src_ip, count(*) AS held FROM fl, {_MAX} WHERE ts_us BETWEEN mx - 60000000 AND mx GROUP BY src_ip",
)
def _(spark, d):
    f = flows(spark, d)
    last = f.agg(F.max("ts_us").alias("mx"))
    held = f.crossJoin(F.broadcast(last)).filter(col("ts_us").between(col("mx") - 60000000, col("mx")))
    return held.groupBy("src_ip").agg(F.count(F.lit(1)).alias("held"))


@query(
    "window_lookup",
    O.FLOWS + f" SELECT seq, ts_us, dst_ip FROM fl WHERE src_ip = '10.42.9.88' AND ts_us BETWEEN {BASE_US + 40000000} AND {BASE_US + 100000000}",
)
def _(spark, d):
    return win.window_lookup(flows(spark, d), col("src_ip"), "10.42.9.88", BASE_US + 100000000, 60).select("seq", "ts_us", "dst_ip")


@query(
    "target_or_source_window",
    _w("SELECT seq, CASE WHEN seq % 2 = 0 THEN t10_count ELSE s10_count END AS packet_count FROM wf"),
)
def _(spark, d):
    """Half of the records have no target window, so the source window stands in."""
    f = flows(spark, d).withColumn("target", fn.target_key(col("dst_ip"), col("dst_port")))
    both = win.attach(win.attach(f, det.target_window(f), ["target"]), det.source_window(f), ["src_ip"])
    target = F.when(col("seq") % 2 == 0, col("t10_count")).otherwise(0)
    return both.select("seq", F.when(target > 0, target).otherwise(col("s10_count")).alias("packet_count"))


@query(
    "adaptive_baseline",
    O.FLOWS + f""", x AS (SELECT concat('target:', dst_ip, ':', CAST(dst_port AS VARCHAR)) AS key,
      list_prepend({{'m': CAST(50.0 AS DOUBLE), 's': CAST(30.0 AS DOUBLE)}},
        list({{'m': CAST(greatest(packets_in, packets_out) AS DOUBLE), 's': CAST(0.0 AS DOUBLE)}} ORDER BY ts_us, seq)) AS l, count(*) AS n FROM fl GROUP BY 1),
    y AS (SELECT key, n, list_reduce(l, lambda a, v: CASE WHEN v.m < a.m * 2.5 THEN {{'m': a.m + CAST(0.02 AS DOUBLE) * (v.m - a.m),
      's': greatest(CAST(1.0 AS DOUBLE), sqrt(a.s * a.s * CAST(0.98 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (v.m - a.m) * (v.m - a.m)))}} ELSE a END) AS st FROM x)
    SELECT key, {O.r("st.m", 4)} AS ema_mean, {O.r("st.s", 4)} AS ema_std, n FROM y""",
)
def _(spark, d):
    key = fn.target_key(col("dst_ip"), col("dst_port"))
    b = base.adaptive_baseline(flows(spark, d), key, F.greatest("packets_in", "packets_out"))
    return b.select("key", fn.rnd(col("ema_mean"), 4).alias("ema_mean"), fn.rnd(col("ema_std"), 4).alias("ema_std"), "n")


# --- thresholds ------------------------------------------------------------

_OVERRIDES = [
    ("ddos.sigma_threshold", "20"), ("beaconing.min_heartbeats", "50"), ("dns.entropy_threshold", "99"),
    ("recon.unknown", "3"), ("malware.tls_ports", "443, 9443"), ("exfiltration.min_egress_bytes", "1.5"),
    ("reconnaissance.max_probe_bytes", "true"),
]


def overridden(spark) -> DataFrame:
    o = spark.createDataFrame(_OVERRIDES, "key string, value string")
    return thr.effective_thresholds(thr.spec_table(spark), o)


@query(
    "threshold_overrides",
    "SELECT t.key, t.value, count(*) AS events FROM events, (VALUES ('ddos.sigma_threshold', '20.0'), ('beaconing.min_heartbeats', '50'), ('malware.tls_ports', '443,9443')) AS t(key, value) GROUP BY t.key, t.value",
)
def _(spark, d):
    """Accepted overrides, with the number of events they apply to."""
    events = spark.read.parquet(f"{d}/events.parquet").agg(F.count(F.lit(1)).alias("events"))
    return thr.modified_thresholds(overridden(spark)).crossJoin(F.broadcast(events))


@query("apply_thresholds", O.WINDOWS + ", dx AS (SELECT *, greatest(packets_in, packets_out, t10_count / 10.0) AS pps FROM wf) "
       f"SELECT seq FROM dx WHERE packets_in > packets_out AND (({O.SYN} AND packets_in >= 300) OR ({O.SYN} AND (t10_syn + 1.0) / t10_count >= 0.85 AND pps >= 100) OR (pps >= 100 AND (pps - 50.0) / 30.0 >= 20))")
def _(spark, d):
    """Sigma raised to 20 by a table read at run time: weak surges fall silent."""
    f = thr.apply_thresholds(flows(spark, d), thr.thresholds_row(overridden(spark)))
    f = f.withColumn("target", fn.target_key(col("dst_ip"), col("dst_port")))
    full = win.attach(f, det.target_window(f), ["target"])
    return det.detect_one(full, det.ddos, thr.Thresholds(from_columns=True)).select("seq")


@query(
    "thresholds_asof",
    O.FLOWS + f", {_MAX[1:-1].replace('SELECT', 'mm AS (SELECT')}) SELECT seq, CASE WHEN ts_us >= {BASE_US + 200000000} THEN 20.0 WHEN ts_us >= {BASE_US + 50000000} THEN 5.0 ELSE 3.0 END AS sigma FROM fl",
)
def _(spark, d):
    changes = spark.createDataFrame([(BASE_US + 50000000, "5"), (BASE_US + 200000000, "20")], "effective_us bigint, value string")
    return thr.thresholds_asof(flows(spark, d), changes, "ddos.sigma_threshold", "sigma").select("seq", "sigma")


# --- detectors -------------------------------------------------------------

_CAND_COLS = {
    "confidence": "conf", "inter_arrival_variance": "var", "shannon_entropy": "ent", "byte_ratio": "br", "fan_out_count": "fan",
    "ja3_hash": "ja3", "inbound_connections": "inb", "outbound_connections": "outb", "port_connections": "ports",
    "unique_source_count": "sources", "total_uploaded_bytes": "upload", "unique_destination_hosts": "hosts", "window_60s_fan_out": "f60",
}


def _candidate_columns(df: DataFrame) -> DataFrame:
    c = col("candidate")
    return df.select("seq", *[c[k].alias(k) for k in _CAND_COLS], fn.rnd(c["z_score"], 4).alias("z_score"), c["details"].alias("details"))


def _candidate_sql(ctes: list[str], name: str) -> str:
    picked = ", ".join(f"{v} AS {k}" for k, v in _CAND_COLS.items())
    return ", ".join(ctes) + f" SELECT seq, {picked}, {O.r('z', 4)} AS z_score, details FROM {name}"


@query("detect_ddos", _candidate_sql([O.WINDOWS, O.DDOS_SQL], "c_ddos"))
def _(spark, d):
    f = flows(spark, d).withColumn("target", fn.target_key(col("dst_ip"), col("dst_port")))
    return _candidate_columns(det.detect_one(win.attach(f, det.target_window(f), ["target"]), det.ddos))


@query("detect_beacon", _candidate_sql([O.WINDOWS, O.BEACON_SQL], "c_beacon"))
def _(spark, d):
    f = flows(spark, d)
    return _candidate_columns(det.detect_one(win.attach(f, flow_window(f), ["flow_id"]), det.beacon))


@query("detect_dns", _candidate_sql([O.FLOWS, O.DNS_SQL], "c_dns"))
def _(spark, d):
    return _candidate_columns(det.detect_one(flows(spark, d).select("*", *det.dns_lexical()), det.dns))


@query("detect_malware", _candidate_sql([O.FLOWS, O.MALWARE_SQL], "c_malware"))
def _(spark, d):
    return _candidate_columns(det.detect_one(det.signature_match(flows(spark, d)), det.malware))


@query("detect_recon", _candidate_sql([O.WINDOWS, O.RECON_SQL], "c_recon"))
def _(spark, d):
    f, th = flows(spark, d), thr.Thresholds()
    probes = det.probe_profile(th)
    full = win.attach(win.attach(f, det.source_fan_out(f, wanted=probes), ["src_ip"]), det.probe_window(f, wanted=probes), ["src_ip"])
    return _candidate_columns(det.detect_one(full, det.recon))


@query("detect_exfil", _candidate_sql([O.WINDOWS, O.EXFIL_SQL], "c_exfil"))
def _(spark, d):
    f = flows(spark, d)
    return _candidate_columns(det.detect_one(win.attach(f, flow_window(f), ["flow_id"]), det.exfil))


@query("signature_match", O.FLOWS + f", m AS (SELECT seq, {O._FAMILY} AS family FROM fl) SELECT seq, family FROM m WHERE family IS NOT NULL")
def _(spark, d):
    return det.signature_match(flows(spark, d)).filter("family IS NOT NULL").select("seq", "family")


@query("detail_text", O.CANDIDATES + " SELECT seq, threat_class, details FROM cands")
def _(spark, d):
    found = candidate_records(flows(spark, d)).select("seq", F.explode("candidates").alias("c"))
    return found.select("seq", "c.threat_class", "c.details")


@query("combine_candidates", O.CANDIDATES + " SELECT seq, threat_class, conf AS confidence FROM cands")
def _(spark, d):
    found = candidate_records(flows(spark, d)).select("seq", F.explode("candidates").alias("c"))
    return found.select("seq", "c.threat_class", "c.confidence")


@query(
    "detector_counts",
    O.CANDIDATES + """, p AS (SELECT seq, string_agg(threat_class, ',' ORDER BY threat_class) AS detectors_fired, CAST(count(*) AS INTEGER) AS detector_count
    FROM cands GROUP BY seq) SELECT detectors_fired, detector_count, count(*) AS records FROM p GROUP BY 1, 2""",
)
def _(spark, d):
    return an.detector_counts(candidate_records(flows(spark, d)))


# --- alerts ----------------------------------------------------------------


def _a(sql: str) -> str:
    return O.ALERTS + " " + sql


@query(
    "alert_pipeline",
    _a("SELECT alert_id, seq, ts_us, flow_id, source_ip, threat_class, confidence_score, severity, incident_id, details FROM al"),
)
def _(spark, d):
    return alert_pipeline(flows(spark, d)).select(
        "alert_id", "seq", "ts_us", "flow_id", "source_ip", "threat_class", "confidence_score", "severity", "incident_id",
        col("evidence.details").alias("details"),
    )


@query(
    "alert_counts_by_class",
    _a("SELECT threat_class, severity, count(*) AS n FROM al GROUP BY threat_class, severity"),
)
def _(spark, d):
    return alert_pipeline(flows(spark, d)).groupBy("threat_class", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("corroboration_bonus", _a("SELECT alert_id, n AS detector_count, corr AS bonus FROM al"))
def _(spark, d):
    n = col("evidence.detector_count").cast("bigint")
    return archived_alerts(spark, d).select("alert_id", n.alias("detector_count"), al.corroboration_bonus(n).alias("bonus"))


@query("incident_session", _a("SELECT seq, incident_id FROM al GROUP BY seq, incident_id"))
def _(spark, d):
    return archived_alerts(spark, d).select("seq", "incident_id").distinct()


@query("attack_chain", _a("SELECT seq, threat_class, CASE WHEN stages > 1 THEN chain_text END AS chain_text FROM al"))
def _(spark, d):
    text = F.regexp_extract("evidence.details", r"^\[Attack Chain: ([^\]]*)\]", 1)
    return archived_alerts(spark, d).select("seq", "threat_class", F.nullif(text, F.lit("")).alias("chain_text"))


@query("final_confidence", _a("SELECT alert_id, confidence_score FROM al"))
def _(spark, d):
    return archived_alerts(spark, d).select("alert_id", "confidence_score")


@query("alert_identity", _a("SELECT seq, threat_class, alert_id AS identity FROM al"))
def _(spark, d):
    ident = al.alert_identity(col("alert_id"), col("flow_id"), col("timestamp"), col("threat_class"))
    return archived_alerts(spark, d).select("seq", "threat_class", ident.alias("identity"))


@query(
    "evidence_projection",
    _a(f"""SELECT alert_id, var AS inter_arrival_variance, ent AS shannon_entropy, br AS byte_ratio, fan AS fan_out_count, ja3 AS ja3_hash,
    {O.r('z', 4)} AS z_score, {O.r('period', 4)} AS beacon_period_seconds, {O.r('std', 4)} AS inter_arrival_stddev, conc AS fft_concentration,
    ngram AS ngram_score, dns_query, CAST(length(dns_query) AS DOUBLE) AS dns_query_length, packets_in, bytes_out AS outbound_bytes, fired AS detectors_fired,
    CAST(win AS DOUBLE) AS observation_window_seconds, concat(CAST(n AS VARCHAR), ' detectors corroborated (+', printf('%.2f', corr),
    '); Attack chain stages: ', CAST(stages AS VARCHAR), ' (+', printf('%.2f', chain), ')') AS confidence_basis FROM al"""),
)
def _(spark, d):
    e = col("evidence")
    plain = ["inter_arrival_variance", "shannon_entropy", "byte_ratio", "fan_out_count", "ja3_hash", "fft_concentration", "ngram_score",
             "dns_query", "packets_in", "outbound_bytes", "confidence_basis"]
    rounded = ["z_score", "beacon_period_seconds", "inter_arrival_stddev"]
    return archived_alerts(spark, d).select(
        "alert_id", *[e[c].alias(c) for c in plain], *[fn.rnd(e[c], 4).alias(c) for c in rounded],
        *[e[c].cast("double").alias(c) for c in ("dns_query_length", "observation_window_seconds")], joined(e["detectors_fired"]).alias("detectors_fired"),
    )


@query(
    "dedup_alerts",
    _a("SELECT flow_id, threat_class, CAST(max(ts_us) AS BIGINT) AS ts_us, arg_max(alert_id, (ts_us - 1704000000000000) * 1000000 + seq) AS alert_id FROM al GROUP BY flow_id, threat_class"),
)
def _(spark, d):
    """The newest alert of each flow and class (a coarse identity that really repeats)."""
    ident = F.concat_ws("|", "flow_id", "threat_class")
    return al.dedup(archived_alerts(spark, d), ident).select("flow_id", "threat_class", "ts_us", "alert_id")


@query("processing_latency", _a(f"SELECT alert_id, {O.r('(1704100000000000 - ts_us) / 1000.0', 3)} AS processing_latency_ms FROM al".replace("(1704100000000000 - ts_us) / 1000.0", "greatest(0, 1704100000000000 - ts_us) / 1000.0")))
def _(spark, d):
    return al.with_latency(archived_alerts(spark, d), F.timestamp_micros(F.lit(1704100000000000))).select("alert_id", "processing_latency_ms")


# suppression rules shared with the SQL: id, seq, type, criterion source / destination, class, enabled, expiry
_RULE_ROWS = [
    ("r1", 1, "source_ip", "203.0.113.8/29", None, None, True, None),
    ("r2", 2, "destination_ip", None, "198.51.100.77", None, True, None),
    ("r3", 3, "source_ip_threat_class", "10.42.0.0/16", None, S.RECON, True, None),
    ("r4", 4, "source_ip", "192.168.1.150", None, None, False, None),
    ("r5", 5, "source_ip", "10.24.0.0/13", None, None, True, "2024-01-01 00:00:00"),
    ("r6", 6, "source_ip_threat_class", "10.24.3.77/24", None, None, True, "2030-01-01 00:00:00"),
]
RULES_AS_OF = "2024-06-01 00:00:00"


def rules(spark) -> DataFrame:
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in _RULE_ROWS]
    return spark.createDataFrame(
        rows, "id string, rule_seq bigint, rule_type string, source_ip string, destination_ip string, threat_class string, enabled boolean, expires_at string"
    ).select(
        "id", "rule_seq", "rule_type", F.lit("desk rule").alias("description"), "source_ip", "destination_ip", "threat_class", "enabled",
        F.timestamp_micros(col("rule_seq") * 1000000).alias("created_at"), F.timestamp_micros(col("rule_seq") * 1000000).alias("updated_at"),
        col("expires_at").cast("timestamp").alias("expires_at"),
    )


_SUPPRESS_SQL = f""", sp AS (SELECT *, CASE
    WHEN source_ip LIKE '203.0.113.%' AND CAST(split_part(source_ip, '.', 4) AS INTEGER) BETWEEN 8 AND 15 THEN 'r1'
    WHEN destination_ip = '198.51.100.77' THEN 'r2'
    WHEN source_ip LIKE '10.42.%' AND threat_class = '{S.RECON}' THEN 'r3'
    WHEN source_ip LIKE '10.24.3.%' THEN 'r6' END AS rule FROM al) """


def suppressed_alerts(spark, d, table: DataFrame | None = None) -> DataFrame:
    return sup.mark_suppressed(archived_alerts(spark, d), rules(spark) if table is None else table, F.lit(RULES_AS_OF).cast("timestamp"))


@query("suppression_match", O.ALERTS + _SUPPRESS_SQL + "SELECT alert_id, rule AS suppression_rule_id FROM sp WHERE rule IS NOT NULL")
def _(spark, d):
    return suppressed_alerts(spark, d).filter("suppressed").select("alert_id", "suppression_rule_id")


@query("suppression_match_many_rules", O.ALERTS + _SUPPRESS_SQL + "SELECT alert_id, rule AS suppression_rule_id FROM sp WHERE rule IS NOT NULL")
def _(spark, d):
    """Thousands of rules for other networks, some with the rank of a rule that matches, change nothing."""
    known = rules(spark)
    n = F.explode(F.sequence(F.lit(0), F.lit(2999)))
    other = known.filter("id = 'r1'").withColumn("n", n).withColumns({
        "id": F.concat(F.lit("x"), "n"), "rule_seq": (col("rule_seq") + col("n") % 2000).cast(known.schema["rule_seq"].dataType),
        "source_ip": F.format_string("240.%d.%d.0/%d", F.floor(col("n") / 250), col("n") % 250, 24 + col("n") % 9),
    })
    table = known.unionByName(other.select(known.columns))
    return suppressed_alerts(spark, d, table).filter("suppressed").select("alert_id", "suppression_rule_id")


@query("mark_suppressed", O.ALERTS + _SUPPRESS_SQL + "SELECT threat_class, rule IS NOT NULL AS suppressed, count(*) AS n FROM sp GROUP BY 1, 2")
def _(spark, d):
    return suppressed_alerts(spark, d).groupBy("threat_class", "suppressed").agg(F.count(F.lit(1)).alias("n"))


@query("alert_delivery", O.ALERTS + _SUPPRESS_SQL + "SELECT alert_id, severity FROM sp WHERE rule IS NULL")
def _(spark, d):
    return sup.deliverable(suppressed_alerts(spark, d)).select("alert_id", "severity")


@query(
    "rules_newest_first",
    O.ALERTS + _SUPPRESS_SQL + ", u AS (SELECT unnest(['r1','r2','r3','r4','r5','r6']) AS id) SELECT id, CAST(substr(id, 2) AS BIGINT) AS rule_seq, "
    "(SELECT count(*) FROM sp WHERE rule = id) AS hits FROM u ORDER BY rule_seq DESC",
)
def _(spark, d):
    hits = suppressed_alerts(spark, d).groupBy("suppression_rule_id").agg(F.count(F.lit(1)).alias("hits"))
    ordered = rules(spark).join(hits, col("id") == col("suppression_rule_id"), "left")
    return sup.newest_first(ordered).select("id", "rule_seq", F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"))


@query(
    "validate_rules",
    O.FLOWS + """ SELECT rule_type, valid, count(*) AS n FROM (SELECT CASE seq % 3 WHEN 0 THEN 'source_ip' WHEN 1 THEN 'destination_ip' ELSE 'source_ip_threat_class' END AS rule_type,
      CASE seq % 3 WHEN 1 THEN FALSE ELSE seq % 5 <> 0 END AS valid FROM fl) GROUP BY 1, 2""",
)
def _(spark, d):
    """One draft rule per flow: every fifth has a malformed block, destination rules lack their address."""
    m = col("seq") % 3
    drafts = flows(spark, d).select(
        col("seq").cast("string").alias("id"), col("seq").alias("rule_seq"),
        F.when(m == 0, "source_ip").when(m == 1, "destination_ip").otherwise("source_ip_threat_class").alias("rule_type"),
        F.lit("draft").alias("description"),
        F.concat(col("src_ip"), F.when(col("seq") % 5 == 0, "/33").otherwise("/24")).alias("source_ip"),
        F.lit(None).cast("string").alias("destination_ip"), F.lit(S.RECON).alias("threat_class"),
    )
    return sup.validate_rules(drafts).groupBy("rule_type", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_alerts",
    _a("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN seq % 5 = 1 THEN 'confidence out of range' WHEN seq % 5 = 2 THEN 'unknown status'
    WHEN seq % 5 = 3 THEN 'port out of range' ELSE 'valid' END AS reason FROM al) GROUP BY 1"""),
)
def _(spark, d):
    m = col("seq") % 5
    broken = (
        archived_alerts(spark, d)
        .withColumn("confidence_score", F.when(m == 1, 1.5).otherwise(col("confidence_score")))
        .withColumn("status", F.when(m == 2, "lost").otherwise(col("status")))
        .withColumn("source_port", F.when(m == 3, 70000).otherwise(col("source_port")))
    )
    return tri.validate_alerts(broken).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- status, notes ---------------------------------------------------------


def status_changes(spark, d) -> DataFrame:
    """Two changes for every flow whose id falls on a multiple of three; the later one wins."""
    f = flows(spark, d).filter("seq % 3 = 0")
    first = f.select("flow_id", F.lit("acknowledged").alias("status"), F.timestamp_micros("ts_us").alias("changed_at"))
    second = f.filter("seq % 2 = 0").select(
        "flow_id", F.lit("resolved").alias("status"), F.timestamp_micros(col("ts_us") + 1).alias("changed_at")
    )
    return first.unionByName(second)


_STATUS_SQL = """, ch AS (SELECT flow_id, ts_us AS chg, 'acknowledged' AS status FROM fl WHERE seq % 3 = 0
  UNION ALL SELECT flow_id, ts_us + 1, 'resolved' FROM fl WHERE seq % 3 = 0 AND seq % 2 = 0),
ls AS (SELECT flow_id, arg_max(status, chg) AS status FROM ch GROUP BY flow_id),
als AS (SELECT al.*, coalesce(ls.status, 'new') AS status FROM al LEFT JOIN ls USING (flow_id)) """


@query("latest_status", O.ALERTS + _STATUS_SQL + "SELECT alert_id, status FROM als")
def _(spark, d):
    return life.latest_status(archived_alerts(spark, d), status_changes(spark, d)).select("alert_id", "status")


@query("alert_filter_status", O.ALERTS + _STATUS_SQL + "SELECT alert_id FROM als WHERE status = 'resolved'")
def _(spark, d):
    return tri.by_status(life.latest_status(archived_alerts(spark, d), status_changes(spark, d)), "resolved").select("alert_id")


def notes(spark, d) -> DataFrame:
    f = flows(spark, d).filter("seq % 4 = 0")
    return f.select(
        "flow_id", F.concat(F.lit("note "), col("seq").cast("string")).alias("text"), F.timestamp_micros(col("ts_us")).alias("created_at")
    )


@query(
    "read_notes",
    O.FLOWS + " SELECT concat('note ', CAST(seq AS VARCHAR)) AS text, ts_us FROM fl WHERE seq % 4 = 0 AND flow_id = '192.168.1.150:49500->198.51.100.77:8443' ORDER BY ts_us",
)
def _(spark, d):
    return life.notes_of(notes(spark, d), "192.168.1.150:49500->198.51.100.77:8443").select("text", F.unix_micros("created_at").alias("ts_us"))


@query(
    "alerts_with_notes",
    O.ALERTS + """, nt AS (SELECT flow_id, string_agg(concat('note ', CAST(seq AS VARCHAR)), ',' ORDER BY ts_us) AS notes FROM fl WHERE seq % 4 = 0 GROUP BY flow_id)
    SELECT alert_id, coalesce(notes, '') AS notes FROM al LEFT JOIN nt USING (flow_id)""",
)
def _(spark, d):
    texts = lambda notes: joined(F.transform(notes, lambda n: n["text"]))
    return life.alerts_with_notes(archived_alerts(spark, d), notes(spark, d), texts).select("alert_id", "notes")


# --- triage ----------------------------------------------------------------


@query("alert_filter_class", _a(f"SELECT alert_id FROM al WHERE threat_class = '{S.BEACON}'"))
def _(spark, d):
    return tri.by_class(archived_alerts(spark, d), S.BEACON).select("alert_id")


@query("alert_filter_severity", _a("SELECT alert_id FROM al WHERE severity = 'high'"))
def _(spark, d):
    return tri.by_severity(archived_alerts(spark, d), "high").select("alert_id")


@query("alert_filter_confidence", _a("SELECT alert_id FROM al WHERE confidence_score >= 0.97"))
def _(spark, d):
    return tri.by_confidence(archived_alerts(spark, d), 0.97).select("alert_id")


@query("alert_filter_time", _a(f"SELECT alert_id FROM al WHERE abs(ts_us - {BASE_US + 60000000}) <= 5000000"))
def _(spark, d):
    return tri.near(archived_alerts(spark, d), BASE_US + 60000000).select("alert_id")


@query("alert_search", _a("SELECT alert_id FROM al WHERE lower(concat(flow_id, '|', threat_class, '|', details, '|', source_ip, '|', destination_ip)) LIKE '%qakbot%'"))
def _(spark, d):
    return tri.search(archived_alerts(spark, d), " QakBot ").select("alert_id")


@query("threat_alias_match", _a(f"SELECT alert_id FROM al WHERE threat_class = '{S.DGA}'"))
def _(spark, d):
    return tri.by_class_alias(archived_alerts(spark, d), "DGA & DNS Tunneling").select("alert_id")


_SHORT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SHORT_NAMES.items())


@query("short_threat_name", _a(f"SELECT CASE threat_class {_SHORT} END AS name, count(*) AS n FROM al GROUP BY 1"))
def _(spark, d):
    return archived_alerts(spark, d).groupBy(tri.short_name(col("threat_class")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "evidence_tags",
    _a("""SELECT alert_id, array_to_string(list_filter([CASE WHEN ja3 IS NOT NULL THEN 'TLS' END, CASE WHEN conc IS NOT NULL THEN 'FFT' END,
    CASE WHEN dns_query IS NOT NULL OR ngram IS NOT NULL THEN 'DNS' END, CASE WHEN z IS NOT NULL THEN 'Z-SCORE' END,
    CASE WHEN hosts IS NOT NULL THEN 'FAN-OUT' END, CASE WHEN upload IS NOT NULL THEN 'EGRESS' END], lambda x: x IS NOT NULL), ',') AS tags FROM al"""),
)
def _(spark, d):
    return archived_alerts(spark, d).select("alert_id", joined(tri.evidence_tags(col("evidence"))).alias("tags"))


@query("direction_ratio", _a(f"SELECT alert_id, concat('1:', printf('%.1f', {O.r('CAST(bytes_out AS DOUBLE) / greatest(bytes_in, 1)', 1)})) AS ratio FROM al"))
def _(spark, d):
    return archived_alerts(spark, d).select("alert_id", tri.direction_ratio(col("evidence")).alias("ratio"))


@query(
    "latency_band",
    _a("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN seq % 4 = 0 THEN 'UNAVAILABLE' WHEN seq % 150 <= 10 THEN 'WITHIN NORMAL'
    WHEN seq % 150 <= 100 THEN 'ELEVATED' ELSE 'DEGRADED' END AS band FROM al) GROUP BY 1"""),
)
def _(spark, d):
    ms = F.when(col("seq") % 4 != 0, (col("seq") % 150).cast("double"))
    return archived_alerts(spark, d).groupBy(tri.latency_band(ms).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# --- analytics -------------------------------------------------------------

_CLASS_COUNTS = ", ".join(f"count(*) FILTER (WHERE threat_class = '{c}') AS \"{c}\"" for c in S.THREAT_CLASSES)
_CLASS_ZERO = ", ".join(f"coalesce(\"{c}\", 0) AS \"{c}\"" for c in S.THREAT_CLASSES)
_AS_OF_60 = BASE_US + 1800 * 1000000


@query(
    "trends",
    O.ALERTS + f""", st AS (SELECT CAST(floor(({_AS_OF_60} - 3600000000) / 300000000.0) AS BIGINT) * 300000000 AS s),
    cc AS (SELECT CAST((ts_us - s) // 300000000 AS BIGINT) AS point, {_CLASS_COUNTS} FROM al, st WHERE ts_us >= s GROUP BY 1),
    gr AS (SELECT unnest(range(0, 13)) AS point)
    SELECT CAST(s + point * 300000000 AS BIGINT) AS bucket_us, {_CLASS_ZERO} FROM gr JOIN st ON TRUE LEFT JOIN cc USING (point)""",
)
def _(spark, d):
    return an.trends(archived_alerts(spark, d), _AS_OF_60)


@query(
    "sliding_trend",
    O.ALERTS + f""", cc AS (SELECT CAST((ts_us - {_AS_OF_60 - 300000000}) // 5000000 AS BIGINT) AS point, {_CLASS_COUNTS} FROM al
      WHERE ts_us BETWEEN {_AS_OF_60 - 300000000} AND {_AS_OF_60} GROUP BY 1),
    gr AS (SELECT unnest(range(0, 60)) AS point)
    SELECT CAST({_AS_OF_60 - 300000000} + point * 5000000 AS BIGINT) AS bucket_us, {_CLASS_ZERO} FROM gr LEFT JOIN cc USING (point)""",
)
def _(spark, d):
    return an.sliding_trend(archived_alerts(spark, d), _AS_OF_60)


@query(
    "incidents",
    _a("""SELECT incident_id, min(source_ip) AS source_ip, CAST(min(ts_us) AS BIGINT) AS first_seen_us, CAST(max(ts_us) AS BIGINT) AS last_seen_us,
    array_to_string(list_sort(list_distinct(list(threat_class))), ',') AS threat_classes, count(*) AS alert_count FROM al GROUP BY incident_id"""),
)
def _(spark, d):
    return an.incidents(archived_alerts(spark, d)).withColumn("threat_classes", joined("threat_classes"))


@query(
    "incidents_recent",
    _a("SELECT incident_id, CAST(max(ts_us) AS BIGINT) AS last_seen_us, count(*) AS alert_count FROM al GROUP BY incident_id ORDER BY 2 DESC, 1 LIMIT 100"),
)
def _(spark, d):
    return an.incidents(archived_alerts(spark, d), limit=100).select("incident_id", "last_seen_us", "alert_count")


_IOC = f""", io AS (SELECT 'source_ip' AS type, source_ip AS value, threat_class, ts_us FROM al
  UNION ALL SELECT 'dns_domain', dns_query, threat_class, ts_us FROM al WHERE threat_class = '{S.DGA}' AND dns_query IS NOT NULL
  UNION ALL SELECT 'ja3', ja3, threat_class, ts_us FROM al WHERE threat_class = '{S.MALWARE}') """


@query("iocs", O.ALERTS + _IOC + f"SELECT * FROM io WHERE ts_us >= {BASE_US + 60000000}")
def _(spark, d):
    return an.iocs(archived_alerts(spark, d), F.lit(BASE_US + 60000000))


@query("iocs_distinct", O.ALERTS + _IOC + "SELECT type, value, threat_class, CAST(max(ts_us) AS BIGINT) AS ts_us FROM io GROUP BY 1, 2, 3")
def _(spark, d):
    return an.iocs(archived_alerts(spark, d), distinct=True)


_STAMP = "concat(strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f'), '+00:00')"


@query("export_iocs_csv", O.ALERTS + _IOC + f"SELECT concat(type, ',', value, ',', threat_class, ',', {_STAMP}) AS line FROM io")
def _(spark, d):
    return archive.indicator_lines(an.iocs(archived_alerts(spark, d)))


@query(
    "export_iocs_json",
    O.ALERTS + _IOC + f"""SELECT concat('{{"type":"', type, '","value":"', value, '","threat_class":"', threat_class, '","timestamp":"', {_STAMP}, '"}}') AS line FROM io""",
)
def _(spark, d):
    return archive._indicator_rows(an.iocs(archived_alerts(spark, d))).select(F.to_json(F.struct("*")).alias("line"))


def _rate_sql(span: str) -> str:
    return (
        f"{O.r(f'f / {span}', 2)} AS flows_per_sec, {O.r(f'p / {span}', 2)} AS packets_per_sec, {O.r(f'b / {span}', 2)} AS bytes_per_sec, "
        f"{O.r(O.r(f'b / {span}', 2) + ' * 8 / 1000000', 3)} AS megabits_per_sec"
    )


_TRAFFIC = (
    "count(*) AS f, CAST(sum(CASE WHEN packets_out = 0 THEN 1 ELSE packets_out END + packets_in) AS BIGINT) AS p, "
    "CAST(sum(bytes_out + bytes_in) AS BIGINT) AS b"
)


@query(
    "throughput",
    O.FLOWS + f", t AS (SELECT {_TRAFFIC}, greatest((max(ts_us) - min(ts_us)) / 1000000.0, 1.0) AS e FROM fl) "
    f"SELECT {O.r('e', 1)} AS elapsed_seconds, f AS total_flows, p AS total_packets, b AS total_bytes, {_rate_sql('e')} FROM t",
)
def _(spark, d):
    return an.throughput(flows(spark, d))


_SERIES = f", t AS (SELECT ts_us - ts_us % 60000000 AS bucket_us, {_TRAFFIC} FROM fl GROUP BY 1), sr AS (SELECT bucket_us, f AS total_flows, p AS total_packets, b AS total_bytes, {_rate_sql('60.0')} FROM t) "


@query("throughput_series", O.FLOWS + _SERIES + "SELECT * FROM sr")
def _(spark, d):
    return an.throughput_series(flows(spark, d))


@query("throughput_peak", O.FLOWS + _SERIES + "SELECT bucket_us, megabits_per_sec, max(megabits_per_sec) OVER (ORDER BY bucket_us ROWS UNBOUNDED PRECEDING) AS peak_megabits_per_sec FROM sr")
def _(spark, d):
    return an.running_peak(an.throughput_series(flows(spark, d))).select("bucket_us", "megabits_per_sec", "peak_megabits_per_sec")


@query(
    "downsample",
    O.FLOWS + """, s AS (SELECT ts_us - ts_us % 2000000 AS bucket_us, count(*) AS n FROM fl GROUP BY 1),
    i AS (SELECT *, row_number() OVER (ORDER BY bucket_us) - 1 AS i, count(*) OVER () AS c FROM s)
    SELECT bucket_us, n FROM i WHERE c <= 140 OR i % CAST(ceil(c / 140.0) AS BIGINT) = 0 OR i = c - 1""",
)
def _(spark, d):
    series = an.throughput_series(flows(spark, d), 2).select("bucket_us", col("total_flows").alias("n"))
    return an.downsample(series)


@query(
    "kpis",
    _a(f"""SELECT count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
    {O.r('sum(CAST(confidence_score AS DECIMAL(18,2))) / CAST(count(*) AS DOUBLE) * 100', 4)} AS avg_confidence_pct,
    (SELECT threat_class FROM al GROUP BY 1 ORDER BY count(*) DESC, threat_class LIMIT 1) AS top_vector FROM al"""),
)
def _(spark, d):
    return an.kpis(archived_alerts(spark, d))


@query("top_vector", _a("SELECT threat_class, count(*) AS n FROM al GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def _(spark, d):
    return an.top_vector(archived_alerts(spark, d))


@query(
    "severity_histogram",
    _a(f", h AS (SELECT severity, count(*) AS n FROM al GROUP BY 1) SELECT severity, n, {O.r('n / CAST(sum(n) OVER () AS DOUBLE)', 4)} AS share, n = max(n) OVER () AS dominant FROM h"),
)
def _(spark, d):
    return an.severity_histogram(archived_alerts(spark, d))


@query("alert_count", _a("SELECT count(*) AS total_alerts FROM al"))
def _(spark, d):
    return an.alert_count(archived_alerts(spark, d))


@query("recent_alerts", _a("SELECT alert_id, ts_us, threat_class FROM al ORDER BY ts_us DESC, alert_id LIMIT 50 OFFSET 100"))
def _(spark, d):
    return an.recent_alerts(archived_alerts(spark, d), 50, 100).select("alert_id", "ts_us", "threat_class")


@query("archive_page", _a("SELECT alert_id, ts_us, (SELECT count(*) FROM al) > 150 AS has_next FROM al ORDER BY ts_us DESC, alert_id LIMIT 50 OFFSET 100"))
def _(spark, d):
    return an.archive_page(archived_alerts(spark, d), page=2).select("alert_id", "ts_us", "has_next")


@query(
    "merge_live_archive",
    _a(""", lv AS (SELECT alert_id, ts_us, seq, threat_class FROM al ORDER BY ts_us DESC, seq DESC, threat_class LIMIT 120)
    SELECT alert_id, ts_us FROM (SELECT *, 0 AS o FROM lv UNION ALL SELECT alert_id, ts_us, seq, threat_class, 1 FROM al WHERE alert_id NOT IN (SELECT alert_id FROM lv))
    ORDER BY o, ts_us DESC, seq DESC, threat_class LIMIT 200"""),
)
def _(spark, d):
    a = archived_alerts(spark, d)
    return al.merge_live_archive(al.newest(a, 120), a).select("alert_id", "ts_us")


@query(
    "write_alert_archive",
    _a("SELECT strftime(make_timestamp(ts_us), '%Y-%m') AS month, threat_class, count(*) AS n FROM al GROUP BY 1, 2"),
)
def _(spark, d):
    return archived_alerts(spark, d).groupBy("month", "threat_class").agg(F.count(F.lit(1)).alias("n"))
