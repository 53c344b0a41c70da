from pyspark.sql import functions as F

from skeinwatch.functions import net, scalars as fn


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_entropy(spark):
    ips = F.array(*[F.lit(f"10.0.0.{i}") for i in range(16)])
    got = one(
        spark, empty=fn.shannon_entropy(F.lit("")), single=fn.shannon_entropy(F.lit("a")),
        same=fn.shannon_entropy(F.lit("aaaaaaa")), four=fn.shannon_entropy(F.lit("abcd")),
        lone=fn.shannon_entropy_tokens(F.array(F.lit("10.0.0.1"))), many=fn.shannon_entropy_tokens(ips),
    )
    assert got == {"empty": 0.0, "single": 0.0, "same": 0.0, "four": 2.0, "lone": 0.0, "many": 4.0}


def test_ratio(spark):
    pairs = [(1000, 1000, 1.0), (100, 1000, 0.1), (10_000_000, 50_000, 200.0), (500, 0, 500.0), (0, 0, 0.0), (-10, 100, None)]
    df = spark.createDataFrame(pairs, "o bigint, i bigint, want double")
    for r in df.withColumn("got", fn.flow_ratio(F.col("o"), F.col("i"))).collect():
        assert r["got"] == r["want"]


def test_iat_variance_and_fan_out(spark):
    def arr(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    got = one(
        spark, even=fn.iat_variance(arr(100, 115, 130, 145, 160)), odd=fn.iat_variance(arr(100, 102, 125, 127, 190)),
        two=fn.iat_variance(arr(1, 2)), fan=fn.fan_out(F.array(*[F.lit(x) for x in ("a:1", "b:1", "a:1", "c:2")])),
    )
    assert got["even"] == 0.0 and got["odd"] > 10.0 and got["two"] == 0.0 and got["fan"] == 3


def test_history_and_safe_int(spark):
    rows = [("S", ["SYN"]), ("ShAD", ["SYN", "ACK", "PSH"]), ("ShADF", ["SYN", "ACK", "PSH", "FIN"]), ("R", ["RST"]), ("", [])]
    df = spark.createDataFrame(rows, "h string, want array<string>")
    for r in df.withColumn("got", fn.history_to_flags(F.col("h"))).collect():
        assert r["got"] == r["want"]
    ints = [("123", 0, 123), ("456", 0, 456), ("-", 0, 0), (None, 80, 80), ("invalid", 53, 53)]
    for text, default, want in ints:
        assert one(spark, n=fn.safe_int(F.lit(text).cast("string"), default))["n"] == want


def test_ports(spark):
    for text, want in [("443", 443), ("65535", 65535), ("65536", 53), ("-1", 53), ("99999999999", 53), ("x", 53), (None, 53)]:
        assert one(spark, n=fn.safe_port(F.lit(text).cast("string"), 53))["n"] == want


def test_event_time(spark):
    ingest = F.timestamp_micros(F.lit(7))
    for text, want in [
        ("1694567890.123", 1694567890123000), ("1.694567890123E9", 1694567890123000),
        ("2026-09-12T18:30:00Z", 1789237800000000), ("junk", 7), (None, 7),
        ("Infinity", 7), ("-Infinity", 7), ("NaN", 7), ("1e30", 7), ("253402300800", 7),
    ]:
        got = one(spark, t=F.unix_micros(fn.parse_event_time(F.lit(text).cast("string"), ingest)))
        assert got["t"] == want


def test_severity_edges(spark):
    for score, want in [
        (0.95, "critical"), (1.0, "critical"), (0.9499, "high"), (0.90, "high"), (0.8999, "moderate"),
        (0.80, "moderate"), (0.7999, "low"), (0.0, "low"),
    ]:
        assert one(spark, s=fn.severity(F.lit(score)))["s"] == want


def test_short_texts_have_no_ngrams(spark):
    assert one(spark, a=fn.ngram_uniqueness(F.lit("a"), 2), b=fn.ngram_uniqueness(F.lit("aab"), 2)) == {"a": 0.0, "b": 1.0}


def test_addresses(spark):
    cases = [
        ("10.0.0.1", "0A000001"), ("255.255.255.255", "FFFFFFFF"), ("256.0.0.1", None), ("01.2.3.4", None), ("host", None),
        ("::1", "0" * 31 + "1"), ("2001:db8::ff00:42:8329", "20010DB8000000000000FF0000428329"),
        ("::ffff:1.2.3.4", "00000000000000000000FFFF01020304"), ("1:2:3", None), ("1::2::3", None), ("::", "0" * 32),
    ]
    df = spark.createDataFrame(cases, "ip string, want string")
    for r in df.withColumn("got", net.ip_hex(F.col("ip"))).collect():
        assert r["got"] == r["want"], r["ip"]


def test_cidr_membership(spark):
    cases = [
        ("192.168.1.55", "192.168.1.0/24", True), ("203.0.113.88", "192.168.1.0/24", False),
        ("10.1.2.3", "10.1.99.99/16", True), ("10.1.2.3", "10.1.2.3", True), ("10.1.2.3", "2001:db8::/32", False),
        ("2001:db8:5::1", "2001:db8::/32", True), ("2001:db9::1", "2001:db8::/32", False),
        ("name", "name", True), ("10.0.0.1", "name", False), ("10.0.0.1", "0.0.0.0/0", True),
    ]
    df = spark.createDataFrame(cases, "ip string, net string, want boolean")
    for r in df.withColumn("got", net.ip_in_cidr(F.col("ip"), F.col("net"))).collect():
        assert r["got"] == r["want"], (r["ip"], r["net"])


def test_clean_ip(spark):
    for raw, want in [("10.0.0.1:443", "10.0.0.1"), (" 10.0.0.1 ", "10.0.0.1"), ("2001:db8::1", "2001:db8::1"), (None, "")]:
        assert one(spark, c=net.clean_ip(F.lit(raw).cast("string")))["c"] == want


BLOCKS = [
    "10.0.0.0/8", "10.1.2.3/31", "10.1.2.3/32", "0.0.0.0/0", "10.1.0.0/255.255.0.0", "10.1.0.0/0.0.255.255", "10.1.0.0/255.0.255.0", "10.1.2.3/33", "10.1.2.3/", "10.1.2.3/a",
    "10.1.2.3/8/9", "10.1.2", "10.01.2.3", "2001:db8::/29", "2001:db8:1::/47", "::/0", "::1/128", "::1/129", "::ffff:1.2.3.4/120", "2001:db8::/255.0.0.0", "", "name", None,
    "1.2.3.4/08", "1.2.3.4/-1", "1.2.3.4/ 8", "10.1.2.3/99999999999",
]


def test_cidr_ranges_are_those_of_the_standard_library(spark):
    """The block's text is parsed by columns; the library is the reference for what is valid and where it begins and ends."""
    import ipaddress

    frame = spark.createDataFrame([(b,) for b in BLOCKS], "block string")
    for block, got in frame.select("block", net.cidr_range(F.col("block")).alias("r")).collect():
        try:
            n = ipaddress.ip_network(block, strict=False) if block is not None else None
        except ValueError:
            n = None
        width = 8 if n is None or n.version == 4 else 32
        want = n and (f"{int(n.network_address):0{width}X}", f"{int(n.broadcast_address):0{width}X}", n.prefixlen)
        assert (got and tuple(got)) == want, block


def test_sql_functions_equal_the_column_functions(spark):
    from skeinwatch.functions import scalars, sql

    sql.register(spark)
    ips = ["10.1.2.3", "10.1.2.2", "10.0.255.7", "2001:db8::1", "2001:db8:1:ffff::2", "2001:DB8:0::", "::1", "1.2.3.77", "::ffff:1.2.3.9", "name", "", None]
    pairs = spark.createDataFrame([(i, b) for i in ips for b in BLOCKS], "ip string, block string")
    pairs.createOrReplaceTempView("pairs")
    asked = spark.sql("SELECT ip, block, ip_in_cidr(ip, block) AS got FROM pairs")
    assert "Python" not in asked._jdf.queryExecution().executedPlan().toString()
    want = {(r["ip"], r["block"]): r["w"] for r in pairs.select("ip", "block", net.ip_in_cidr(F.col("ip"), F.col("block")).alias("w")).collect()}
    for r in asked.collect():
        assert r["got"] == want[r["ip"], r["block"]], r
    texts = spark.createDataFrame([("", -1, 5), ("aab", 10, 0), (None, None, 3), ("ab.cd*+é中", 7, 3), ("aaaa", 0, 9)], "t string, o bigint, i bigint")
    texts.createOrReplaceTempView("texts")
    got = spark.sql("SELECT shannon_entropy(t) AS h, flow_ratio(o, i) AS r FROM texts").collect()
    assert got == texts.select(scalars.shannon_entropy(F.col("t")).alias("h"), scalars.flow_ratio(F.col("o"), F.col("i")).alias("r")).collect()
