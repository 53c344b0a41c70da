"""JSON-lines session logs: reading, normalising and writing."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skeinwatch import schemas as S
from skeinwatch.operators.normalize import NORMALIZERS, enrich_by_uid, union_records
from skeinwatch.sources import tail


def arrival_order() -> Column:
    """A per-record number that breaks ties; ids grow with position inside a file split."""
    return F.monotonically_increasing_id()


#: Fields that are lists, but may be written as a single text: read as text, so that such a line stays an entry.
_LISTS = [f.name for f in S.LOG_ENTRY.fields if isinstance(f.dataType, T.ArrayType)]
#: Fields of which the number 0 counts as missing, while the text "0" is a value: read with their JSON type.
_COUNTS = [
    "orig_bytes", "orig_ip_bytes", "bytes_out", "resp_bytes", "resp_ip_bytes", "bytes_in",
    "orig_pkts", "packets_out", "resp_pkts", "packets_in", "id.orig_p", "id.resp_p", "src_port", "dst_port",
]
_PARSED = T.StructType(
    [T.StructField(f.name, T.VariantType() if f.name in _COUNTS else T.StringType()) for f in S.LOG_ENTRY.fields]
    + [T.StructField("_malformed", T.StringType())]
)


def _content(lines: DataFrame) -> DataFrame:
    """Blank and '#' lines are no entries."""
    return lines.withColumn("value", F.trim("value")).filter(
        (F.col("value") != "") & ~F.col("value").startswith("#")
    )


def _entry() -> Column:
    return F.from_json("value", _PARSED, {"columnNameOfCorruptRecord": "_malformed"})


def _is_entry(e: Column) -> Column:
    return F.col("value").startswith("{") & e.isNotNull() & e["_malformed"].isNull()


def _list_of(text: Column) -> Column:
    """The list that a JSON text holds; any other text is its only item."""
    items = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when(text.isNotNull(), F.coalesce(items, F.array(text)))


def _count_of(v: Column) -> Column:
    """A JSON number without its fraction, none for the number 0; a text as it stands."""
    number = F.try_variant_get(v, "$", "double")
    whole = F.coalesce(F.try_variant_get(v, "$", "bigint"), number.try_cast("bigint"))
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(
        number != 0, whole.cast("string")
    )


def _field(name: str) -> Column:
    value = F.col(f"e.`{name}`")
    return _list_of(value) if name in _LISTS else _count_of(value) if name in _COUNTS else value


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (value, seq) to log entries `e`; malformed lines are left out.

    The generator keeps Catalyst from copying the parse into every field and filter.
    """
    parsed = F.filter(F.array(_entry()), _is_entry)
    entries = _content(lines).select("seq", F.explode(parsed).alias("e"))
    fields = [_field(n).alias(n) for n in S.LOG_ENTRY.names]
    return entries.select("seq", F.struct(*fields).alias("e"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("seq", arrival_order())


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New log files as they appear, from any file system (`tail.follow_lines` also follows growing files, in a mounted folder)."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
        .withColumn("seq", F.shiftright(F.xxhash64("value"), 3))  # room for spreading three logs
    )


def scan_logs(spark: SparkSession, kind: str, path: str, by_byte: bool = False) -> DataFrame:
    """`by_byte`: record numbers from file and byte (`sources.tail`), so that repeated runs give equal alert ids however files are split."""
    return normalize_lines(tail.scan_lines(spark, path) if by_byte else read_lines(spark, path), kind)


def normalize_lines(lines: DataFrame, kind: str, ingest_ts: Column | None = None) -> DataFrame:
    return NORMALIZERS[kind](parse_lines(lines), ingest_ts)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that should have been entries, for a quarantine table."""
    return _content(lines).filter(~_is_entry(_entry())).select("value")


def correlated_records(conn: DataFrame, dns: DataFrame, ssl: DataFrame) -> DataFrame:
    """The three logs as one event stream, connections enriched by session.

    Record numbers start per log, so they are spread to stay unique in the union.
    """
    parts = [enrich_by_uid(conn, dns, ssl), dns, ssl]
    return union_records(*[p.withColumn("seq", F.col("seq") * 3 + i) for i, p in enumerate(parts)])


def _common() -> list[Column]:
    return [
        (F.col("ts_us") / 1000000).alias("ts"), F.col("uid"),
        F.col("src_ip").alias("id.orig_h"), F.col("src_port").alias("id.orig_p"),
        F.col("dst_ip").alias("id.resp_h"), F.col("dst_port").alias("id.resp_p"),
    ]


def log_lines(flows: DataFrame) -> dict[str, DataFrame]:
    """Flows as conn, dns and ssl log lines (value, seq)."""
    letter = lambda f: F.when(f == "PSH", "D").otherwise(F.substring(f, 1, 1))  # noqa: E731 (as history_to_flags reads it)
    history = F.array_join(F.transform("flags", letter), "")
    conn = F.struct(
        *_common(), F.lower("protocol").alias("proto"),
        F.col("bytes_out").alias("orig_bytes"), F.col("bytes_in").alias("resp_bytes"),
        F.col("packets_out").alias("orig_pkts"), F.col("packets_in").alias("resp_pkts"),
        history.alias("history"),
    )
    dns = F.struct(
        *_common(), F.col("dns_query").alias("query"),
        F.coalesce("dns_query_type", F.lit("A")).alias("qtype_name"),
        F.array().cast("array<string>").alias("answers"),
    )
    ssl = F.struct(*_common(), F.col("server_name"), F.col("ja3_hash").alias("ja3"))

    def lines(rows, struct):
        return rows.select(F.to_json(struct).alias("value"), "seq")

    return {
        "conn": lines(flows, conn),
        "dns": lines(flows.filter("dns_query <> ''"), dns),
        "ssl": lines(flows.filter("server_name <> ''"), ssl),
    }


def write_logs(flows: DataFrame, directory: str) -> None:
    for kind, lines in log_lines(flows).items():
        lines.select("value").write.mode("append").text(f"{directory}/{kind}")
