"""Message topics. The broker connector is Spark's own; files stand in where it is absent."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinwatch import schemas as S
from skeinwatch.operators.normalize import TOPICS

RECORD = S.FLOW


def topic_of(kind) -> "F.Column":
    table = F.create_map(*[F.lit(x) for pair in TOPICS.items() for x in pair])
    return F.try_element_at(table, kind)


def encode(records: DataFrame) -> DataFrame:
    """Records as (topic, key, value); the session key keeps one flow in one topic partition."""
    return records.select(
        topic_of(F.col("record_kind")).alias("topic"),
        F.col("flow_id").alias("key"),
        F.to_json(F.struct("*")).alias("value"),
    )


def decode(messages: DataFrame) -> DataFrame:
    """(topic, value) back to records; undecodable messages are dropped."""
    parsed = messages.select("topic", F.from_json(F.col("value").cast("string"), RECORD).alias("r"))
    return parsed.filter("r.ts_us IS NOT NULL").select("topic", "r.*")


def subscribe(spark: SparkSession, servers: str, max_offsets: int | None = None, topics=None) -> DataFrame:
    """Streaming read of the three topics from the earliest offset."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics or TOPICS.values()))
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return decode(reader.load())


def file_topics(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same stream from files of (topic, key, value) written by `emit_to_files`."""
    reader = (
        spark.readStream.schema("topic string, key string, value string")
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    return decode(reader.parquet(path))


def emit_to_files(records: DataFrame, path: str) -> None:
    encode(records).write.mode("append").parquet(path)


def emit_stream(records: DataFrame, servers: str, checkpoint: str):
    """Streaming publish; call .start() on the result."""
    return (
        encode(records).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )
