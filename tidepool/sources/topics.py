"""Message topics: Kafka source/sink options, a file-backed twin, JSON decode/encode, generator.

The Kafka connector package is not on this image's classpath, so the Kafka path is
built as option dictionaries (unit-checked) and the tests run the file-backed twin:
a folder of JSON lines, one record with its key, value, topic, partition, offset and time per line.

Delivery is at least once: a record may arrive again after a retry. ``once`` takes each record once, by its place in the topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

# Fixed values of the source/sink tables: topic names, consumer group, start position.
SOURCE_TOPIC = "source"
SINK_TOPIC = "sink"
CONSUMER_GROUP = "flink-test-group"
STARTING_OFFSETS = "earliest"

# The generator's three base texts (short, medium, long).
GENERATOR_TEXTS = [
    "hi",
    "hello there friend",
    "this is a much longer test message to exercise the category enrichment",
]
GENERATOR_PARTITIONS = 3


def kafka_source_options(bootstrap: str, topic: str = SOURCE_TOPIC, group_id: str = CONSUMER_GROUP) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": STARTING_OFFSETS,
        "kafka.group.id": group_id,
        "failOnDataLoss": "true",
    }


def kafka_sink_options(bootstrap: str, topic: str = SINK_TOPIC) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic}


RECORD_DDL = "key string, value string, topic string, partition int, offset long, timestamp long"
RECORD = ["key", "value", "topic", "partition", "offset", "timestamp"]
#: Records in one compressed file of the twin at most; a task reads a whole file.
FILE_RECORDS = 100_000


def read_topic_stream(spark: SparkSession, *, bootstrap: str | None = None, path: str | None = None,
                      topic: str = SOURCE_TOPIC, max_files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded topic scan from the earliest offset -> key and value (strings) with topic, partition, offset and timestamp.

    With ``bootstrap`` it reads Kafka; with ``path`` the file twin (JSON lines).
    """
    if bootstrap is not None:
        raw = spark.readStream.format("kafka").options(**kafka_source_options(bootstrap, topic)).load()
        return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rec = reader.load(path).select(F.from_json("value", RECORD_DDL, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rec.withColumn("timestamp", F.timestamp_millis("timestamp"))


def once(records: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each record of a stream once, however often it is delivered: by topic, partition and offset, in Spark's state.

    A place is kept in state until the watermark (``lateness`` behind the newest record) has passed its record's time, so a
    record may be delivered again, and partitions may run apart, by that much. Records without an offset are not deduplicated by place: they need one.
    """
    return records.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["topic", "partition", "offset"])


def decode_json(value: Column, on_error: str = "fail") -> Column:
    """Decode a record value with the declared source schema.

    ``fail`` (the connector default) stops the job on a malformed record; ``quarantine``
    keeps going and yields a struct of NULL fields for it.
    """
    mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
    return F.from_json(value, S.SOURCE_TOPIC, {"mode": mode})


def encode_json(df: DataFrame) -> DataFrame:
    """Row -> JSON ``value``; NULL fields are kept as JSON null, no key is set."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_topic(df: DataFrame, path: str, key_col: str = "id", value_col: str = "value", topic: str = SOURCE_TOPIC) -> None:
    """Append records to the topic twin as compressed JSON lines (one new file set per call).

    partition, offset and timestamp (epoch ms) are taken from ``df`` where it has them, else null.
    """
    own = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("partition", "offset", "timestamp")}
    rec = F.to_json(F.struct(F.col(key_col).cast("string").alias("key"), F.col(value_col).alias("value"), F.lit(topic).alias("topic"),
                             own["partition"].cast("int").alias("partition"), own["offset"].cast("long").alias("offset"), own["timestamp"].cast("long").alias("timestamp")))
    df.select(rec.alias("value")).write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def write_sink(df: DataFrame, *, bootstrap: str | None = None, path: str | None = None, topic: str = SINK_TOPIC) -> None:
    """Write rows as JSON values without a key: to Kafka, or with ``path`` to the file twin."""
    values = encode_json(df)
    if bootstrap is not None:
        values.write.format("kafka").options(**kafka_sink_options(bootstrap, topic)).save()
    else:
        values.write.mode("append").text(path)


def encode_message(message: Column) -> Column:
    """The producer's record encoding: ``{"message": ...}``."""
    return F.to_json(F.struct(message.alias("message")), {"ignoreNullFields": "false"})


def generate_messages(seq: DataFrame, i_col: str = "i") -> DataFrame:
    """Generator records for sequence numbers: text[i % 3] + '-' + i, partition i % 3."""
    i = F.col(i_col).cast("long")
    texts = F.array(*[F.lit(t) for t in GENERATOR_TEXTS])
    message = F.concat(F.element_at(texts, (i % len(GENERATOR_TEXTS) + 1).cast("int")), F.lit("-"), i.cast("string"))
    return seq.select(i.alias("i"), message.alias("message"), (i % GENERATOR_PARTITIONS).cast("int").alias("partition"))


def generator_stream(spark: SparkSession, interval: float = 1.0) -> DataFrame:
    """The endless generator: one record every ``interval`` seconds, numbered from 0."""
    if interval <= 0:
        raise ValueError("the interval must be positive")
    per_second = max(1, round(1 / interval))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    gap = 1 if interval <= 1 else round(interval)  # a slower generator takes every gap-th tick
    return generate_messages(ticks.where(F.col("value") % gap == 0).select(F.floor(F.col("value") / gap).alias("i")))


def generate_count(spark: SparkSession, n: int, path: str, checkpoint: str, interval: float = 1.0, every: str = "1 second") -> None:
    """The finite generator: the endless one, written to ``path`` and stopped once it has given its first ``n`` records."""
    q = generator_stream(spark, interval).where(F.col("i") < n).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    gap = 1 if interval <= 1 else round(interval)
    last = (n - 1) * gap  # the tick that brings the last record
    try:
        while n and q.isActive and sum(p.numInputRows for p in q.recentProgress) <= last:
            q.awaitTermination(0.2)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
