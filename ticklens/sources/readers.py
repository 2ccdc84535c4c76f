"""Raw message readers: JSON lines and Kafka, batch or stream, as one schema.

Both give ``(source, raw, ingest_time)``, the input of :mod:`ticklens.sources.messages`;
Kafka rows also carry ``topic``, ``partition`` and ``offset``, from which the
normalisers derive ids that a replay gives again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, source: str | None = None, stream: bool = False) -> DataFrame:
    """Text files of one message a line.  ``source`` names their feed; without it, it is the name
    of the folder that a file is in.  A message arrives when its file was last written; empty lines
    are no messages.  Lines are not parsed here: a malformed one becomes a reject later."""
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").load(path).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    feed = F.lit(source) if source is not None else F.element_at(F.split("file_path", "/"), -2)
    return (lines.filter(F.trim("value") != "")
            .select(feed.alias("source"), F.col("value").alias("raw"), F.col("file_modification_time").alias("ingest_time")))


def read_kafka(spark: SparkSession, servers: str, topics: str, stream: bool = True, **options: str) -> DataFrame:
    """Messages of Kafka topics (comma-separated); needs Spark's Kafka connector on the class path.
    ``options`` go to the source, e.g. ``maxOffsetsPerTrigger`` or ``startingOffsets``."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    return kafka_messages(reader.option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load())


def kafka_messages(records: DataFrame) -> DataFrame:
    """Kafka's record schema as raw messages: the feed is the key's text, or the topic's name where
    a record has no key."""
    return records.select(F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("source"),
                          F.col("value").cast("string").alias("raw"), F.col("timestamp").alias("ingest_time"),
                          "topic", "partition", "offset")
