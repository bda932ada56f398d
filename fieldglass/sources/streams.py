"""Streaming sources."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import MESSAGES


def read_message_stream(
    spark: SparkSession,
    path: str,
    schema: str | StructType = MESSAGES,
    fmt: str = "json",
    start_from: str = "0-0",
    slots: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Message files as a stream.

    ``start_from`` is ``"0-0"`` for the whole history, ``"$"`` for files that appear
    from now on, or a timestamp text. A job that restarts from its checkpoint should
    pass the timestamp of its first start, so that files written while it was down
    are still read. ``slots`` bounds the files taken per micro-batch. Progress is the
    checkpoint of the query, which plays the part of a consumer group.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if slots:
        reader = reader.option("maxFilesPerTrigger", slots)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.load(path)
    if start_from == "0-0":
        return stream
    if start_from == "$":
        start_from = datetime.now(timezone.utc).isoformat()
    return stream.filter(
        F.col("_metadata.file_modification_time") > F.lit(start_from).cast("timestamp")
    )


def read_message_topic(
    spark: SparkSession, servers: str, topic: str, start_from: str = "0-0", slots: int | None = None,
    schema: str = MESSAGES,
) -> DataFrame:
    """The same from a message broker (needs the Kafka connector on the class path).

    ``start_from`` is ``0-0`` (all), ``$`` (new ones) or a timestamp. The value of a record
    is the message as JSON; its columns come out like those of the file source.
    """
    if start_from in ("0-0", "$"):
        begin = ("startingOffsets", "latest" if start_from == "$" else "earliest")
    else:
        moment = datetime.fromisoformat(start_from)
        begin = ("startingTimestamp", str(int(moment.timestamp() * 1000)))
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option(*begin)
    )
    if slots:
        reader = reader.option("maxOffsetsPerTrigger", slots)
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return reader.load().select(parsed.alias("message")).select("message.*")
