"""Change topics. The Kafka connector ships apart from Spark; only the options are tested."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .landing import CORRUPT


def kafka_options(connection: Mapping[str, str], **extra: str) -> dict[str, str]:
    """Reader options from the two fields of a stored connection, bootstrap and topic."""
    missing = [k for k in ("bootstrap", "topic") if not connection.get(k)]
    if missing:
        raise ValueError(f"the connection does not say {' and '.join(missing)}")
    return {
        "kafka.bootstrap.servers": connection["bootstrap"],
        "subscribe": connection["topic"],
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        **extra,
    }


def message_changes(
    messages: DataFrame, schema: str, keys: Sequence[str], seq: str = "seq", op: str = "op"
) -> DataFrame:
    """Change rows of messages ``(key, value, offset)``, whose key and value are JSON under ``schema``.

    A message without a value is a tombstone: a deletion of the key in the message
    key, at the message's offset. What cannot be read, in value or key, keeps its text
    in ``_corrupt_record``; :func:`readable` and :func:`unreadable` part the two.
    """
    whole, options = f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}
    parsed = messages.select(
        F.from_json(F.col("value").cast("string"), whole, options).alias("v"),
        F.from_json(F.col("key").cast("string"), whole, options).alias("k"),
        F.col("value").isNull().alias("tombstone"),
        F.col("key").cast("string").alias("key_text"),
        F.col("value").cast("string").alias("value_text"),
        "offset",
    )
    tombstone = F.col("tombstone")

    def column(name: str):
        value = F.col(f"v.`{name}`")
        if name in keys:
            return F.when(tombstone, F.col(f"k.`{name}`")).otherwise(value)
        if name == op:
            return F.when(tombstone, "d").otherwise(value)
        if name == seq:
            return F.when(tombstone, F.col("offset").cast(kinds[name])).otherwise(value)
        return value

    kinds = {f.name: f.dataType for f in parsed.schema["v"].dataType.fields if f.name != CORRUPT}
    lost = F.when(tombstone, F.col(f"k.{CORRUPT}")).otherwise(F.col(f"v.{CORRUPT}"))
    no_key = reduce(lambda a, b: a | b, [column(name).isNull() for name in keys])
    text = F.when(tombstone, F.coalesce("key_text", F.lit(""))).otherwise(F.col("value_text"))
    return parsed.select(
        *[column(name).alias(name) for name in kinds],
        F.coalesce(lost, F.when(no_key, text)).alias(CORRUPT),
    )


def readable(changes: DataFrame) -> DataFrame:
    """Changes that were read whole, ready to be applied."""
    return changes.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def unreadable(changes: DataFrame) -> DataFrame:
    """The texts of messages that are no change, for a gate or a dead-letter table."""
    return changes.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def change_topic(
    spark: SparkSession, connection: Mapping[str, str], schema: str, keys: Sequence[str]
) -> DataFrame:
    """The change rows of a topic as a stream, unreadable messages among them."""
    raw = spark.readStream.format("kafka").options(**kafka_options(connection)).load()
    return message_changes(raw, schema, keys)
