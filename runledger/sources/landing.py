"""Landed JSON, partitioned by landing date."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .files import Resolve, address, entries, plain_name, resolve
from .folders import folder_names

CORRUPT = "_corrupt_record"
DATE = "landing_date"
ISO_DATE = re.compile(f"{DATE}=[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}")


def landing_read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest landing under ``path/landing_date=.../``, bad records kept.

    The latest date is the greatest name among the folders at the top, so neither
    older landings nor their files are listed. A landing that holds nothing, or
    empty files only, is the latest all the same and has no rows, which the gate on
    empty tables reports. A record that does not fit the schema keeps its text in
    ``_corrupt_record``.
    """
    full = f"{schema}, {CORRUPT} string, {DATE} date"
    dates = [n for n in folder_names(spark, path) if ISO_DATE.fullmatch(n)]
    if not dates:
        return spark.createDataFrame([], full)
    return (
        spark.read.schema(full)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("basePath", path)
        .json(f"{path.rstrip('/')}/{dates[-1]}")
    )


def parse_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Unpack a JSON column under an explicit schema; a bad record keeps its text."""
    parsed = F.from_json(
        F.col(column), f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}
    )
    return df.withColumn("__parsed", parsed).select("*", "__parsed.*").drop("__parsed")


def latest_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the last day of a time column, for landings that are one table.

    The maximum is found first, by an aggregate that Spark answers from the footers
    where the table and its type allow, and is then a literal of the filter: known when
    the scan is planned, it reaches Parquet, which skips the row groups of older days.
    """
    last = df.agg(F.max(ts).cast("date").cast(df.schema[ts].dataType)).first()[0]
    return df.where(F.col(ts) >= F.lit(last)) if last is not None else df.where(F.lit(False))


def landed_days(spark: SparkSession, base: str, found: Resolve = resolve) -> DataFrame:
    """``feed, landing_date, size`` per folder ``feed=.../landing_date=.../`` below ``base``, from names alone.

    Tasks list the folders; ``size`` is in bytes, 0 for a folder without files or with empty
    ones only.
    """
    top = spark.createDataFrame([(address(spark, base),)], "path string")
    feeds = entries(top, False, found).where("is_folder").select("path")
    days = entries(feeds.repartition("path"), False, found).where("is_folder").select("path")
    held = entries(days.repartition("path"), True, found).where("not is_folder").select("path", "length")
    day = F.regexp_extract("path", f"^(.*/{DATE}=[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(/|$)", 1)
    named = days.select(day.alias("day"), F.lit(0).cast("bigint").alias("length"))
    sizes = named.unionByName(held.select(day.alias("day"), "length")).where("day != ''")
    return sizes.groupBy("day").agg(F.sum("length").alias("size")).select(
        plain_name(F.regexp_extract("day", "/feed=([^/]*)/", 1)).alias("feed"),
        F.regexp_extract("day", f"{DATE}=(.*)$", 1).try_cast("date").alias(DATE),
        "size",
    ).where(f"{DATE} is not null")


def missing_landings(landed: DataFrame, until: Column, since: Column | None = None) -> DataFrame:
    """``feed, kind, first_day, last_day, n_days``: spans of days on which a feed did not deliver.

    ``landed`` has ``feed, landing_date, size``. ``kind`` tells ``absent`` days, without a
    folder, from ``empty`` ones, whose folders hold nothing; spans do not mix them. Each feed
    is expected daily from ``since``, or else from its first landing, up to ``until``.

    A spine of days per feed and its gaps and islands: one row per feed and day, whatever
    a landing holds.
    """
    days = landed.where(f"feed is not null and {DATE} is not null").groupBy("feed", DATE).agg(F.sum("size").alias("size"))
    first = F.min(DATE) if since is None else since.cast("date")
    bounds = days.groupBy("feed").agg(first.alias("first"), until.cast("date").alias("last"))
    spine = bounds.where("first <= last").select("feed", F.explode(F.sequence("first", "last")).alias(DATE))
    kind = F.when(F.col("size").isNull(), "absent").when(F.col("size") <= 0, "empty")
    gaps = spine.join(days, ["feed", DATE], "left").withColumn("kind", kind).where("kind is not null")
    # Days of one island are as far from their places as each other.
    place = F.row_number().over(Window.partitionBy("feed", "kind").orderBy(DATE))
    return (
        gaps.withColumn("__island", F.date_sub(DATE, place))
        .groupBy("feed", "kind", "__island")
        .agg(F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day"), F.count(F.lit(1)).alias("n_days"))
        .drop("__island")
    )


def landing_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000
) -> DataFrame:
    """The same landing as a stream of files."""
    return (
        spark.readStream.schema(f"{schema}, {CORRUPT} string, {DATE} date")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
