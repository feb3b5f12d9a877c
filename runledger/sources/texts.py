"""Plain text: files to scan, version pins, words of a listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_text_files(spark: SparkSession, base: str) -> DataFrame:
    """``(path, text)`` of every file below ``base`` that is text; the path starts below it.

    A file that is not valid UTF-8 is no text and is left out. ``base`` is one
    folder: below a glob there would be no one place for paths to start.
    """
    if re.search(r"[*?\[{]", base):
        raise ValueError(f"one folder, not a pattern: {base}")
    content = F.col("content").cast("string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    folder = re.sub("^[a-z0-9]+:/*", "", base).strip("/") + "/"
    start = F.instr("path", folder) + len(folder)
    return files.where(F.is_valid_utf8(content)).select(
        F.substr("path", start).alias("path"), content.alias("text")
    )


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of ``key=value`` lines; comments and other lines are not pins."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .where(F.contains("value", F.lit("=")) & ~line.startswith("#"))
        .select(
            F.trim(F.substring_index("value", "=", 1)).alias("key"),
            F.trim(F.regexp_replace("value", "^[^=]*=", "")).alias("value"),
        )
    )


def paused_flag(word: str = "is_paused") -> Column:
    """The words ``True`` and ``False`` as a boolean; any other word is NULL."""
    return F.when(F.col(word) == "True", True).when(F.col(word) == "False", False)
