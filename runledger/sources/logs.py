"""Task log trees: ``dag_id=.../run_id=.../task_id=.../[more folders/]attempt=N.log``.

The keys are read from a file's own path, whatever lies between its task folder
and the file (``map_index=...`` of a mapped task, say), so one folder of another
shape does not disturb the others. A file outside such folders is no task's log.
``under`` narrows a reader to folders below the base, for example
``dag_id=a/run_id=b``; folders beside them are not even listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import LINE_ORDER, LOG_TAIL_LINES  # noqa: F401  (the order of read_log_lines)
from .files import Resolve, files_of, plain_name, resolve, tails


def _keys(path: Column) -> list[Column]:
    part = lambda key: F.regexp_extract(path, f"/{key}=([^/]*)/", 1)
    named = [F.when(part(k) != "", plain_name(part(k))).alias(k) for k in ("dag_id", "run_id", "task_id")]
    return [*named, F.when(part("map_index") != "", part("map_index")).try_cast("int").alias("map_index")]


def _attempt(path: Column) -> Column:
    return F.regexp_extract(path, "attempt=([0-9]+)\\.log$", 1).try_cast("int")


def _folders(base: str, under: Sequence[str] | None) -> list[str]:
    return [f"{base.rstrip('/')}/{u.strip('/')}" for u in under] if under is not None else [base]


def _of_tasks(df: DataFrame) -> DataFrame:
    return df.where("dag_id is not null and run_id is not null and task_id is not null")


def list_attempts(
    spark: SparkSession, base: str, under: Sequence[str] | None = None, found: Resolve = resolve
) -> DataFrame:
    """One row per log file from the listing alone, empty files included; no content is read.

    Tasks list the folders, so a tree of any size passes the driver by; without
    ``under`` the DAGs' folders are dealt over the tasks, then the runs' folders.
    """
    listed = files_of(spark, _folders(base, under), found).where(F.col("path").endswith(".log"))
    return _of_tasks(
        listed.select(
            *_keys(F.col("path")), "path", _attempt(F.col("path")).alias("attempt"), "written_at", "length"
        )
    )


def read_log_tails(files: DataFrame, n: int = LOG_TAIL_LINES, found: Resolve = resolve) -> DataFrame:
    """``path, line_no, line, bytes_read``: the last ``n`` lines of each file of a listing.

    Read from the files' ends, so a log of any size costs what its last lines take.
    """
    return tails(files.select("path").distinct(), n, found=found)


def _reader(spark: SparkSession):
    return (
        spark.read.schema("value string")
        .option("pathGlobFilter", "*.log")
        .option("recursiveFileLookup", "true")
    )


def _address(path: Column) -> Column:
    """One spelling for the reader and the listing: no empty authority."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_log_lines(
    spark: SparkSession, base: str, where: Column | None = None, under: Sequence[str] | None = None
) -> DataFrame:
    """Lines of every log with their order, for files of any size.

    A big file is read in several splits. The split's offset and the row's place
    inside its task give the order within the file; no file is held whole. The
    place is not deterministic for Catalyst, which moves no filter below it, so a
    filter on the keys is given as ``where``, and folders are left out by ``under``.
    """
    raw = _reader(spark).text(_folders(base, under)).select(
        "value", _address(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block_start")
    )
    keyed = _of_tasks(raw.select("*", *_keys(F.col("path"))))
    if where is not None:
        keyed = keyed.where(where)
    return keyed.select(
        "dag_id", "run_id", "task_id", "map_index", "path", "block_start",
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )


def read_log_texts(spark: SparkSession, base: str, under: Sequence[str] | None = None) -> DataFrame:
    """One row per log file with its whole text, for logs that fit a row."""
    raw = _reader(spark).text(_folders(base, under), wholetext=True).select(
        _address(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")
    )
    return _of_tasks(raw.select(*_keys(F.col("path")), "path", "text"))
