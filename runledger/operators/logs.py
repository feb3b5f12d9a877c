"""Task logs: newest attempt, tails, the failure report, import-error lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import LINE_ORDER, LISTED_IMPORT_ERRORS, LOG_TAIL_LINES, NO_LOG_FILE
from ..functions.ranking import top_per_group
from ..functions.text import NEWLINE, is_noise, split_lines
from .runs import failed_tasks

TASK_KEYS = ("dag_id", "run_id", "task_id")


def newest_attempt(
    attempts: DataFrame,
    keys: Sequence[str] = TASK_KEYS,
    written_at: str = "attempt_ts",
    tie: str = "attempt_id",
) -> DataFrame:
    """Per task the attempt written last; equal times fall back to the attempt id."""
    return top_per_group(attempts, keys, [F.col(written_at).desc(), F.col(tie).desc()], 1)


def log_tail(
    lines: DataFrame,
    n: int = LOG_TAIL_LINES,
    file_keys: Sequence[str] = ("attempt_id",),
    order: Sequence[str] = ("line_no",),
) -> DataFrame:
    """The last ``n`` lines of each file of a line table.

    Each map task keeps at most ``n`` lines of a file before the shuffle, so one
    huge file does not land in one task.
    """
    return top_per_group(lines, file_keys, [F.col(c).desc() for c in order], n)


def text_tail(files: DataFrame, n: int = LOG_TAIL_LINES, text: str = "text") -> DataFrame:
    """As ``log_tail`` for a table with one row per file: cut in place, no shuffle."""
    return split_lines(files, text, NEWLINE, last=n)


def _tails(files: DataFrame, wanted: DataFrame, file_key: str, n: int) -> DataFrame:
    """The last lines of the wanted files only: the others go before anything is split."""
    files = files.join(wanted, file_key, "left_semi")
    if "text" in files.columns:
        return text_tail(files, n)
    if "line_no" in files.columns:
        return files
    # Lines of files read in splits: what is kept of a file is numbered in its order.
    kept = log_tail(files, n, [file_key], LINE_ORDER)
    place = Window.partitionBy(file_key).orderBy(*LINE_ORDER)
    return kept.withColumn("line_no", F.row_number().over(place).cast("bigint"))


def last_words(
    tasks: DataFrame,
    attempts: DataFrame,
    tails: DataFrame,
    file_key: str = "attempt_id",
    written_at: str = "attempt_ts",
    tie: str = "attempt_id",
    asked: Column | None = None,
    n: int = LOG_TAIL_LINES,
) -> DataFrame:
    """Each task with the last lines of its newest attempt, or that it left no log.

    Tasks come first: only their attempts are ranked, and only the files of their
    newest attempts are cut. ``tails`` has one row per file with its ``text``, or
    lines with ``LINE_ORDER`` as ``read_log_lines`` gives them, of which the last
    ``n`` are taken, or lines with ``line_no`` that are cut already. At most n lines
    per file are joined, so neither join sees a hot key. Where ``attempts`` is a
    listing of files (it has their ``length``), a file without lines is an empty
    log: a row without a line, told apart from a task that has no file.

    Tasks without an attempt would all have the same NULL file; each joins on its
    own name instead, which matches none. A task for which ``asked`` is not true is
    kept as one row without a file and a line.
    """
    about = (tasks if asked is None else tasks.where(asked)).select(*TASK_KEYS)
    own = attempts.join(about, list(TASK_KEYS), "left_semi")
    newest = newest_attempt(own, written_at=written_at, tie=tie)
    located = tasks.join(newest.select(*TASK_KEYS, file_key), list(TASK_KEYS), "left")
    if asked is not None:
        located = located.withColumn(file_key, F.when(asked, F.col(file_key)))
    file = F.concat(F.lit("file "), F.col(file_key).cast("string"))
    nowhere = F.concat_ws("/", F.lit("no file "), *TASK_KEYS)
    wanted = newest.select(file_key).where(F.col(file_key).isNotNull())
    said = _tails(tails, wanted, file_key, n).select(
        file.alias("__file"), "line_no", "line", F.lit(True).alias("__has_line")
    )
    missing = F.lit(True) if asked is None else asked
    if "length" in attempts.columns:
        missing = missing & F.col(file_key).isNull()
    silent = F.when(missing, NO_LOG_FILE)
    line = F.when(F.col("__has_line"), F.col("line")).otherwise(silent)
    return (
        located.withColumn("__file", F.coalesce(file, nowhere))
        .join(said, "__file", "left")
        .select(*tasks.columns, file_key, "line_no", line.alias("line"))
    )


def failure_report(
    ti: DataFrame,
    attempts: DataFrame,
    tails: DataFrame,
    file_key: str = "attempt_id",
    written_at: str = "attempt_ts",
    tie: str = "attempt_id",
    n: int = LOG_TAIL_LINES,
) -> DataFrame:
    """What every failed task said last, or that it left no log; see ``last_words``."""
    return last_words(failed_tasks(ti), attempts, tails, file_key, written_at, tie, n=n)


def import_error_lines(
    lines: DataFrame, k: int = LISTED_IMPORT_ERRORS, bundle: str = "dag_id", order: str = "line_no"
) -> DataFrame:
    """The first ``k`` lines per bundle that carry an error."""
    return top_per_group(lines.where(~is_noise(F.col("line"))), [bundle], [F.col(order).asc()], k)
