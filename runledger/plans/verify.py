"""From DAGs and runs to a verdict, and from a failed run to what its tasks said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed import FAILED_LABEL, LOG_TAIL_LINES, VERDICT_TIMEOUT_S
from ..operators.logs import TASK_KEYS, import_error_lines, last_words, newest_attempt
from ..operators.runs import decided, failed_tasks, in_flight_runs, run_verdict, unfinished_tasks
from ..session import scratch_dir
from ..sources.logs import list_attempts, read_log_tails


def verify_dags(
    dags: DataFrame,
    runs: DataFrame,
    later: DataFrame | None = None,
    timeout_s: int = VERDICT_TIMEOUT_S,
    unpause: bool = False,
    errors: DataFrame | None = None,
) -> DataFrame:
    """The decision for every DAG and, where a run is adopted, the verdict on that run.

    Decisions are made on ``runs``, the snapshot before; the verdict is on the one
    run id adopted there, as ``later`` shows it (the same snapshot if not given, in
    which an adopted run is in flight by definition). Only adopted runs of the later
    snapshot enter the join. A DAG without a verdict has not passed.

    ``because`` says what stands behind a refusal: the first runs in flight of a
    busy DAG, or from ``errors`` (``dag_id, line_no, line``) the first lines that
    carry an import error of a DAG that cannot be parsed.
    """
    # One pass over the runs: their listing has the number, the only run and the first few of a DAG.
    listing = F.array_sort(F.collect_list(F.struct("pos", "run_id")))  # a few rows per DAG
    busy = in_flight_runs(runs).groupBy("dag_id").agg(
        F.max("n_in_flight").alias("n_in_flight"),
        F.max("run_id").alias("only_run"),
        F.array_join(F.transform(listing, lambda x: x["run_id"]), ", ").alias("busy"),
    )
    decisions = decided(dags, busy, unpause)
    adopted = decisions.where("adopted_run_id is not null").select(
        "dag_id", F.col("adopted_run_id").alias("run_id")
    )
    watched = (runs if later is None else later).join(adopted, ["dag_id", "run_id"], "left_semi")
    verdicts = run_verdict(watched, timeout_s).withColumnRenamed("run_id", "adopted_run_id")
    out = decisions.join(verdicts, ["dag_id", "adopted_run_id"], "left")
    because = F.when(F.col("decision") == "refuse_busy", F.col("busy"))
    if errors is not None:
        out = out.join(in_order(import_error_lines(errors), "line_no", "line", "\n"), "dag_id", "left")
        because = because.when(F.col("decision") == "parse_error", F.col("said"))
    return out.select(
        "dag_id",
        "decision",
        "n_in_flight",
        "adopted_run_id",
        "state",
        "verdict",
        F.coalesce("passed", F.lit(False)).alias("passed"),
        because.alias("because"),
    )


def in_order(rows: DataFrame, place: str, text: str, between: str) -> DataFrame:
    """``(dag_id, said)``: the few listed texts of each DAG, joined in order."""
    listed = F.array_sort(F.collect_list(F.struct(place, text)))
    said = F.array_join(F.transform(listed, lambda x: x[text]), between)
    return rows.groupBy("dag_id").agg(said.alias("said"))


def failed_run_report(
    runs: DataFrame,
    ti: DataFrame,
    attempts: DataFrame,
    tails: DataFrame,
    file_key: str = "attempt_id",
    written_at: str = "attempt_ts",
    tie: str = "attempt_id",
    n: int = LOG_TAIL_LINES,
) -> DataFrame:
    """For every run whose verdict is ``failed``: its unfinished tasks and their last lines.

    Failed tasks come with the log of their newest attempt; a task blocked behind
    them is one row without a line. Read it by ``rank, task_id, line_no``.
    """
    failed = run_verdict(runs).where("verdict = 'failed'").select("dag_id", "run_id")
    tasks = unfinished_tasks(ti).join(failed, ["dag_id", "run_id"], "left_semi")
    asked = F.col("label") == FAILED_LABEL
    return last_words(
        tasks.drop("state"), attempts, tails, file_key, written_at, tie, asked=asked, n=n
    )


def tree_failure_report(
    spark: SparkSession,
    ti: DataFrame,
    base: str,
    under: Sequence[str] | None = None,
    n: int = LOG_TAIL_LINES,
    written_at: str = "written_at",
    tie: str = "attempt",
) -> DataFrame:
    """The failure report straight from a log tree: what every failed task said last.

    Tasks list the tree; the newest file of each failed task is chosen from the
    listing, written down, and read from its end. Nothing else is opened. A task whose
    newest log is empty is a row without a line.
    """
    failed = failed_tasks(ti)
    attempts = list_attempts(spark, base, under).join(failed, list(TASK_KEYS), "left_semi")
    path = scratch_dir(spark, "newest-logs")
    newest_attempt(attempts, written_at=written_at, tie=tie).write.parquet(path)
    newest = spark.read.schema(attempts.schema).parquet(path)
    return last_words(failed, newest, read_log_tails(newest, n), "path", written_at, tie, n=n)
