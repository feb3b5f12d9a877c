"""Run history: states, runs in flight, decisions, verdicts, unfinished tasks.

``runs`` has ``dag_id, run_id, state`` and, where named, ``start_date``,
``end_date``, ``waited_s``; ``ti`` has ``dag_id, run_id, task_id, state`` with a
nullable state. Each operator covers any number of DAGs and runs in one plan;
``dag_id`` and ``run_id`` narrow it to one and reach the scan as filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    BLOCKED_LABEL,
    FAILED_LABEL,
    IN_FLIGHT_RUN_STATES,
    IN_FLIGHT_TASK_STATES,
    LISTED_RUNS,
    UNQUEUED,
    VERDICT_TIMEOUT_S,
)
from ..functions.ranking import top_per_group
from ..functions.text import file_stem


def _only(df: DataFrame, dag_id: str | None, run_id: str | None = None) -> DataFrame:
    if dag_id is not None:
        df = df.where(F.col("dag_id") == dag_id)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    return df


def run_state(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """State of each explicitly requested run; one that does not exist is ``unqueued``.

    A run asked for many times is one row, made so map-side.
    """
    found = runs.select("dag_id", "run_id", "state")
    asked = requested.select("dag_id", "run_id").distinct()
    return asked.join(found, ["dag_id", "run_id"], "left").select(
        "dag_id", "run_id", F.coalesce("state", F.lit(UNQUEUED)).alias("state")
    )


def _in_flight(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("state").isin(*IN_FLIGHT_RUN_STATES))


def in_flight_runs(runs: DataFrame, listed: int = LISTED_RUNS) -> DataFrame:
    """Per DAG the true number of runs in flight and the first ``listed`` of them.

    The count and the listing are two aggregates on ``dag_id``: counting inside
    the window would bring every run of a busy DAG to one task.
    """
    busy = _in_flight(runs)
    counts = busy.groupBy("dag_id").agg(F.count(F.lit(1)).alias("n_in_flight"))
    first = top_per_group(
        busy.select("dag_id", "run_id", "start_date"),
        ["dag_id"],
        [F.col("start_date").asc_nulls_last(), F.col("run_id").asc()],
        listed,
        rank="pos",
    )
    return first.join(counts, "dag_id").select(
        "dag_id", "n_in_flight", F.col("pos").cast("bigint").alias("pos"), "run_id", "start_date"
    )


def run_decision(dags: DataFrame, runs: DataFrame, unpause: bool = False) -> DataFrame:
    """What a verification of each DAG would do now; the first rule that applies wins.

    ``dags`` has ``dag_id, is_paused, has_import_error, scanned``. With
    ``unpause`` a paused DAG goes on to the in-flight rules instead of being
    refused. A snapshot: waiting for a scan is the caller's.
    """
    busy = _in_flight(runs).groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("n_in_flight"), F.max("run_id").alias("only_run")
    )
    return decided(dags, busy, unpause)


def decided(dags: DataFrame, busy: DataFrame, unpause: bool = False) -> DataFrame:
    """The decisions, given per DAG with runs in flight their number and, if it is one, the run.

    ``busy`` has ``dag_id, n_in_flight, only_run``; what else it has comes along.
    """
    more = [c for c in busy.columns if c not in ("dag_id", "n_in_flight", "only_run")]
    scanned = F.coalesce(F.col("scanned"), F.lit(False))
    broken = F.coalesce(F.col("has_import_error"), F.lit(False))
    # Anything but a clear "not paused" is refused.
    paused = F.lit(False) if unpause else ~F.col("is_paused").eqNullSafe(False)
    n = F.coalesce(F.col("n_in_flight"), F.lit(0)).cast("bigint")
    decision = (
        F.when(~scanned & broken, "parse_error")
        .when(~scanned, "absent")
        .when(paused, "refuse_paused")
        .when(n >= 2, "refuse_busy")
        .when(n == 1, "adopt")
        .otherwise("trigger")
    )
    return (
        dags.join(busy, "dag_id", "left")
        .select("dag_id", decision.alias("decision"), n.alias("n_in_flight"), "only_run", *more)
        .select(
            "dag_id",
            "decision",
            "n_in_flight",
            F.when(F.col("decision") == "adopt", F.col("only_run")).alias("adopted_run_id"),
            *more,
        )
    )


def verdict(timeout_s: int = VERDICT_TIMEOUT_S) -> Column:
    """A finished state is read before the clock, so a late success still counts."""
    return (
        F.when(F.col("state").isin("success", "failed"), F.col("state"))
        .when(F.col("waited_s") >= timeout_s, "no_verdict")
        .otherwise("pending")
    )


def run_verdict(runs: DataFrame, timeout_s: int = VERDICT_TIMEOUT_S) -> DataFrame:
    """Verdict per watched run. Only ``success`` is a pass; ``no_verdict`` is not."""
    return runs.select(
        "dag_id",
        "run_id",
        F.coalesce("state", F.lit(UNQUEUED)).alias("state"),
        F.col("waited_s").cast("bigint").alias("waited_s"),
        verdict(timeout_s).alias("verdict"),
        F.col("state").eqNullSafe("success").alias("passed"),
    )


def unfinished_tasks(
    ti: DataFrame, dag_id: str | None = None, run_id: str | None = None
) -> DataFrame:
    """Tasks that did not succeed, a NULL state included, with the causes ranked first.

    ``rank`` is 0 for a failed task and 1 for one blocked behind it. For one
    explicit run the listing is sorted; over many runs it is left unsorted and
    costs no shuffle.
    """
    is_failed = F.col("state").eqNullSafe("failed")
    out = (
        _only(ti, dag_id, run_id)
        .where(~F.col("state").eqNullSafe("success"))
        .select(
            "dag_id",
            "run_id",
            "task_id",
            "state",
            F.when(is_failed, FAILED_LABEL).otherwise(BLOCKED_LABEL).alias("label"),
            F.when(is_failed, 0).otherwise(1).cast("bigint").alias("rank"),
        )
    )
    return out.orderBy("rank", "task_id") if dag_id and run_id else out


def failed_tasks(ti: DataFrame, dag_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Failed tasks only; sorted by task for one explicit run."""
    out = (
        _only(ti, dag_id, run_id)
        .where(F.col("state") == "failed")
        .select("dag_id", "run_id", "task_id")
    )
    return out.orderBy("task_id") if dag_id and run_id else out


def _ending(states: tuple[str, ...], dag_ids: list[str] | None) -> Column:
    hit = F.col("state").isin(*states)
    if dag_ids is not None:
        hit = hit & F.col("dag_id").isin(*dag_ids)
    return F.coalesce(hit, F.lit(False))


def fail_in_flight_tasks(ti: DataFrame, dag_ids: list[str] | None = None) -> DataFrame:
    """A new version of ``ti`` where tasks in flight are failed, in every run of the DAGs."""
    return ti.withColumn(
        "state",
        F.when(_ending(IN_FLIGHT_TASK_STATES, dag_ids), "failed").otherwise(F.col("state")),
    )


def fail_in_flight_runs(
    runs: DataFrame, as_of: Column, dag_ids: list[str] | None = None
) -> DataFrame:
    """A new version of ``runs`` where runs in flight are failed and ended at ``as_of``."""
    hit = _ending(IN_FLIGHT_RUN_STATES, dag_ids)
    return runs.withColumns(
        {
            "state": F.when(hit, "failed").otherwise(F.col("state")),
            "end_date": F.when(hit, as_of).otherwise(F.col("end_date")),
        }
    )


def single_owner(items: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Resolve each group to the stem of its only file; 0 or many is reported, not guessed.

    ``items`` has the group column and ``path``. Items are counted map-side, so
    a hot group costs one row per map task.
    """
    members = items.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("one_path")
    )
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return groups.select(group).distinct().join(members, group, "left").select(
        group,
        n.alias("n_members"),
        F.when(n == 1, file_stem(F.col("one_path"))).alias("owner_id"),
        F.when(n == 1, "resolved").otherwise("ambiguous").alias("status"),
    )
