"""Ending what is in flight: tasks and runs of some DAGs in one step.

Both tables lie in buckets of DAGs under one manifest (``sources.versions``). Ending
rewrites the buckets in which something is in flight, leaves the folders of all
others as they are, and publishes both tables by one commit: whoever reads sees
the tasks and the runs of before, or of after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import IN_FLIGHT_RUN_STATES, IN_FLIGHT_TASK_STATES
from ..operators.runs import fail_in_flight_runs, fail_in_flight_tasks
from ..sources.versions import Table, Version, bucket_of, commit, open_version, replaced, write_buckets

TASKS, RUNS = "task_instance", "dag_run"
BUCKETS = 64


def publish_history(spark: SparkSession, base: str, ti: DataFrame, runs: DataFrame, buckets: int = BUCKETS) -> Version:
    """Task instances and runs as the next version of the history at ``base``."""
    tables = {TASKS: ti, RUNS: runs}
    written = {name: write_buckets(df, base, name, ["dag_id"], buckets) for name, df in tables.items()}
    return commit(spark, open_version(spark, base), written)


def _buckets(spark: SparkSession, dag_ids: Sequence[str], buckets: int) -> set[int]:
    asked = spark.createDataFrame([(d,) for d in dag_ids], "dag_id string")
    return {r[0] for r in asked.select(bucket_of(["dag_id"], buckets)).distinct().collect()}


def _ended(spark: SparkSession, seen: Version, name: str, dag_ids: Sequence[str], states: Sequence[str], end) -> Table | None:
    """The table with its touched buckets written anew; None if nothing is in flight."""
    table = seen.tables[name]
    asked = _buckets(spark, dag_ids, table.buckets)
    in_flight = F.col("dag_id").isin(*dag_ids) & F.col("state").isin(*states)
    hit = seen.read(spark, name, asked).where(in_flight).select(bucket_of(table.keys, table.buckets))
    touched = {r[0] for r in hit.distinct().collect()}
    if not touched:
        return None
    rows = end(seen.read(spark, name, touched))
    return replaced(table, write_buckets(rows, seen.base, name, table.keys, table.buckets), touched)


def end_dags(spark: SparkSession, base: str, dag_ids: Sequence[str], as_of: Column) -> Version:
    """Fail the tasks and runs in flight of the given DAGs, in every run of them, in one version.

    Runs need an ``end_date``, which becomes ``as_of``. Without anything in flight
    there is no new version. ``VersionTaken`` if someone else committed meanwhile:
    nothing is changed then, and the call may be repeated.
    """
    dag_ids = list(dag_ids)
    if not dag_ids:
        return open_version(spark, base)
    seen = open_version(spark, base)
    ended = {
        TASKS: _ended(spark, seen, TASKS, dag_ids, IN_FLIGHT_TASK_STATES, lambda df: fail_in_flight_tasks(df, dag_ids)),
        RUNS: _ended(spark, seen, RUNS, dag_ids, IN_FLIGHT_RUN_STATES, lambda df: fail_in_flight_runs(df, as_of, dag_ids)),
    }
    changed = {name: table for name, table in ended.items() if table}
    return commit(spark, seen, changed) if changed else seen
