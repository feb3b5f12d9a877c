"""Runs of a DAG in flight at the same time, over its whole history.

``runs`` has ``dag_id, start_date, end_date``; an end that is NULL has not come yet.
A run is in flight from its start up to, and not including, its end; a run that ends
where it starts, or before, is never in flight, nor is one without a start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stitching import running_total


def in_flight_over_time(runs: DataFrame, slot: str = "month") -> DataFrame:
    """``dag_id, at, step, n``: from each moment at which it changes, how many runs are in flight.

    A sweep over starts and ends with a running sum. Moments are summed map-side; the
    time of a DAG is cut into slots, so a DAG with most of all runs is no single task's.
    """
    known = runs.where("dag_id is not null and start_date is not null and (end_date is null or end_date > start_date)")
    moments = known.select(
        "dag_id",
        F.inline(
            F.array(
                F.struct(F.col("start_date").alias("at"), F.lit(1).alias("step")),
                F.struct(F.col("end_date").alias("at"), F.lit(-1).alias("step")),
            )
        ),
    ).where("at is not null")
    steps = moments.groupBy("dag_id", "at").agg(F.sum("step").alias("step")).where("step != 0")
    steps = steps.withColumn("__slot", F.date_trunc(slot, "at"))
    return running_total(steps, ["dag_id"], "__slot", [F.col("at")], F.col("step"), "n").drop("__slot")


def peak_overlap(runs: DataFrame, slot: str = "month") -> DataFrame:
    """Per DAG the most runs that were in flight at one moment, and the first such moment."""
    sooner = -F.unix_micros(F.col("at").cast("timestamp"))
    return (
        in_flight_over_time(runs, slot)
        .groupBy("dag_id")
        .agg(F.max("n").alias("most"), F.max_by("at", F.struct("n", sooner)).alias("first_at"))
    )


def busy_spans(runs: DataFrame, above: int = 1, slot: str = "month") -> DataFrame:
    """The longest spans in which more than ``above`` runs of a DAG were in flight, with the most of them.

    ``busy_to`` is NULL for a span that has not ended. A span may begin in one slot and
    end in another: spans are numbered by a second running sum.
    """
    n, before = F.col("n"), F.col("n") - F.col("step")
    swept = in_flight_over_time(runs, slot).withColumns(
        {
            "__slot": F.date_trunc(slot, "at"),
            "__opens": ((n > above) & (before <= above)).cast("int"),
            "__closes": (n <= above) & (before > above),
        }
    )
    numbered = running_total(
        swept.where((n > above) | F.col("__closes")), ["dag_id"], "__slot", [F.col("at")], F.col("__opens"), "__span"
    )
    return (
        numbered.groupBy("dag_id", "__span")
        .agg(
            F.min("at").alias("busy_from"),
            F.max(F.when(F.col("__closes"), F.col("at"))).alias("busy_to"),
            F.max("n").alias("most"),
        )
        .drop("__span")
    )
