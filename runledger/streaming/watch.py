"""Waiting for verdicts: runs that were triggered, as a stream, and runs that ended, as another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import VERDICT_TIMEOUT_S


def watch_verdicts(
    triggered: DataFrame, finished: DataFrame, timeout_s: int = VERDICT_TIMEOUT_S, late_s: int = 0
) -> DataFrame:
    """A verdict for each triggered run: its state if it ends within the timeout, else ``no_verdict``.

    ``triggered`` has ``dag_id, run_id, triggered_at``, ``finished`` has ``dag_id, run_id,
    state, finished_at``, with one end per run. An end counts by its own time, not by the time
    it arrives, as long as it is at most ``late_s`` behind the newest rows. A run comes out
    when its end is seen, or without one when both streams have passed its timeout; until then
    it is pending and no row. Both sides keep in state what may still meet, and no more.
    """
    asked = triggered.select("dag_id", "run_id", "triggered_at").withWatermark("triggered_at", f"{late_s} seconds")
    ended = (
        finished.where(F.col("state").isin("success", "failed"))
        .select(F.col("dag_id").alias("__dag"), F.col("run_id").alias("__run"), "state", "finished_at")
        .withWatermark("finished_at", f"{late_s} seconds")
    )
    in_time = (F.col("finished_at") >= F.col("triggered_at")) & (
        F.col("finished_at") <= F.col("triggered_at") + F.expr(f"interval {timeout_s} seconds")
    )
    same = (F.col("dag_id") == F.col("__dag")) & (F.col("run_id") == F.col("__run"))
    return asked.join(ended, same & in_time, "left").select(
        "dag_id",
        "run_id",
        "triggered_at",
        F.coalesce("state", F.lit("no_verdict")).alias("verdict"),
        F.col("state").eqNullSafe("success").alias("passed"),
    )


def first_of_each(stream: DataFrame, keys: list[str], at: str, late_s: int) -> DataFrame:
    """One row per key of a stream: the first to arrive, repeats within ``late_s`` of it left out.

    The state of a key goes when the watermark has passed its row by ``late_s``. Rows that come later
    than that are dropped; ``dropped_late`` has their number.
    """
    return stream.withWatermark(at, f"{late_s} seconds").dropDuplicatesWithinWatermark(keys)


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the query's recent batches."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
