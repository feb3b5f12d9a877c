"""Gates on a stream: the row count comes from ``observe``, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def observe_rows(df: DataFrame, name: str) -> DataFrame:
    """Attach a row count to a stream; each micro-batch reports it in its progress."""
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"))


def is_empty_batch(progress, name: str) -> bool:
    """Whether the micro-batch behind a progress event brought no rows."""
    metrics = progress.observedMetrics.get(name)
    return metrics is None or metrics["n_rows"] == 0


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Batch form: the count is there once the frame was written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen
