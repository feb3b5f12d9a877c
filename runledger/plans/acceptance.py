"""A run is accepted on its figures, not on having run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.compare import snapshot_compare
from ..operators.medallion import publish_snapshot
from ..session import scratch_dir
from ..sources.snapshots import read_snapshot


def publish_and_read(
    spark: SparkSession, run_id: str, parts: Sequence[DataFrame], path: str | None = None
) -> DataFrame:
    """Publish the figures of a run and read back what was written."""
    path = path or scratch_dir(spark, "snapshot")
    publish_snapshot(run_id, parts, path)
    return read_snapshot(spark, path)


def accept_run(
    spark: SparkSession,
    run_id: str,
    parts: Sequence[DataFrame],
    expected: DataFrame,
    path: str | None = None,
) -> DataFrame:
    """Publish, then compare what was published with the expected figures."""
    return snapshot_compare(publish_and_read(spark, run_id, parts, path), expected, run_id)
