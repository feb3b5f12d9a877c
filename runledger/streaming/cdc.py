"""The change stream as a Structured Streaming job into a table of current rows.

The table is its own state: the last change per key, deletions included, so that a
late older row cannot revive a key. It lies in runs, each with one row per key.
A micro-batch adds a run; runs are merged from the newest back as soon as the newer
ones together hold as many rows as the next older one. So every run is larger than
all newer ones together: with N keys there are at most log2(N) + 1 runs whatever the
number of batches, and a row is rewritten log2(N) times at most. Runs are versions
under a manifest (``sources.versions``): a reader opens one version and sees whole
batches only, and a batch that is repeated after a failure is known by its number.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cdc import cdc_apply, latest_changes
from ..sources.versions import Part, Table, Version, commit, expire, open_version, schema_text

TABLE = "current"
ROWS_PER_FILE = 1_000_000
#: Versions a reader may keep open while the stream goes on.
KEPT_VERSIONS = 20


def due(rows: Sequence[int]) -> int:
    """Where the runs to merge begin, given the runs' rows, oldest first; their number if none is due."""
    newer = 0
    start = len(rows)
    for i in range(len(rows) - 1, -1, -1):
        if i < len(rows) - 1 and newer >= rows[i]:
            start = i
        newer += rows[i]
    return start


def write_run(spark: SparkSession, df: DataFrame, sink: str) -> Part:
    folder = f"{TABLE}/{uuid.uuid4().hex}"
    df.write.parquet(f"{sink}/{folder}")
    return Part(folder, spark.read.schema(df.schema).parquet(f"{sink}/{folder}").count())


def with_batch(
    spark: SparkSession, seen: Version, changes: DataFrame, keys: Sequence[str], seq: Sequence[str]
) -> Table:
    """The table of ``seen`` with a batch of changes as its newest run, runs merged where they are due."""
    return with_run(spark, seen, write_run(spark, latest_changes(changes, keys, seq), seen.base), changes, keys, seq)


def with_run(
    spark: SparkSession, seen: Version, run: Part, changes: DataFrame, keys: Sequence[str], seq: Sequence[str]
) -> Table:
    """The table of ``seen`` with a written run of one change per key, runs merged where they are due.

    The merge joins no data; it groups the merged runs by key, over as many tasks as they
    have files' worth of rows. Nothing of it is visible before a commit.
    """
    runs = [*seen.tables[TABLE].parts] if TABLE in seen.tables else []
    runs.append(run)
    start = due([r.rows for r in runs])
    if start < len(runs):
        merging = runs[start:]
        parts = math.ceil(sum(r.rows for r in merging) / ROWS_PER_FILE) or 1
        rows = spark.read.schema(changes.schema).parquet(*[f"{seen.base}/{r.folder}" for r in merging])
        merged = latest_changes(rows.repartition(parts, *keys), keys, seq)
        runs = [*runs[:start], write_run(spark, merged, seen.base)]
    runs = [r for r in runs if r.rows] or runs[-1:]
    return Table(schema_text(changes), tuple(runs), None, tuple(keys))


def is_repeated(seen: Version, mark: tuple[str, int] | None) -> bool:
    """Whether a batch, by its writer's name and its number, is in ``seen`` already."""
    return mark is not None and seen.marks.get(mark[0], -1) >= mark[1]


def apply_changes(
    spark: SparkSession,
    sink: str,
    changes: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    mark: tuple[str, int] | None = None,
    keep: int = KEPT_VERSIONS,
) -> Version:
    """Commit a batch of changes as the next version of the table at ``sink``.

    ``mark`` is the writer's name and the batch's number: a batch up to the last
    committed one of that name changes nothing.
    """
    seen = open_version(spark, sink)
    if is_repeated(seen, mark):
        return seen
    table = with_batch(spark, seen, changes, keys, seq)
    new = commit(spark, seen, {TABLE: table}, dict([mark] if mark else []))
    if new.number % keep == 0:
        expire(spark, sink, keep)
    return new


def cdc_stream(
    changes: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    sink: str,
    checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Keep the table at ``sink`` current; with ``once`` the query ends when the input is read.

    The stream has no state of its own, so it needs no state store and may be
    restarted with another number of shuffle partitions.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # Read back and merged in the caller's session: the stream's own plans without adaptive execution.
        apply_changes(spark, sink, batch, keys, seq, mark=(f"stream {checkpoint}", batch_id))

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_current(
    spark: SparkSession, sink: str, keys: Sequence[str], seq: Sequence[str], schema, version: int | None = None
) -> DataFrame:
    """Current row per key of one version, the newest unless given; equals ``cdc_apply``."""
    seen = open_version(spark, sink, version)
    rows = seen.read(spark, TABLE) if TABLE in seen.tables else spark.createDataFrame([], schema)
    return cdc_apply(rows, keys, seq)
