"""Applying a change stream ``(key, seq, op, payload...)``; op is c, u or d."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType


def latest_changes(changes: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The change with the highest sequence per key, deletions included.

    An aggregate and not a window: it is combined map-side, it runs unchanged on
    a stream, and applying it twice or in any order gives the same rows. Changes of
    one key and sequence are decided by their other columns, in column order, so
    the order they arrive in does not matter; :func:`repeated_changes` reports them.
    """
    rest = [c for c in changes.columns if c not in keys]
    version = version_of(changes, keys, seq)
    # Where the order takes in every column, the highest version is the change itself.
    whole = all(c in seq or _ordered(changes.schema[c].dataType) for c in rest)
    return (
        changes.groupBy(*keys)
        .agg((F.max(version) if whole else F.max_by(F.struct(*rest), version)).alias("__last"))
        .select(*keys, "__last.*")
        .select(*changes.columns)
    )


def version_of(changes: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> Column:
    """What puts the changes of one key in order."""
    rest = [c for c in changes.columns if c not in keys and c not in seq]
    return F.struct(*seq, *[c for c in rest if _ordered(changes.schema[c].dataType)])


def _ordered(kind: DataType) -> bool:
    """Whether values can be compared; maps and variants cannot."""
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text


def repeated_changes(changes: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """``(gate, entity, detail)`` per key and sequence that stands for more than one change."""
    name = lambda columns: F.concat_ws(
        ", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in columns]
    )
    return (
        changes.groupBy(*keys, *seq)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(
            F.lit("repeated_change").alias("gate"),
            name(keys).alias("entity"),
            F.concat(name(seq), F.lit(": "), F.col("__n").cast("string"), F.lit(" changes")).alias("detail"),
        )
    )


def live_rows(latest: DataFrame, op: str = "op") -> DataFrame:
    """Keys whose last change is not a deletion."""
    return latest.where(~F.col(op).eqNullSafe("d"))


def cdc_apply(
    changes: DataFrame, keys: Sequence[str], seq: Sequence[str], op: str = "op"
) -> DataFrame:
    """Current row per key, whatever order the changes arrived in.

    An update of an unknown key inserts it; a late older change cannot revive a
    deleted key.
    """
    return live_rows(latest_changes(changes, keys, seq), op)
