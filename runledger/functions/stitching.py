"""Running values along time for keys of any size.

A window over a key brings all its rows to one task. Here a key's time is cut into
slots: each slot is summed up on its own, combined in the map tasks, the few rows
per key and slot are run through in order, and what came before a slot is stitched
to the rows inside it. A task holds one slot of one key at most.

Keys and times must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE, INSIDE = "__before", "__inside"


def _earlier(keys: Sequence[str], slot: str):
    return Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: Sequence[str], slot: str, order: Sequence[Column]):
    return Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_total(
    df: DataFrame, keys: Sequence[str], slot: str, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row of its key."""
    sums = df.groupBy(*keys, slot).agg(F.sum(value).alias(INSIDE))
    before = sums.select(*keys, slot, F.coalesce(F.sum(INSIDE).over(_earlier(keys, slot)), F.lit(0)).alias(BEFORE))
    inside = df.withColumn(INSIDE, F.sum(value).over(_inside(keys, slot, order)))
    return inside.join(before, [*keys, slot]).withColumn(name, F.col(BEFORE) + F.col(INSIDE)).drop(BEFORE, INSIDE)


def carried_forward(
    df: DataFrame, keys: Sequence[str], slot: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """``df`` with the last ``value`` that is not NULL up to and including each row of its key.

    ``order`` is total among rows with a value, ascending, NULLs first.
    """
    there = F.when(value.isNotNull(), F.struct(*order))
    lasts = df.groupBy(*keys, slot).agg(F.max_by(value, there).alias(INSIDE))
    before = lasts.select(*keys, slot, F.last(INSIDE, ignorenulls=True).over(_earlier(keys, slot)).alias(BEFORE))
    inside = df.withColumn(
        INSIDE, F.last(value, ignorenulls=True).over(_inside(keys, slot, [F.col(c).asc() for c in order]))
    )
    return inside.join(before, [*keys, slot]).withColumn(name, F.coalesce(INSIDE, BEFORE)).drop(BEFORE, INSIDE)
