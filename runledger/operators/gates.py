"""Quality gates. Each returns ``(gate, entity, detail)`` for violations; empty means pass.

A gate reports what it does not understand instead of skipping it: a NULL is an
unknown value, a column that is not there is a violation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _violation(gate: str, entity: Column, detail: Column) -> list[Column]:
    return [
        F.lit(gate).alias("gate"),
        entity.cast("string").alias("entity"),
        detail.cast("string").alias("detail"),
    ]


def non_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One violation per table without rows.

    One row settles a table: each is cut to one, so Spark stops at the first file
    that has any and only an empty table is read to its end.
    """
    rows = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("entity")).limit(1) for name, df in tables.items()],
    )
    names = rows.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in tables])).alias("entity")
    )
    return names.join(rows.distinct(), "entity", "left_anti").select(
        *_violation("non_empty", F.col("entity"), F.lit("no rows"))
    )


def non_empty_groups(expected: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """One violation per expected key that has no row in ``df``.

    Keys are made distinct map-side, so a hot key joins as one row.
    """
    return (
        expected.select(key)
        .distinct()
        .join(df.select(key).distinct(), key, "left_anti")
        .select(*_violation("non_empty", F.col(key), F.lit("no rows")))
    )


def accepted_values(
    df: DataFrame, column: str, allowed: Sequence[object], entity: str
) -> DataFrame:
    """One violation per row whose value is outside ``allowed``; NULL is outside."""
    known = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    shown = F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
    return df.where(~known).select(
        *_violation("accepted_values", F.col(entity), F.concat(F.lit(f"{column}="), shown))
    )


def required_keys(
    entities: DataFrame,
    requirement: Mapping[str, Sequence[str]],
    present: DataFrame,
    entity: str = "entity",
    kind: str = "kind",
) -> DataFrame:
    """One violation per key an entity's kind requires and ``present`` does not hold.

    ``requirement`` maps a kind to its keys; it is a declaration, so it becomes a
    literal map and no join, and a kind that most entities share stays where it
    is. A kind without an entry needs nothing, and neither does an empty mapping. ``present`` has ``key`` and, where
    keys belong to an entity, the entity column.

    Keys that belong to no entity are cut to the declared ones; there are at most
    as many, so they are broadcast and the entities do not gather on a few keys.
    Keys of an entity join on both, repeated pairs made distinct map-side.
    """
    declared = sorted({key for keys in requirement.values() for key in keys})
    pairs = [
        part
        for name, keys in requirement.items()
        for part in (F.lit(name), F.array(*[F.lit(k) for k in keys]))
    ]
    by_kind = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    keys = F.try_element_at(by_kind.cast("map<string,array<string>>"), F.col(kind).cast("string"))
    needed = entities.select(F.col(entity), F.explode(keys).alias("key")).distinct()
    have = present.where(F.col("key").isin(*declared))
    if entity in present.columns:
        missing = needed.join(have.select(entity, "key").distinct(), [entity, "key"], "left_anti")
    else:
        missing = needed.join(F.broadcast(have.select("key").distinct()), "key", "left_anti")
    return missing.select(
        *_violation(
            "required_keys", F.col(entity), F.concat(F.lit("missing key "), F.col("key"))
        )
    )


@dataclass(frozen=True)
class Contract:
    """What a table promises: columns with types, no NULLs, a unique key, accepted values."""

    table: str
    columns: Mapping[str, str]
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: Mapping[str, Sequence[object]] = field(default_factory=dict)


def contract_check(df: DataFrame, contract: Contract) -> DataFrame:
    """One violation per broken promise, with the number of rows or keys that break it.

    Types are compared on the schema alone. Everything else is one pass: rows are
    counted per key map-side and the counts are summed, so a hot key is one row
    per map task. NULL keys count as equal. A unique key with a missing column is
    that violation; what is left of it promises nothing.
    """
    have = dict(df.dtypes)
    unique = list(contract.unique) if all(c in have for c in contract.unique) else []

    broken: list[tuple[str, str, Column]] = []
    for name in contract.not_null:
        if name in have:
            broken.append((name, "null", F.col(name).isNull()))
    for name, allowed in contract.accepted.items():
        if name in have:
            known = F.coalesce(F.col(name).isin(*allowed), F.lit(False))
            broken.append((name, "value not accepted", ~known))

    by_key = df.groupBy(*unique).agg(
        F.count(F.lit(1)).alias("__copies"),
        *[F.count_if(bad).alias(f"__bad{i}") for i, (_, _, bad) in enumerate(broken)],
    )
    counts = [(name, text, F.sum(f"__bad{i}")) for i, (name, text, _) in enumerate(broken)]
    if unique:
        counts.append(
            (f"({', '.join(unique)})", "repeated key", F.count_if(F.col("__copies") > 1))
        )
    for name, dtype in contract.columns.items():
        if name not in have:
            counts.append((name, "missing column", F.lit(1)))
        elif have[name] != dtype:
            counts.append((name, f"type {have[name]} instead of {dtype}", F.lit(1)))
    for name in {*contract.not_null, *contract.unique, *contract.accepted}.difference(
        have, contract.columns
    ):
        counts.append((name, "missing column", F.lit(1)))
    if not counts:
        raise ValueError(f"the contract of {contract.table} promises nothing")

    rules = F.array(
        *[
            F.struct(
                F.lit(f"{contract.table}.{entity}").alias("entity"),
                F.lit(text).alias("text"),
                F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
            )
            for entity, text, n in counts
        ]
    )
    found = by_key.agg(rules.alias("rules")).select(F.inline("rules")).where(F.col("n") > 0)
    return found.select(
        *_violation(
            "contract", F.col("entity"), F.concat_ws(": ", "text", F.col("n").cast("string"))
        )
    )
