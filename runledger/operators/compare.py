"""Comparing figures and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stitching import carried_forward


def snapshot_compare(
    actual: DataFrame, expected: DataFrame, run_id: str | None = None
) -> DataFrame:
    """Every metric of two ``(metric, value)`` tables with a status, exact and null-safe.

    ``match`` / ``differ`` / ``missing`` (expected only) / ``unexpected`` (actual
    only). Given the ``run_id`` under test, a figure another run published is
    ``stale`` whatever its value.
    """
    stale = F.lit(False) if run_id is None else ~F.col("run_id").eqNullSafe(run_id)
    a = actual.select(
        "metric", F.col("value").alias("actual_value"), stale.alias("is_stale"),
        F.lit(True).alias("in_actual"),
    )
    e = expected.select(
        "metric", F.col("value").alias("expected_value"), F.lit(True).alias("in_expected")
    )
    status = (
        F.when(F.col("in_actual").isNull(), "missing")
        .when(F.col("is_stale"), "stale")
        .when(F.col("in_expected").isNull(), "unexpected")
        .when(F.col("actual_value").eqNullSafe(F.col("expected_value")), "match")
        .otherwise("differ")
    )
    return a.join(e, "metric", "full").select(
        "metric", "actual_value", "expected_value", status.alias("status")
    )


def compare_as_of(actual: DataFrame, expected: DataFrame, slot: str = "month") -> DataFrame:
    """Each run's figures against what was expected of them when it ran.

    ``actual`` has ``metric, run_id, at, value``, ``expected`` has ``metric, valid_from,
    value``: a value holds from its moment on until the next one of its metric. A value
    published at the moment of a run holds for it; of several published at once the
    greatest does. ``match`` / ``differ``, or ``unexpected`` for a figure before the first
    value of its metric. Rows without a metric or a moment take no part.

    An as-of join without a range join: both sides in one order of time, and the
    last expected value carried forward over the slots of each metric.
    """
    moment = actual.schema["at"].dataType
    runs = actual.where("metric is not null and at is not null").select(
        "metric", F.col("at").alias("__at"), F.lit(1).alias("__kind"), "run_id", F.col("value").alias("actual_value"),
        F.lit(None).cast(expected.schema["value"].dataType).alias("__value"),
    )
    known = expected.where("metric is not null and valid_from is not null").select(
        "metric", F.col("valid_from").cast(moment).alias("__at"), F.lit(0).alias("__kind"),
        F.col("value").alias("__value"),
    )
    both = runs.unionByName(known, allowMissingColumns=True).withColumn("__slot", F.date_trunc(slot, "__at"))
    said = F.when(F.col("__kind") == 0, F.struct(F.col("__at").alias("valid_from"), F.col("__value").alias("expected_value")))
    seen = carried_forward(both, ["metric"], "__slot", ["__at", "__kind", "__value"], said, "__said").where("__kind = 1")
    status = (
        F.when(F.col("__said").isNull(), "unexpected")
        .when(F.col("actual_value").eqNullSafe(F.col("__said.expected_value")), "match")
        .otherwise("differ")
    )
    return seen.select(
        "metric", "run_id", F.col("__at").alias("at"), "actual_value", "__said.expected_value", "__said.valid_from",
        status.alias("status"),
    )


class SchemaDifference(ValueError):
    """Two tables whose columns or types differ cannot hold the same rows."""


def schema_differences(left: DataFrame, right: DataFrame) -> list[str]:
    """What the schemas do not share: columns of one side and columns of two types."""
    ours, theirs = dict(left.dtypes), dict(right.dtypes)
    return (
        [f"{c} is in the left table only" for c in ours if c not in theirs]
        + [f"{c} is in the right table only" for c in theirs if c not in ours]
        + [
            f"{c} is {ours[c]} on the left and {theirs[c]} on the right"
            for c in ours
            if theirs.get(c, ours[c]) != ours[c]
        ]
    )


def schema_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(gate, entity, detail)`` rows for what the schemas do not share; none if they are the same."""
    said = [
        F.struct(F.lit("schema").alias("gate"), F.lit(text.split(" is ")[0]).alias("entity"), F.lit(text).alias("detail"))
        for text in schema_differences(left, right)
    ]
    none = F.array().cast("array<struct<gate:string,entity:string,detail:string>>")
    return left.sparkSession.range(1).select(F.inline(F.array(*said) if said else none))


def parity_gate(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(gate, entity, detail)``: schema differences, and how many rows differ in the columns both sides have.

    Reports where ``parity_check`` raises, so that an acceptance goes on to its end.
    """
    theirs = dict(right.dtypes)
    shared = [c for c, kind in left.dtypes if theirs.get(c) == kind]
    found = schema_rows(left, right)
    if not shared:
        return found
    surplus = parity_by_digest(left.select(shared), right.select(shared)).groupBy("side").agg(F.sum("copies").alias("n"))
    rows = surplus.select(
        F.lit("parity").alias("gate"),
        F.col("side").alias("entity"),
        F.concat(F.col("n").cast("string"), F.lit(f" rows on this side only, by {', '.join(shared)}")).alias("detail"),
    )
    return found.unionByName(rows)


def row_digests(df: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n, mixed, total``: rows dealt to buckets by hash, each bucket's digest whatever their order.

    Exclusive-or of one hash and the sum of another, so that rows that come twice do not
    cancel. At most ``buckets`` rows leave a map task.
    """
    hashed = F.xxhash64(*df.columns)
    other = F.pmod(F.xxhash64(F.lit("other"), *df.columns), F.lit(1 << 30))
    return df.groupBy(F.pmod(hashed, F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("mixed"), F.sum(other).alias("total")
    )


def parity_by_digest(left: DataFrame, right: DataFrame, buckets: int = 4096) -> DataFrame:
    """As ``parity_check``, comparing digests of buckets first and rows of unequal buckets only.

    Equal tables shuffle digests and no row. The unequal buckets, ``buckets`` rows at
    most, are broadcast to both tables, which are read once more for them. Two
    buckets that differ have equal digests once in some 2**90 cases.
    """
    if unlike := schema_differences(left, right):
        raise SchemaDifference("; ".join(unlike))
    right = right.select(left.columns)
    ours, theirs = row_digests(left, buckets), row_digests(right, buckets)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("n", "mixed", "total")]
    unequal = (
        ours.alias("l")
        .join(theirs.alias("r"), F.col("l.bucket") == F.col("r.bucket"), "full")
        .where(~(same[0] & same[1] & same[2]))
        .select(F.coalesce("l.bucket", "r.bucket").alias("__bucket"))
    )

    def suspect(df: DataFrame) -> DataFrame:
        dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
        return dealt.join(F.broadcast(unequal), "__bucket", "left_semi").drop("__bucket")

    return parity_check(suspect(left), suspect(right))


def parity_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference of two tables both ways: the row, its side, surplus copies.

    Schemas are part of the parity: a column that one side lacks or has in another
    type raises ``SchemaDifference``, which names it, before any row is read.

    One shuffle for both directions; copies are summed map-side, so a row that is
    repeated without end travels once per map task.
    """
    if unlike := schema_differences(left, right):
        raise SchemaDifference("; ".join(unlike))
    columns = left.columns
    signed = left.withColumn("__copies", F.lit(1)).unionByName(
        right.select(*columns).withColumn("__copies", F.lit(-1))
    )
    n = F.col("__n")
    return (
        signed.groupBy(*columns)
        .agg(F.sum("__copies").alias("__n"))
        .where(n != 0)
        .select(
            F.when(n > 0, "left").otherwise("right").alias("side"),
            *columns,
            F.abs(n).cast("bigint").alias("copies"),
        )
    )
