"""Silver and gold steps and the published snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import line_revenue_cents
from ..functions.ranking import top_per_group


def silver_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key under a total order; surplus copies are cut map-side."""
    return top_per_group(df, keys, order, 1)


def gold_revenue(
    fact: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Lines and revenue in cents by region and nation.

    Money does not drop out: lines without an order, a customer, a nation or a region are
    summed in one row whose names are NULL, so the total is that of the fact.

    The fact is summed before every join down to the key of that join, so each
    join sees one row per key: a hot order or customer is combined map-side and
    the nation and region joins see 25 rows.
    """
    def summed(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.sum("n_lines").alias("n_lines"), F.sum("revenue_cents").alias("revenue_cents")
        )

    lines = fact.select(
        "l_orderkey",
        F.lit(1).cast("bigint").alias("n_lines"),
        line_revenue_cents(F.col("l_extendedprice"), F.col("l_discount")).alias("revenue_cents"),
    )
    by_customer = summed(
        summed(lines, "l_orderkey").join(
            orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left"
        ),
        "o_custkey",
    )
    by_nation = summed(
        by_customer.join(
            customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left"
        ),
        "c_nationkey",
    )
    placed = F.col("r_regionkey").isNotNull()
    return (
        by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy(F.when(placed, F.col("r_name")).alias("r_name"), F.when(placed, F.col("n_name")).alias("n_name"))
        .agg(
            F.sum("n_lines").cast("bigint").alias("n_lines"),
            F.sum("revenue_cents").cast("bigint").alias("revenue_cents"),
        )
    )


def figures(df: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Long ``(metric, value)`` rows: each aggregate under its name, per group if given.

    A grouped metric is called ``name/group``.
    """
    wide = df.groupBy(*by).agg(
        *[value.cast("bigint").alias(f"__{i}") for i, value in enumerate(metrics.values())]
    )
    pairs = F.array(
        *[
            F.struct(
                F.concat_ws("/", F.lit(name), *by).alias("metric"),
                F.col(f"__{i}").alias("value"),
            )
            for i, name in enumerate(metrics)
        ]
    )
    return wide.select(F.inline(pairs))


def publish_snapshot(run_id: str, parts: Sequence[DataFrame], path: str) -> None:
    """Write ``(run_id, metric, value)`` rows of one run as JSON."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows.select(F.lit(run_id).alias("run_id"), "metric", "value").write.mode("overwrite").json(path)
