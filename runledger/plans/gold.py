"""Gold kept current from the changes of its fact: what a change takes away, and what it brings.

Three tables lie under one manifest (``sources.versions``) and change by one commit:
the fact's current rows as runs (``streaming.cdc``), gold by region and nation, and
the orphans, lines whose order, customer, nation or region is not there yet. A batch is
reduced to one change per key and written as a run; one grouping by key holds it against
the older runs and the orphans, and only lines it touches, with what they were and what
they are, go on to the orders. Gold is not summed again. Orphans are tried again with every batch, so one whose order arrives late goes to
its nation; the sum of gold and orphans is that of the fact at every version.

Dimensions only gain rows: a customer that moves does not take its old lines along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import line_revenue_cents
from ..operators.cdc import latest_changes, version_of
from ..session import scratch_dir
from ..sources.versions import Version, commit, open_version, write_whole
from ..streaming.cdc import TABLE, is_repeated, with_run, write_run

GOLD, ORPHANS = "gold", "orphans"
SUMS = ("n_lines", "revenue_cents")
GOLD_SCHEMA = "r_name string, n_name string, n_lines bigint, revenue_cents bigint"


def _touched(held: DataFrame, run: DataFrame, orphans: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Per touched line and order ``(keys, l_orderkey, before, after)``, structs of revenue, NULL where there is no line.

    ``before`` is what gold holds: NULL for an orphan. Orphans that the run does not
    touch come as new lines, as often as they are there. A key with a NULL in it meets
    neither held lines nor orphans.
    """
    old, new, orphan = 0, 1, 2
    rows = held.dropna(subset=list(keys)).withColumn("batch", F.lit(old)).unionByName(run.withColumn("batch", F.lit(new)))
    rows = rows.unionByName(orphans.withColumn("batch", F.lit(orphan)), allowMissingColumns=True)
    apart = F.greatest(F.lit(False), *[F.col(k).isNull() & (F.col("batch") == orphan) for k in keys])
    version, is_old, is_orphan = version_of(run, keys, seq), F.col("batch") == old, F.col("batch") == orphan
    # A key has few rows here: dealt out as they are, they are smaller than half-made groups.
    grouped = rows.repartition(*keys).groupBy(*keys, apart.alias("__apart")).agg(
        F.max(F.when(is_old, version)).alias("was"),
        F.max(F.when(~is_orphan, version)).alias("now"),
        F.max(F.col("batch") == new).alias("touched"),
        F.collect_list(F.when(is_orphan, F.struct(F.col("l_orderkey").alias("order"), F.struct(F.col("revenue_cents").alias("cents")).alias("sum")))).alias("aside"),
    )

    def line(of: str):
        order = F.col("l_orderkey" if "l_orderkey" in keys else f"{of}.l_orderkey")
        cents = line_revenue_cents(F.col(f"{of}.l_extendedprice"), F.col(f"{of}.l_discount"))
        there = F.col(of).isNotNull() & ~F.col(f"{of}.op").eqNullSafe("d")
        return F.when(there, F.struct(order.alias("order"), F.struct(cents.alias("cents")).alias("sum")))

    was, now = F.when(F.size("aside") == 0, line("was")), line("now")
    none = F.lit(None).cast("struct<cents:bigint>")
    step = lambda order, before, after: F.struct(order.alias("order"), before.alias("before"), after.alias("after"))
    out = F.when(was.isNotNull(), F.array(step(was["order"], was["sum"], none))).otherwise(F.array())
    come = F.when(now.isNotNull(), F.array(step(now["order"], none, now["sum"]))).otherwise(F.array())
    stays = was.isNotNull() & now.isNotNull() & was["order"].eqNullSafe(now["order"])
    steps = F.when(~F.col("touched"), F.transform("aside", lambda x: step(x["order"], none, x["sum"])))
    steps = steps.when(stays, F.array(step(now["order"], was["sum"], now["sum"]))).otherwise(F.concat(out, come))
    return grouped.select(*keys, F.explode(steps).alias("__s")).select(
        *[k for k in keys if k != "l_orderkey"], F.col("__s.order").alias("l_orderkey"), F.col("__s.before").alias("before"), F.col("__s.after").alias("after")
    )


def _placed(lines: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Lines with ``r_name, n_name`` and ``known``, whether every step to them is there."""
    # Orders meet their customers first: lines are shuffled by their order only.
    homes = orders.select("o_orderkey", "o_custkey").join(
        customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left"
    ).select("o_orderkey", "c_nationkey")
    return (
        lines.join(homes, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(*lines.columns, "r_name", "n_name", F.col("r_regionkey").isNotNull().alias("known"))
    )


def apply_fact_changes(
    spark: SparkSession,
    base: str,
    changes: DataFrame,
    dims: Sequence[DataFrame],
    keys: Sequence[str],
    seq: Sequence[str],
    mark: tuple[str, int] | None = None,
) -> Version:
    """Commit a batch of fact changes (keys, seq, op, ``l_orderkey``, price, discount) with the gold it makes.

    ``dims`` are orders, customer, nation and region. Keys are not NULL. A batch that ``mark``
    says is committed changes nothing; changes may come in any order and any split.
    """
    seen = open_version(spark, base)
    if is_repeated(seen, mark):
        return seen
    part = write_run(spark, latest_changes(changes, keys, seq), seen.base)
    run = spark.read.schema(changes.schema).parquet(f"{seen.base}/{part.folder}")
    held = seen.read(spark, TABLE) if TABLE in seen.tables else spark.createDataFrame([], changes.schema)
    line = changes.select(*dict.fromkeys([*keys, "l_orderkey"]), F.lit(0).cast("bigint").alias("revenue_cents"))
    orphans = seen.read(spark, ORPHANS) if ORPHANS in seen.tables else spark.createDataFrame([], line.schema)
    gold = seen.read(spark, GOLD) if GOLD in seen.tables else spark.createDataFrame([], GOLD_SCHEMA)
    # What was placed comes out where it was; what is new, and every orphan left, is placed now.
    placed = _placed(_touched(held, run, orphans, keys, seq), *dims).where("known OR after IS NOT NULL")
    # One group per nation, and one per line that has none: both are written by one job.
    own = [F.when(~F.col("known"), F.col(c)).alias(c) for c in line.columns[:-1]]
    n_lines = F.col("after").isNotNull().cast("bigint") - F.when(F.col("known"), F.col("before").isNotNull().cast("bigint")).otherwise(0)
    taken = F.when(F.col("known"), F.col("before.cents"))
    cents = F.coalesce(F.col("after.cents") - taken, F.col("after.cents"), -taken)
    lost = F.when(~F.col("known"), F.col("after.cents")).alias("lost")
    names = [F.when(F.col("known"), F.col(c)).alias(c) for c in ("r_name", "n_name")]
    summed = placed.groupBy("known", *names, *own, lost).agg(F.sum(n_lines).alias("n_lines"), F.sum(cents).alias("revenue_cents"))
    path = scratch_dir(spark, "placed")
    summed.write.parquet(path)
    summed = spark.read.schema(summed.schema).parquet(path)
    sums = gold.unionByName(summed.where("known").select(*gold.columns)).groupBy("r_name", "n_name")
    gold = sums.agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS]).where("n_lines != 0")
    times = F.explode(F.array_repeat(F.lit(0), F.col("n_lines").cast("int")))
    left = summed.where("not known").select(*line.columns[:-1], F.col("lost").alias("revenue_cents"), times.alias("__i")).drop("__i")
    current = with_run(spark, seen, part, changes, keys, seq)
    tables = {TABLE: current, GOLD: write_whole(gold, seen.base, GOLD), ORPHANS: write_whole(left, seen.base, ORPHANS)}
    return commit(spark, seen, tables, dict([mark] if mark else []))


def read_gold(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """Gold of one version as ``gold_revenue`` gives it: orphans are the row without names."""
    seen = open_version(spark, base, version)
    if GOLD not in seen.tables:
        return spark.createDataFrame([], GOLD_SCHEMA)
    none = F.lit(None).cast("string")
    orphans = seen.read(spark, ORPHANS).groupBy().agg(F.count(F.lit(1)).alias("n_lines"), F.sum("revenue_cents").alias("revenue_cents"))
    lost = orphans.where("n_lines > 0").select(none.alias("r_name"), none.alias("n_name"), *SUMS)
    return seen.read(spark, GOLD).unionByName(lost)
