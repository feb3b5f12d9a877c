"""Top rows per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this n Catalyst cuts every group inside each map task, before the shuffle.
MAP_SIDE_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group under ``order``, which must be total.

    A map task sends at most ``n`` rows of a group, however hot the group is.
    For an ``n`` beyond Catalyst's limit the group is first cut per salt, as many
    as there are shuffle partitions, which spreads it over all tasks and keeps the
    answer exact. Rows are salted by their columns that can be hashed.
    """
    rn = rank or "__rn"
    if n > int(df.sparkSession.conf.get(MAP_SIDE_LIMIT, "1000")):
        payload = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*payload), F.lit(salts)))
        by_salt = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            salted.withColumn("__rn_salt", F.row_number().over(by_salt))
            .where(F.col("__rn_salt") <= n)
            .drop("__salt", "__rn_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(window)).where(F.col(rn) <= n)
    return out if rank else out.drop(rn)
