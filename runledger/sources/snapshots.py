"""Published figures, read back under an explicit schema."""

from pyspark.sql import DataFrame, SparkSession

SNAPSHOT_SCHEMA = "run_id string, metric string, value bigint"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path)
