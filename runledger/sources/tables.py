"""Parquet tables: reading, versioned writing, external registration."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def metadata_options(
    url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1
) -> dict[str, str]:
    """JDBC reader options for a metadata table, read in ``parts`` ranges of a numeric key.

    For ``spark.read.format("jdbc").options(...)``; filters of the run operators
    are pushed to the database. The driver of the database ships apart from Spark.
    """
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if parts > 1:
        if key is None:
            raise ValueError("reading in ranges needs a numeric key")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(parts),
        }
    return options


def write_version(df: DataFrame, path: str, version: str) -> str:
    """Write a new version of a table beside the old ones and return its folder.

    Parquet has no UPDATE; the version a job reads is never the one it writes.
    """
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def register_external(
    spark: SparkSession, paths: Mapping[str, str], database: str | None = None, prefix: str = ""
) -> DataFrame:
    """Register each folder as an external table; one row per table.

    A table that cannot be registered or counted gets a row with its error
    condition and does not hide the others, so each is its own small job: rows
    are counted from the file footers, several tables at a time. No data is ever
    deleted: a name that is taken by a managed table, a view or a table of another
    folder is an error row and stays as it is. An external table of the same folder
    is only refreshed.
    """

    def taken(table: str, path: str) -> str | None:
        """Why the name cannot be used, or None."""
        kinds = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        if kinds.get("Type") != "EXTERNAL":
            return "TABLE_NOT_EXTERNAL"
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def resolved(folder: str) -> str:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            return place.getFileSystem(conf).makeQualified(place).toString().rstrip("/")

        return None if resolved(kinds.get("Location", "")) == resolved(path) else "TABLE_OF_ANOTHER_FOLDER"

    def register(name: str) -> tuple[bool, int | None, str | None]:
        table = ".".join(f"`{p}`" for p in (database, f"{prefix}{name}") if p)
        location = paths[name].replace("\\", "\\\\").replace("'", "\\'")
        registered = False
        try:
            if spark.catalog.tableExists(table):
                if reason := taken(table, paths[name]):
                    return registered, None, reason
                spark.sql(f"REFRESH TABLE {table}")
            else:
                spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{location}'")
            registered = True
            return registered, spark.table(table).count(), None
        except PySparkException as exc:
            return registered, None, exc.getCondition() or type(exc).__name__
        except Py4JJavaError as exc:
            return registered, None, exc.java_exception.getClass().getSimpleName()

    with ThreadPoolExecutor(max_workers=4) as pool:
        outcomes = list(pool.map(register, paths))
    rows = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(registered).alias("registered"),
            F.lit(n_rows).cast("bigint").alias("n_rows"),
            F.lit(error).cast("string").alias("error"),
        )
        for name, (registered, n_rows, error) in zip(paths, outcomes)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
