"""Names, sizes and times from the file system itself, files of length zero included.

Spark's readers leave empty files out of a scan, so what an empty file means is
asked here. Only names travel; a caller lists the folders it asks about.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def place_of(spark: SparkSession, path: str):
    """A path and the file system it lies in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, base: str) -> list[str]:
    """Names of the folders right below ``base``; none if it is not there."""
    place, system = place_of(spark, base)
    found = system.listStatus(place) if system.exists(place) else []
    return sorted(s.getPath().getName() for s in found if s.isDirectory())
