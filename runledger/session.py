"""Session helpers: the shared scratch folder and the session used by tests and the bench."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _local_base() -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="runledger-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach, for tables written between two jobs.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a
    ``local[...]`` session may fall back to a folder of this machine. What is
    written there is removed when the session's JVM ends, not before: frames that
    read it are lazy.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return f"{base.rstrip('/')}/{folder.getName()}/t"


def local_session(app: str, cpus: str = "8", **conf: str) -> SparkSession:
    """The single-JVM session of the tests and of ``bench.py``."""
    settings = {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "localhost",
        "spark.driver.bindAddress": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
