"""Run history, change rows and log lines derived from the test tables.

The checks were written for an orchestrator's metadata, logs and feeds. These
views shape the given tables like them; each covers its whole table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import NEWLINE, split_lines
from ..operators.logs import TASK_KEYS, newest_attempt
from ..operators.medallion import silver_dedup
from .files import address, resolve
from .tables import read_table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def task_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many attempts per task; a purchase leaves the state NULL."""
    kind = F.col("event_type")
    third = F.col("event_id") % 3 == 0
    state = (
        F.when(kind == "view", "success")
        .when(kind == "error", "failed")
        .when((kind == "click") & third, "deferred")
        .when(kind == "click", "running")
        .when((kind == "signup") & third, "scheduled")
        .when(kind == "signup", "queued")
    )
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("dag_"), (F.col("user_id") % 5).cast("string")).alias("dag_id"),
        F.concat(F.lit("run_"), F.col("ts").cast("date").cast("string")).alias("run_id"),
        F.concat(F.lit("task_"), F.lpad((F.col("event_id") % 20).cast("string"), 2, "0")).alias(
            "task_id"
        ),
        state.alias("state"),
        F.col("event_id").alias("attempt_id"),
        F.col("ts").alias("attempt_ts"),
        F.col("props").alias("message"),
    )


def task_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_attempt(task_attempt(spark, sf_dir)).select(*TASK_KEYS, "state", "attempt_id")


def task_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs the task instances belong to: failed if a task is, else open or done."""
    state = F.col("state")
    return (
        task_instance(spark, sf_dir)
        .groupBy("dag_id", "run_id")
        .agg(
            F.count_if(state == "failed").alias("n_failed"),
            F.count_if(~state.eqNullSafe("success")).alias("n_open"),
        )
        .select(
            "dag_id",
            "run_id",
            F.when(F.col("n_failed") > 0, "failed")
            .when(F.col("n_open") > 0, "running")
            .otherwise("success")
            .alias("state"),
            F.lit(0).cast("bigint").alias("waited_s"),
        )
    )


def dag_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("o_orderstatus") == "O"
    state = (
        F.when(open_ & (F.col("o_orderpriority") == "1-URGENT"), "running")
        .when(open_ & (F.col("o_orderpriority") == "2-HIGH"), "queued")
        .when(F.col("o_orderstatus") == "P", "failed")
        .otherwise("success")
    )
    return read_table(spark, sf_dir, "orders").select(
        _id("dag_", "o_custkey").alias("dag_id"),
        _id("run_", "o_orderkey").alias("run_id"),
        state.alias("state"),
        F.col("o_orderdate").alias("start_date"),
        (F.col("o_orderkey") % 7200).alias("waited_s"),
    )


def dag_run_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs later: of those in flight a third succeeded, a third failed."""
    turn = F.substring_index("run_id", "_", -1).cast("bigint") % 3
    busy = F.col("state").isin("running", "queued")
    ended = F.when(busy & (turn == 0), "success").when(busy & (turn == 1), "failed")
    return dag_run(spark, sf_dir).withColumn("state", F.coalesce(ended, "state"))


def dag_run_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs with an end up to forty days after their start; those in flight have none."""
    days = (F.substring_index("run_id", "_", -1).cast("bigint") % 40).cast("int")
    end = F.when(~F.col("state").isin("running", "queued"), F.col("start_date") + F.make_dt_interval(days))
    return dag_run(spark, sf_dir).withColumn("end_date", end)


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred feeds and their folders by day; the folder of a day may hold nothing."""
    events = read_table(spark, sf_dir, "events")
    feed = F.concat_ws("/", "event_type", (F.col("user_id") % 40).cast("string"))
    size = F.when(F.col("event_id") % 5 < 3, F.length("props")).otherwise(0)
    return events.select(feed.alias("feed"), F.col("ts").cast("date").alias("landing_date"), size.cast("bigint").alias("size"))


def priority_figures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Figures of runs by priority, and the values published for each priority from a day on."""
    orders = read_table(spark, sf_dir, "orders")
    value = F.floor(F.col("o_totalprice") / 100000).cast("bigint").alias("value")
    metric = F.col("o_orderpriority").alias("metric")
    actual = orders.select(metric, F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), value)
    published = orders.where((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderstatus") != "P"))
    return actual, published.select(metric, F.col("o_orderdate").alias("valid_from"), value)


def run_ends(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs as they are triggered, and as they end; also from a stream of orders."""
    named = orders.select(
        _id("dag_", "o_custkey").alias("dag_id"),
        _id("run_", "o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("triggered_at"),
        "o_orderkey",
        "o_orderstatus",
    )
    state = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "F", "success")
    took = F.make_dt_interval(secs=(F.col("o_orderkey") % 7200).cast("decimal(18,6)"))
    ended = named.select("dag_id", "run_id", state.alias("state"), (F.col("triggered_at") + took).alias("finished_at"))
    return named.select("dag_id", "run_id", "triggered_at"), ended.where("state is not null")


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("c_custkey") % 50
    return read_table(spark, sf_dir, "customer").select(
        _id("dag_", "c_custkey").alias("dag_id"),
        (F.col("c_custkey") % 4 == 0).alias("is_paused"),
        (slot == 1).alias("has_import_error"),
        (~slot.isin(1, 2)).alias("scanned"),
    )


def change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_rows(read_table(spark, sf_dir, "events"))


def change_rows(events: DataFrame) -> DataFrame:
    """The neutral change row; also runs on a stream of events."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("k"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "c").when(kind == "error", "d").otherwise("u").alias("op"),
        "event_type",
        "value",
        "ts",
    )


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def doc_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents; also the log of the attempt with the document's id."""
    return split_lines(doc_text(spark, sf_dir), "text", NEWLINE)


def write_log_tree(spark: SparkSession, sf_dir: str, base: str) -> None:
    """The documents as log files of the attempts with their ids, written by tasks."""
    attempts = task_attempt(spark, sf_dir).select(*TASK_KEYS, "attempt_id")
    logs = doc_text(spark, sf_dir).withColumnRenamed("doc_id", "attempt_id").join(attempts, "attempt_id")
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in TASK_KEYS])
    root = address(spark, base)

    def write(batches):
        for batch in batches:
            for path, attempt, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "attempt_id", "text"))):
                system, place = resolve(f"{root}/{path}")
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/attempt={attempt}.log") as file:
                    file.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("attempt_id")], names=["attempt_id"])

    files = logs.select(folder.alias("folder"), "attempt_id", "text").mapInArrow(write, "attempt_id long")
    files.write.format("noop").mode("overwrite").save()


def doc_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``path`` is the source and the document id."""
    return read_table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text"
    )


def cli_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import-error listings with the three kinds of noise lines."""
    kind = F.col("event_type")
    line = (
        F.when(
            kind == "view",
            F.concat(
                F.col("ts").cast("date").cast("string"), F.lit("T00:00:00 INFO "), F.col("props")
            ),
        )
        .when(kind == "click", "No data found")
        .when(kind == "signup", "filepath | error")
        .otherwise(F.concat(F.lit("dags/"), kind, F.lit(".py | "), F.col("props")))
    )
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("dag_"), (F.col("user_id") % 5).cast("string")).alias("dag_id"),
        F.col("event_id").alias("line_no"),
        line.alias("line"),
    )


#: What puts the versions of a line in order; the last of them is the line of ``fact_dedup``.
FACT_SEQ = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def fact_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw line as a change of its order line."""
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *FACT_SEQ, F.lit("u").alias("op"), "l_discount"
    )


def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item per order line, all columns; readers prune what they do not use."""
    newest = [
        F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    ]
    return silver_dedup(
        read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], newest
    )
