"""Plans hold at scale: what is narrow stays narrow, groups are cut before the shuffle."""

import os
import re

import pytest
from pyspark.sql import functions as F

from runledger.plans.oracle import ORACLE as SQL
from runledger.plans.registry import QUERIES
import oracle
from conftest import TESTDATA
from runledger.functions.ranking import top_per_group
from runledger.operators import cdc, compare, gates, logs, runs, scan

SF = f"{TESTDATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """The test tables as folders of several files, rows in random order."""
    base = tmp_path_factory.mktemp("spread")
    for name in os.listdir(SF):
        spark.read.parquet(f"{SF}/{name}").repartition(5).write.parquet(str(base / name))
    return str(base)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_answer_from_many_files_without_broadcast(spark, spread, no_broadcast, name):
    problems, _ = oracle.compare(QUERIES[name](spark, spread), oracle.connect(SF), SQL[name])
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"cdc_stream"}))
def test_no_pair_joins_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    pairs, python = ("NestedLoop", "Cartesian"), ("EvalPython", "InPandas", "ExistingRDD")
    for node in pairs + python:
        assert node not in text


@pytest.mark.parametrize(
    "name",
    ["run_verdict", "fail_in_flight_runs", "accepted_values", "term_scan", "term_scan_scoped",
     "guard_selftest", "log_tail_whole_text"],
)
def test_row_by_row_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize(
    "name",
    ["newest_attempt", "unfinished_tasks", "failure_report", "log_tail", "import_error_lines",
     "in_flight_runs", "silver_dedup", "gold_revenue"],
)
def test_groups_are_cut_before_they_travel(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for window in re.split(r"(?= Window \[)", text)[1:]:
        shuffle = window.index("Exchange hashpartitioning")
        assert "WindowGroupLimit" in window[shuffle:] and "Partial" in window[shuffle:]


def test_one_shuffle_for_both_sides_of_a_difference(spark):
    df = spark.range(10)
    assert plan(compare.parity_check(df, df.where("id > 3"))).count("Exchange hashpart") == 1


def test_a_contract_reads_its_table_once(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    contract = gates.Contract(
        "orders", {"o_orderkey": "bigint"}, ("o_custkey",), ("o_orderkey",),
        {"o_orderstatus": ["O", "F", "P"]},
    )
    text = plan(gates.contract_check(df, contract))
    assert text.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in text


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderpriority").alias("dag_id"),
        F.col("o_orderstatus").alias("run_id"),
        F.col("o_orderstatus").alias("state"),
        F.lit("t").alias("task_id"),
        "o_totalprice",
    )
    text = plan(runs.failed_tasks(orders, "5-LOW"))
    assert "EqualTo(o_orderpriority,5-LOW)" in text and "EqualTo(o_orderstatus,failed)" in text
    assert "o_totalprice" not in text
    dags = spark.createDataFrame(
        [], "dag_id string, is_paused boolean, has_import_error boolean, scanned boolean"
    )
    assert "In(o_orderstatus, [queued,running])" in plan(runs.run_decision(dags, orders))


def test_texts_are_split_once_and_only_where_the_term_occurs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "path")
    text = plan(scan.term_scan(docs, scan.ScanRule("license")))
    body = text[: text.index("FileScan")]
    assert body.count("split(") == 1
    assert body.index("split(") < body.index("Contains(lower(text")


# A third of all rows on one key.


@pytest.fixture(scope="module")
def hot(spark):
    n = 90_000
    return spark.range(n, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 17 == 0, "d").otherwise("u").alias("op"),
    )


def rows_into_the_shuffles(df):
    """Records written by each exchange of an executed plan."""
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution()
    plan_ = text.executedPlan()
    plan_.execute().count()
    out = []

    def walk(node):
        name = node.nodeName()
        if name in ("AdaptiveSparkPlan",):
            return walk(node.executedPlan())
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            return walk(node.plan())
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan_)
    return out


def test_a_hot_key_is_reduced_before_the_shuffle(spark, hot, no_broadcast):
    total, per_task = 90_000, 16 * 1001
    contract = gates.Contract("t", {"k": "bigint"}, ("op",), ("k",))
    cases = {
        "dedup": top_per_group(hot, ["k"], [F.col("seq").desc()], 1),
        "cdc": cdc.cdc_apply(hot, ["k"], ["seq"]),
        "contract": gates.contract_check(hot, contract),
        "groups": gates.non_empty_groups(hot.select("k").distinct(), hot, "k"),
        "parity": compare.parity_check(hot.select("k"), hot.select("k")),
    }
    for name, df in cases.items():
        written = rows_into_the_shuffles(df)
        assert written and max(written) <= 2 * per_task < total, (name, written)


def test_a_hot_file_is_cut_to_its_tail_in_every_task(spark, hot):
    lines = hot.select(
        F.col("k").alias("attempt_id"), F.col("seq").alias("line_no"), F.col("op").alias("line")
    )
    tails = logs.log_tail(lines.where("attempt_id = 0"), 5)
    assert max(rows_into_the_shuffles(tails)) <= 16 * 5
    assert [r[0] for r in tails.select("line_no").orderBy("line_no").collect()] == [
        89_985, 89_988, 89_991, 89_994, 89_997
    ]


def test_hot_keys_give_exact_answers(spark, hot):
    latest = {r.k: r.seq for r in cdc.latest_changes(hot, ["k"], ["seq"]).collect()}
    want = {}
    for i in range(90_000):
        want[0 if i % 3 == 0 else i % 1000] = i
    assert latest == want
    busy = hot.select(
        F.concat(F.lit("d"), "k").alias("dag_id"),
        F.col("seq").cast("string").alias("run_id"),
        F.lit("queued").alias("state"),
        F.col("seq").alias("start_date"),
    )
    top = runs.in_flight_runs(busy).where("dag_id = 'd0'").orderBy("pos").collect()
    n_hot = sum(1 for i in range(90_000) if i % 3 == 0 or i % 1000 == 0)
    assert [(r.n_in_flight, r.run_id) for r in top] == [(n_hot, "0"), (n_hot, "3"), (n_hot, "6")]


def test_a_repeated_question_is_one_row_per_task(spark, no_broadcast):
    ids = spark.range(120_000, numPartitions=12).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 300).cast("string").alias("run_id"),
        F.when(F.col("id") >= 0, "d").alias("dag_id"),
    )
    history = ids.distinct().withColumn("state", F.lit("success"))
    found = runs.run_state(history, ids)
    assert max(rows_into_the_shuffles(found)) <= 12 * 101
    assert found.where("state = 'success'").count() == 100

    entities = ids.select(F.col("run_id").alias("entity"), F.lit("api").alias("kind"))
    pins = spark.range(50_000).select((F.col("id") % 2).cast("string").alias("key"))
    missing = gates.required_keys(entities, {"api": ["1", "2"]}, pins)
    assert max(rows_into_the_shuffles(missing)) <= 2 * 12 * 101
    assert missing.count() == 100


def test_tasks_without_an_attempt_do_not_pile_up(spark, no_broadcast):
    ti = spark.range(60_000, numPartitions=12).select(
        F.lit("d").alias("dag_id"),
        F.lit("r").alias("run_id"),
        F.col("id").cast("string").alias("task_id"),
        F.lit("failed").alias("state"),
    )
    attempts = ti.where("cast(task_id as int) % 2 = 0").select(
        "dag_id", "run_id", "task_id", F.col("task_id").cast("bigint").alias("attempt_id"),
        F.lit(1).alias("attempt_ts"),
    )
    tails = attempts.select("attempt_id", F.lit(1).alias("line_no"), F.lit("x").alias("line"))
    report = logs.failure_report(ti, attempts, tails)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = report.groupBy(F.spark_partition_id(), "line").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(per_task) == 16 and sum(r["count"] for r in per_task) == 60_000
    assert max(r["count"] for r in per_task) < 1.2 * 60_000 / 16
    assert report.where("line = 'x'").count() == 30_000
