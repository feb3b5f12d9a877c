"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the whole test tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import cents, line_revenue_cents
from ..functions.text import contains_ignoring_case
from ..operators import cdc, compare, gates, logs, medallion, overlap, runs, scan
from ..session import scratch_dir
from ..sources import fixtures as fx
from ..sources.landing import landing_read, latest_day, missing_landings as missing, parse_payload
from ..sources.tables import read_table, register_external as register
from ..sources.versions import open_version
from ..streaming.cdc import cdc_stream as start_cdc_stream, read_current
from ..streaming.watch import first_of_each, watch_verdicts as watch
from .acceptance import accept_run, publish_and_read
from .ending import RUNS, TASKS, end_dags as end_jointly, publish_history
from .gold import apply_fact_changes, read_gold
from .verify import failed_run_report as report_failed_runs, tree_failure_report, verify_dags as verify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
STAR_TABLES = TABLES[:8]
AS_OF = "2024-02-01 00:00:00"
LICENSE_RULE = scan.ScanRule(
    "license",
    (
        scan.Exemption("(?i)licensed under the apache license"),
        scan.Exemption("(?i)mit license(?!-)"),
    ),
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Run history


@query
def run_state(spark, sf):
    """All runs plus one run per DAG that was never queued."""
    history = fx.dag_run(spark, sf)
    unknown = fx.dag(spark, sf).select(
        "dag_id", F.concat(F.lit("verify_"), F.col("dag_id")).alias("run_id")
    )
    return runs.run_state(history, history.select("dag_id", "run_id").unionByName(unknown))


@query
def in_flight_runs(spark, sf):
    return runs.in_flight_runs(fx.dag_run(spark, sf))


@query
def run_decision(spark, sf):
    return runs.run_decision(fx.dag(spark, sf), fx.dag_run(spark, sf))


@query
def run_verdict(spark, sf):
    return runs.run_verdict(fx.dag_run(spark, sf))


@query
def verify_dags(spark, sf):
    """Decided on the runs as they are, judged on the same runs some time later."""
    return verify(
        fx.dag(spark, sf),
        fx.dag_run(spark, sf),
        fx.dag_run_later(spark, sf),
        unpause=True,
        errors=fx.cli_line(spark, sf),
    )


@query
def unfinished_tasks(spark, sf):
    return runs.unfinished_tasks(fx.task_instance(spark, sf))


@query
def failed_tasks(spark, sf):
    return runs.failed_tasks(fx.task_instance(spark, sf))


@query
def fail_in_flight_tasks(spark, sf):
    return runs.fail_in_flight_tasks(fx.task_instance(spark, sf))


@query
def fail_in_flight_runs(spark, sf):
    history = fx.dag_run(spark, sf).withColumn("end_date", F.lit(None).cast("timestamp_ntz"))
    return runs.fail_in_flight_runs(history, F.lit(AS_OF).cast("timestamp_ntz"))


@query
def peak_overlap(spark, sf):
    return overlap.peak_overlap(fx.dag_run_span(spark, sf))


@query
def busy_spans(spark, sf):
    """When several runs of a DAG were in flight at once."""
    return overlap.busy_spans(fx.dag_run_span(spark, sf))


def _orders_stream(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    return spark.readStream.schema(orders.schema).parquet(f"{sf.rstrip('/')}/orders.parque[t]")


def _streamed(stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives by the end of its input, in append mode."""
    base = scratch_dir(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@query
def watch_verdicts(spark, sf):
    """Triggered runs met with their ends as two streams; runs still pending at the end are no rows."""
    triggered, _ = fx.run_ends(_orders_stream(spark, sf))
    _, ended = fx.run_ends(_orders_stream(spark, sf))
    verdicts = _streamed(watch(triggered, ended), "watch")
    return verdicts.withColumn("triggered_at", F.col("triggered_at").cast("timestamp_ntz"))


@query
def end_runs_of_dags(spark, sf):
    """The runs in flight of a few DAGs ended; the history of the others is not read."""
    wanted = [f"dag_{i}" for i in (4, 7, 13, 100)]
    runs_of = fx.dag_run(spark, sf).where(F.col("dag_id").isin(wanted))
    history = runs_of.withColumn("end_date", F.lit(None).cast("timestamp_ntz"))
    return runs.fail_in_flight_runs(history, F.lit(AS_OF).cast("timestamp_ntz"), wanted)


@query
def end_tasks_of_dags(spark, sf):
    """The same for the tasks of two DAGs."""
    wanted = ["dag_1", "dag_3"]
    tasks = fx.task_instance(spark, sf).where(F.col("dag_id").isin(wanted))
    return runs.fail_in_flight_tasks(tasks, wanted)


@query
def end_dags(spark, sf):
    """Tasks and runs of some DAGs ended by one commit; both tables as a reader sees them after it."""
    base = scratch_dir(spark, "history")
    history = fx.dag_run(spark, sf).withColumn("end_date", F.lit(None).cast("timestamp_ntz"))
    publish_history(spark, base, fx.task_instance(spark, sf), history)
    end_jointly(spark, base, [f"dag_{i}" for i in (1, 3, 4, 7, 13, 100)], F.lit(AS_OF).cast("timestamp_ntz"))
    seen = open_version(spark, base)
    tasks = seen.read(spark, TASKS).select("dag_id", "run_id", "task_id", "state")
    ended = seen.read(spark, RUNS).select("dag_id", "run_id", "state", "end_date")
    return tasks.unionByName(ended, allowMissingColumns=True)


@query
def single_owner(spark, sf):
    """Customers as bundles; their urgent open orders as the files in them."""
    files = (
        read_table(spark, sf, "orders")
        .where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
        .select(
            F.col("o_custkey").alias("bundle"),
            F.concat(F.lit("dags/run_"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias(
                "path"
            ),
        )
    )
    bundles = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("bundle"))
    return runs.single_owner(files, bundles, "bundle")


# Task logs


@query
def newest_attempt(spark, sf):
    return logs.newest_attempt(fx.task_attempt(spark, sf))


@query
def log_tail(spark, sf):
    return logs.log_tail(fx.doc_line(spark, sf), n=3, file_keys=["doc_id"])


@query
def log_tail_whole_text(spark, sf):
    """The same tails from one row per file, without a shuffle."""
    return logs.text_tail(fx.doc_text(spark, sf), n=3)


@query
def failure_report(spark, sf):
    files = fx.doc_text(spark, sf).withColumnRenamed("doc_id", "attempt_id")
    return logs.failure_report(
        fx.task_instance(spark, sf), fx.task_attempt(spark, sf), files, n=3
    )


@query
def log_tree_report(spark, sf):
    """The report from log files: listed by tasks, the newest attempt with a file read from its end."""
    base = scratch_dir(spark, "logs")
    fx.write_log_tree(spark, sf, base)
    report = tree_failure_report(spark, fx.task_instance(spark, sf), base, n=3, written_at="attempt", tie="path")
    attempt = F.regexp_extract("path", "attempt=([0-9]+)", 1).cast("bigint")
    return report.select("dag_id", "run_id", "task_id", attempt.alias("attempt_id"), "line_no", "line")


@query
def failed_run_report(spark, sf):
    files = fx.doc_text(spark, sf).withColumnRenamed("doc_id", "attempt_id")
    return report_failed_runs(
        fx.task_run(spark, sf),
        fx.task_instance(spark, sf),
        fx.task_attempt(spark, sf),
        files,
        n=3,
    )


@query
def import_error_lines(spark, sf):
    return logs.import_error_lines(fx.cli_line(spark, sf))


# Gates


@query
def non_empty(spark, sf):
    """Every table, and two feeds of the events, one of which never landed."""
    tables = {name: read_table(spark, sf, name) for name in TABLES}
    for feed in ("purchase", "refund"):
        tables[f"events/{feed}"] = tables["events"].where(F.col("event_type") == feed)
    return gates.non_empty(tables)


@query
def non_empty_groups(spark, sf):
    """DAGs without a run in flight."""
    busy = fx.dag_run(spark, sf).where(F.col("state").isin("running", "queued"))
    return gates.non_empty_groups(fx.dag(spark, sf), busy, "dag_id")


@query
def accepted_values(spark, sf):
    return gates.accepted_values(
        read_table(spark, sf, "events"),
        "event_type",
        ["view", "click", "signup", "error"],
        "event_id",
    )


@query
def required_keys(spark, sf):
    """Labels each document needs by its language; the fourth language needs none."""
    documents = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("entity"), F.col("lang").alias("kind")
    )
    labels = read_table(spark, sf, "labels")
    present = labels.select(
        F.col("doc_id").alias("entity"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("quality").isNotNull(), "quality"),
                    F.when(F.col("toxic") == 0, "clean"),
                )
            )
        ).alias("key"),
    )
    needed = {"en": ["quality", "clean"], "de": ["quality"], "fr": ["clean"]}
    return gates.required_keys(documents, needed, present)


LINEITEM_CONTRACT = gates.Contract(
    table="lineitem",
    columns={
        "l_orderkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "decimal(15,2)",
        "l_comment": "string",
    },
    not_null=("l_orderkey", "l_shipdate"),
    unique=("l_orderkey", "l_linenumber"),
    accepted={"l_returnflag": ["A", "R"], "l_linestatus": ["O", "F"]},
)
FACT_CONTRACT = gates.Contract(
    table="fact",
    columns={"l_orderkey": "bigint", "l_extendedprice": "double"},
    not_null=("l_orderkey", "l_extendedprice", "l_discount"),
    unique=("l_orderkey", "l_linenumber"),
    accepted={"l_returnflag": ["A", "N", "R"]},
)


@query
def contract_check(spark, sf):
    """The raw lines break their contract, the deduplicated ones keep theirs."""
    return gates.contract_check(read_table(spark, sf, "lineitem"), LINEITEM_CONTRACT).unionByName(
        gates.contract_check(fx.fact_dedup(spark, sf), FACT_CONTRACT)
    )


@query
def term_scan(spark, sf):
    return scan.term_scan(fx.doc_path(spark, sf), LICENSE_RULE)


@query
def term_scan_token(spark, sf):
    return scan.term_scan(fx.doc_path(spark, sf), scan.ScanRule("token"))


@query
def term_scan_scoped(spark, sf):
    """Some names are exempt in some paths only."""
    rule = scan.ScanRule(
        "license",
        (
            scan.Exemption("MIT License", literal=True, path_prefix="src1"),
            scan.Exemption("GNU [A-Z][a-z]+ Public License", path_prefix="src"),
            scan.Exemption("(?i)licensed under"),
        ),
    )
    return scan.term_scan(fx.doc_path(spark, sf), rule)


@query
def term_scan_in_scope(spark, sf):
    """The documents as files of a tree; one language and two folders are left out."""
    docs = read_table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias(
            "path"
        ),
        "text",
    )
    covered = docs.where(scan.in_scope(F.col("path"), [".de"], ["src1", "src7"]))
    return scan.term_scan(covered, LICENSE_RULE)


@query
def guard_selftest(spark, sf):
    """Lines labelled without the rule: any mention must hit, an exempt text must not."""
    docs = fx.doc_path(spark, sf)
    line = F.col("line")
    mentions = docs.where(contains_ignoring_case(F.col("text"), "license"))
    must_hit = scan.text_lines(mentions).where(contains_ignoring_case(line, "license"))
    must_miss = scan.text_lines(docs).where(
        contains_ignoring_case(line, "apache") | ~contains_ignoring_case(line, "license")
    )
    return scan.guard_selftest(LICENSE_RULE, must_hit, must_miss)


# Figures


def _line_figures(df: DataFrame) -> DataFrame:
    revenue = line_revenue_cents(F.col("l_extendedprice"), F.col("l_discount"))
    return medallion.figures(
        df, {"lines": F.count(F.lit(1)), "revenue_cents": F.sum(revenue)}, by=["l_suppkey"]
    )


def _order_figures(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum(cents(F.col("o_totalprice")))
    return medallion.figures(
        read_table(spark, sf, "orders"),
        {"orders": F.count(F.lit(1)), "order_cents": total},
        by=["o_orderstatus"],
    )


def _customer_figures(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.figures(read_table(spark, sf, "customer"), {"customers": F.count(F.lit(1))})


@query
def snapshot_compare(spark, sf):
    """Figures of the raw lines against those of the deduplicated ones."""
    actual = (
        _line_figures(read_table(spark, sf, "lineitem"))
        .unionByName(_customer_figures(spark, sf))
        .withColumn("run_id", F.lit("run_b"))
        .unionByName(_order_figures(spark, sf).withColumn("run_id", F.lit("run_a")))
    )
    suppliers = medallion.figures(
        read_table(spark, sf, "supplier"), {"suppliers": F.count(F.lit(1))}, by=["s_nationkey"]
    )
    expected = (
        _line_figures(fx.fact_dedup(spark, sf))
        .unionByName(_order_figures(spark, sf))
        .unionByName(suppliers)
    )
    return compare.snapshot_compare(actual, expected, "run_b")


FACT = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query
def compare_as_of(spark, sf):
    """Each run's figure against the value published last before it."""
    return compare.compare_as_of(*fx.priority_figures(spark, sf))


@query
def parity_by_digest(spark, sf):
    """The lines that the raw table repeats, from unequal buckets only."""
    raw = read_table(spark, sf, "lineitem").select(*FACT)
    return compare.parity_by_digest(raw, fx.fact_dedup(spark, sf).select(*FACT))


@query
def parity_gate(spark, sf):
    """Tables of unlike columns: the differences as rows, and the rows that differ in what they share."""
    raw = read_table(spark, sf, "lineitem").select(*FACT, "l_tax")
    fact = fx.fact_dedup(spark, sf).select(*FACT).withColumn("l_discount", F.col("l_discount").cast("float"))
    return compare.parity_gate(raw, fact)


@query
def parity_check(spark, sf):
    fact = fx.fact_dedup(spark, sf).select(*FACT)
    return compare.parity_check(fact, fact.where(F.col("l_linenumber") != 7))


@query
def parity_check_raw(spark, sf):
    """Which lines the raw table repeats, and how often."""
    raw = read_table(spark, sf, "lineitem").select(*FACT)
    return compare.parity_check(raw, fx.fact_dedup(spark, sf).select(*FACT))


# Medallion and change stream


@query
def landing_latest(spark, sf):
    last = latest_day(read_table(spark, sf, "events"), "ts")
    return parse_payload(last, "props", "k bigint").select(
        "event_id", "ts", "event_type", "k", "_corrupt_record"
    )


@query
def missing_landings(spark, sf):
    """Spans of days without a folder, and of days with an empty one, up to the last day of any feed."""
    landed = fx.landed(spark, sf)
    last = landed.agg(F.max("landing_date")).first()[0]
    return missing(landed, F.lit(last))


@query
def landing_json(spark, sf):
    """The events landed as JSON by date; the latest date read back under a schema."""
    path = scratch_dir(spark, "landing")
    read_table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("landing_date")
    ).write.partitionBy("landing_date").json(path)
    return landing_read(
        spark, path, "event_id bigint, user_id bigint, event_type string, value double"
    )


@query
def cdc_apply(spark, sf):
    return cdc.cdc_apply(fx.change(spark, sf), ["k"], ["seq"])


@query
def cdc_stream(spark, sf):
    """The same answer from the events read as a stream of files."""
    events = read_table(spark, sf, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", 1000)
        .parquet(f"{sf.rstrip('/')}/events.parque[t]")
    )
    changes = fx.change_rows(stream)
    base = scratch_dir(spark, "cdc")
    sink = f"{base}/changed"
    start_cdc_stream(changes, ["k"], ["seq"], sink, f"{base}/checkpoint").awaitTermination()
    return read_current(spark, sink, ["k"], ["seq"], changes.schema)


@query
def silver_dedup(spark, sf):
    return fx.fact_dedup(spark, sf).select(*FACT)


@query
def silver_stream(spark, sf):
    """One row per order from a stream in which every order comes twice."""
    orders = _orders_stream(spark, sf).select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    twice = orders.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    kept = _streamed(first_of_each(twice, ["o_orderkey"], "at", 86_400), "silver")
    return kept.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query
def gold_revenue(spark, sf):
    dims = [read_table(spark, sf, t) for t in ("orders", "customer", "nation", "region")]
    return medallion.gold_revenue(fx.fact_dedup(spark, sf), *dims)


@query
def gold_incremental(spark, sf):
    """Gold kept current from the raw lines as changes, in three batches that know no order."""
    base = scratch_dir(spark, "gold")
    dims = [read_table(spark, sf, t) for t in ("orders", "customer", "nation", "region")]
    changes = fx.fact_change(spark, sf)
    for i in range(3):
        batch = changes.where(F.pmod(F.xxhash64(*fx.FACT_SEQ, "l_orderkey"), F.lit(3)) == i)
        apply_fact_changes(spark, base, batch, dims, ["l_orderkey", "l_linenumber"], fx.FACT_SEQ, ("lines", i))
    return read_gold(spark, base)


@query
def register_external(spark, sf):
    paths = {name: f"{sf.rstrip('/')}/{name}.parquet" for name in STAR_TABLES}
    return register(spark, paths, prefix=f"ext_{zlib.crc32(sf.encode()):08x}_")


@query
def publish_snapshot(spark, sf):
    parts = [
        _line_figures(fx.fact_dedup(spark, sf)),
        _order_figures(spark, sf),
        _customer_figures(spark, sf),
    ]
    return publish_and_read(spark, "run_b", parts)


@query
def acceptance(spark, sf):
    """Publish the figures of the raw lines, then hold them against the right ones."""
    parts = [_line_figures(read_table(spark, sf, "lineitem")), _order_figures(spark, sf)]
    expected = _line_figures(fx.fact_dedup(spark, sf)).unionByName(_order_figures(spark, sf))
    return accept_run(spark, "run_b", parts, expected)
