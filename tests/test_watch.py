"""Verdicts and single rows from streams, whatever the batches they come in."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from runledger.operators.runs import run_verdict
from runledger.streaming.watch import dropped_late, first_of_each, watch_verdicts

START = datetime.datetime(2024, 1, 1)
TRIGGERED = "dag_id string, run_id string, triggered_at timestamp"
FINISHED = "dag_id string, run_id string, state string, finished_at timestamp"


def land(spark, rows, schema, folder, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, mode="append"):
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query, df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("parts", [1, 4])
def test_verdicts_of_a_watch_are_those_of_the_batch(spark, tmp_path, two_partitions, parts):
    rng, triggered, finished, late = random.Random(parts), [], [], 4 * 3600
    for i in range(120):
        at = START + datetime.timedelta(minutes=10 * i)
        triggered.append((f"d{i % 7}", f"r{i}", at))
        took = rng.choice([60, 3599, 3600, 3601, 9000, None])
        if took is not None:
            state = rng.choice(["success", "failed", "running"])
            finished.append((f"d{i % 7}", f"r{i}", state, at + datetime.timedelta(seconds=took)))
    finished.append(("other", "run", "success", START))  # nobody asked for it
    finished.sort(key=lambda r: (r[3] + datetime.timedelta(seconds=rng.randrange(late // 2))))  # ends arrive late
    # Both streams go on for a while, so that every run above passes its timeout.
    end = START + datetime.timedelta(hours=60)
    triggered.append(("d", "last", end))
    finished.append(("d", "last", "success", end))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    land(spark, triggered, TRIGGERED, a, parts)
    land(spark, finished, FINISHED, b, parts)
    _, out = run(watch_verdicts(stream(spark, TRIGGERED, a), stream(spark, FINISHED, b), late_s=late), tmp_path)
    # The same rows as one table, each run as it stood when its time was over.
    ended = {(d, r): (s, f) for d, r, s, f in finished}
    table = []
    for dag, name, at in triggered:
        state, when = ended.get((dag, name), (None, None))
        waited = 3601 if when is None or state == "running" else int((when - at).total_seconds())
        table.append((dag, name, state if waited <= 3600 else "running", waited))
    runs = spark.createDataFrame(table, "dag_id string, run_id string, state string, waited_s bigint")
    want = {(r.dag_id, r.run_id): (r.verdict, r.passed) for r in run_verdict(runs).collect()}
    got = {(r.dag_id, r.run_id): (r.verdict, r.passed) for r in out.collect()}
    assert out.count() == len(got) == 121 and got == want
    assert {v for v, _ in got.values()} == {"success", "failed", "no_verdict"}


def test_a_run_whose_time_is_not_over_is_pending(spark, tmp_path, two_partitions):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    land(spark, [("d", "open", START), ("d", "done", START)], TRIGGERED, a, 1)
    land(spark, [("d", "done", "success", START + datetime.timedelta(seconds=5))], FINISHED, b, 1)
    _, out = run(watch_verdicts(stream(spark, TRIGGERED, a), stream(spark, FINISHED, b)), tmp_path)
    assert [(r.run_id, r.verdict) for r in out.collect()] == [("done", "success")]


def test_one_row_per_key_of_a_stream_and_late_ones_counted(spark, tmp_path, two_partitions):
    hours = lambda n: START + datetime.timedelta(hours=n)
    first = [(k, hours(k % 3), "a") for k in range(20)] * 2
    later = [(k, hours(4), "b") for k in range(5)] + [(99, hours(30), "a")]
    folder, schema = str(tmp_path / "in"), "k int, at timestamp, v string"
    land(spark, first, schema, folder, 1)
    land(spark, later, schema, folder, 1)
    land(spark, [(99, hours(30), "again")], schema, folder, 1)  # rows are late by the watermark of the batch before
    land(spark, [(500, hours(1), "late"), (501, hours(31), "in time")], schema, folder, 1)
    query, out = run(first_of_each(stream(spark, schema, folder), ["k"], "at", 24 * 3600), tmp_path)
    kept = {r.k: r.v for r in out.collect()}
    assert kept == {**{k: "a" for k in range(20)}, 99: "a", 501: "in time"} and out.count() == len(kept)
    assert dropped_late(query) == 1
