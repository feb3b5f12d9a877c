"""Versions under a manifest, and the ending of tasks and runs in one of them."""

import datetime
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from runledger.plans import ending
from runledger.plans.ending import RUNS, TASKS, end_dags, publish_history
from runledger.sources import versions
from runledger.sources.versions import VersionTaken, commit, committed, expire, open_version, unused_folders, write_buckets

TI = "dag_id string, run_id string, task_id string, state string"
RUN = "dag_id string, run_id string, state string, end_date timestamp_ntz"


def end(spark, base, dags):
    return end_dags(spark, base, dags, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


def files(base, name):
    return {str(p.relative_to(base)) for p in pathlib.Path(base, name).rglob("*.parquet")}


@pytest.fixture
def history(spark, tmp_path):
    base = str(tmp_path / "history")
    states = ["running", "queued", "scheduled", "deferred", "success", "failed", None]
    ti = [(f"d{i % 20}", f"r{i % 3}", f"t{i}", states[i % 7]) for i in range(400)]
    runs = [(f"d{i}", f"r{j}", ["running", "queued", "success"][(i + j) % 3], None) for i in range(20) for j in range(3)]
    publish_history(spark, base, spark.createDataFrame(ti, TI), spark.createDataFrame(runs, RUN), buckets=8)
    return base, ti, runs


def test_tasks_and_runs_end_in_one_version(spark, rows, history):
    base, ti, runs = history
    before = {name: files(base, name) for name in (TASKS, RUNS)}
    version = end(spark, base, ["d3", "d4"])
    assert version.number == 2 and open_version(spark, base).number == 2
    hit = {"d3", "d4"}
    busy = {"running", "queued", "scheduled", "deferred"}
    want = [(d, r, t, "failed" if d in hit and s in busy else s) for d, r, t, s in ti]
    assert rows(version.read(spark, TASKS)) == rows(spark.createDataFrame(want, TI))
    day = datetime.datetime(2024, 2, 1)
    ended = [(d, r, "failed", day) if d in hit and s in ("running", "queued") else (d, r, s, e) for d, r, s, e in runs]
    assert rows(version.read(spark, RUNS)) == rows(spark.createDataFrame(ended, RUN))
    # The version before is still whole, and no file of it was touched.
    assert rows(open_version(spark, base, 1).read(spark, TASKS)) == rows(spark.createDataFrame(ti, TI))
    assert all(before[name] <= files(base, name) for name in before)


def test_untouched_buckets_keep_their_files(spark, history):
    base, _, _ = history
    old = open_version(spark, base)
    new = end(spark, base, ["d3"])
    for name in (TASKS, RUNS):
        kept = set(old.tables[name].parts) & set(new.tables[name].parts)
        assert len(old.tables[name].parts) - len(kept) == 1  # one DAG lies in one bucket
        opened = {os.path.basename(f) for f in new.read(spark, name).inputFiles()}
        assert {os.path.basename(f) for p in kept for f in files(base, p.folder)} <= opened


def test_a_reader_between_the_two_writes_sees_neither(spark, rows, history, monkeypatch):
    base, ti, runs = history
    seen = []

    def write(*args):
        table = write_buckets(*args)
        now = open_version(spark, base)
        seen.append((now.number, rows(now.read(spark, TASKS)), rows(now.read(spark, RUNS))))
        return table

    monkeypatch.setattr(ending, "write_buckets", write)
    end(spark, base, ["d1", "d2"])
    whole = (1, rows(spark.createDataFrame(ti, TI)), rows(spark.createDataFrame(runs, RUN)))
    assert seen == [whole, whole]


def test_nothing_in_flight_makes_no_version(spark, history):
    base, _, _ = history
    assert end(spark, base, ["unknown"]).number == 1
    assert end(spark, base, []).number == 1
    end(spark, base, ["d5"])
    assert end(spark, base, ["d5"]).number == 2


def test_of_two_writers_one_is_told(spark, history):
    base, _, _ = history
    seen = open_version(spark, base)
    commit(spark, seen, {}, {"first": 1})
    with pytest.raises(VersionTaken):
        commit(spark, seen, {}, {"second": 1})
    assert open_version(spark, base).marks == {"first": 1}
    assert not [n for n in os.listdir(f"{base}/{versions.MANIFESTS}") if n.startswith(".") and not n.endswith(".crc")]


def test_old_versions_and_lost_writes_go_and_the_newest_stays(spark, rows, history):
    base, _, _ = history
    write_buckets(spark.createDataFrame([("d", "r", "t", "lost")], TI), base, TASKS, ["dag_id"], 8)  # never committed
    for dag in ("d1", "d2", "d3"):
        version = end(spark, base, [dag])
    want = rows(version.read(spark, TASKS)), rows(version.read(spark, RUNS))
    assert len(unused_folders(spark, base)) >= 1
    expire(spark, base, keep=2)
    assert committed(spark, base) == [3, 4] and not unused_folders(spark, base, 2)
    newest = open_version(spark, base)
    assert (rows(newest.read(spark, TASKS)), rows(newest.read(spark, RUNS))) == want


def test_a_bucket_is_read_alone_and_a_null_key_has_one(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), (None, 4)], "dag_id string, v int")
    table = write_buckets(df, base, "t", ["dag_id"], 4)
    version = commit(spark, open_version(spark, base), {"t": table})
    assert sum(p.rows for p in table.parts) == 4
    assert sorted(r.v for r in version.read(spark, "t").collect()) == [1, 2, 3, 4]
    alone = [version.read(spark, "t", [p.bucket]).count() for p in table.parts]
    assert alone == [p.rows for p in table.parts]
    empty = write_buckets(df.limit(0), base, "t", ["dag_id"], 4)
    assert commit(spark, version, {"t": empty}).read(spark, "t").collect() == []
