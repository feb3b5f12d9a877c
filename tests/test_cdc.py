import random

import pytest
from pyspark.sql import functions as F

from runledger.operators.cdc import cdc_apply, latest_changes, repeated_changes
from runledger.sources.topics import message_changes, readable, unreadable
from runledger.sources.versions import committed, open_version
from runledger.streaming.cdc import TABLE, apply_changes, cdc_stream, due, read_current
from runledger.streaming.gates import counted, is_empty_batch, observe_rows

SCHEMA = "k bigint, seq bigint, op string, payload string"


def changes(seed, n=600, keys=40):
    rng = random.Random(seed)
    # A third of all changes are on one key.
    return [
        (0 if rng.random() < 0.33 else rng.randrange(1, keys), seq, rng.choice("cuuud"), f"p{seq}")
        for seq in range(n)
    ]


def current(rows):
    last = {}
    for k, seq, op, payload in sorted(rows, key=lambda r: r[1]):
        last[k] = (k, seq, op, payload)
    return sorted(r for r in last.values() if r[2] != "d")


def test_rules_of_applying(spark, rows):
    df = spark.createDataFrame(
        [
            (1, 1, "c", "a"), (1, 3, "d", None), (1, 2, "u", "late"),
            (2, 5, "u", "unknown key"),
            (3, 1, "d", None), (3, 2, "c", "again"),
            (4, 1, None, "no op"),
        ],
        SCHEMA,
    )
    assert rows(cdc_apply(df, ["k"], ["seq"])) == [
        (2, 5, "u", "unknown key"), (3, 2, "c", "again"), (4, 1, None, "no op"),
    ]


def test_order_and_repetition_do_not_matter(spark):
    data = changes(7)
    shuffled = random.Random(1).sample(data * 2, len(data) * 2)
    df = spark.createDataFrame(shuffled, SCHEMA)
    once = latest_changes(df, ["k"], ["seq"])
    assert sorted(map(tuple, cdc_apply(df, ["k"], ["seq"]).collect())) == current(data)
    assert sorted(map(tuple, cdc_apply(once, ["k"], ["seq"]).collect())) == current(data)


def land(spark, data, folder, parts, seed):
    """Land the changes as files in an order that has nothing to do with seq."""
    shuffled = random.Random(seed).sample(data, len(data))
    size = -(-len(shuffled) // parts)
    for i in range(parts):
        spark.createDataFrame(shuffled[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode(
            "append"
        ).parquet(folder)


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_stream_equals_batch_after_any_split_and_a_restart(spark, tmp_path, files_per_batch):
    data = changes(files_per_batch)
    landing, sink, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        stream = (
            spark.readStream.schema(SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(landing)
        )
        query = cdc_stream(stream, ["k"], ["seq"], sink, checkpoint)
        query.awaitTermination()
        return query

    try:
        half = len(data) // 2
        # The newer half lands first, so the second run brings only late changes.
        land(spark, data[half:], landing, 3, seed=5)
        progress = run().recentProgress
        assert len(progress) >= 3 // files_per_batch
        assert not progress[0].stateOperators  # the table is the state
        land(spark, data[:half], landing, 3, seed=6)
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = read_current(spark, sink, ["k"], ["seq"], SCHEMA)
    assert sorted(map(tuple, got.collect())) == current(data)


def test_rows_are_observed_without_a_second_pass(spark, tmp_path):
    df, seen = counted(spark.range(12))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["n_rows"] == 12

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    query = (
        observe_rows(stream, "landed")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    assert batches and not is_empty_batch(batches[0], "landed")
    assert is_empty_batch(batches[0], "another")


def test_equal_sequences_are_decided_alike_and_reported(spark):
    kind = "k int, seq int, op string, v string, more map<string,int>"
    changes = [(1, 5, "u", "a", {"x": 1}), (1, 5, "u", "b", {"x": 2}), (2, 1, "c", "c", None)]
    results = set()
    for order in (changes, changes[::-1]):
        df = spark.createDataFrame(order, kind).coalesce(1)
        results.add(tuple(sorted((r.k, r.v) for r in cdc_apply(df, ["k"], ["seq"]).collect())))
        report = repeated_changes(df, ["k"], ["seq"]).collect()
        assert [(r.gate, r.entity, r.detail) for r in report] == [("repeated_change", "k=1", "seq=5: 2 changes")]
    assert results == {((1, "b"), (2, "c"))}


def test_tombstones_delete_and_unreadable_messages_are_kept(spark):
    raw = spark.createDataFrame(
        [
            ('{"k": 1}', '{"k": 1, "seq": 1, "op": "c", "v": "a"}', 10),
            ('{"k": 2}', '{"k": 2, "seq": 2, "op": "c", "v": "b"}', 11),
            ('{"k": 1}', None, 12),
            ('{"k": 3}', "not json", 13),
            (None, None, 14),
            ("{", None, 15),
        ],
        "key string, value string, offset bigint",
    ).select(F.col("key").cast("binary"), F.col("value").cast("binary"), "offset")
    changes = message_changes(raw, "k int, seq bigint, op string, v string", ["k"])
    live = cdc_apply(readable(changes), ["k"], ["seq"]).collect()
    assert [(r.k, r.v) for r in live] == [(2, "b")]
    assert sorted(r[0] for r in unreadable(changes).collect()) == ["", "not json", "{"]


def test_runs_are_merged_so_that_each_is_larger_than_all_newer_ones():
    rng, runs = random.Random(1), []
    for _ in range(2000):
        runs.append(rng.choice([0, 1, 1, 5, 40]))
        start = due(runs)
        if start < len(runs):
            runs[start:] = [min(1000, sum(runs[start:]))]  # a merged run has a row per key at most
        assert all(runs[i] > sum(runs[i + 1 :]) for i in range(len(runs) - 1))
        assert len(runs) <= 11
    assert due([]) == 0 and due([3]) == 1 and due([3, 2]) == 2 and due([3, 3]) == 0 and due([9, 3, 3]) == 1


def test_two_hundred_batches_leave_a_bounded_table(spark, tmp_path):
    """A reader opens few files whatever the number of batches, and the answer is that of one batch."""
    data, sink = changes(3, n=1000, keys=60), str(tmp_path / "table")
    order = random.Random(4).sample(data, len(data))
    opened = []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i in range(200):
            batch = spark.createDataFrame(order[5 * i : 5 * i + 5], SCHEMA).coalesce(1)
            version = apply_changes(spark, sink, batch, ["k"], ["seq"], ("b", i), keep=10)
            opened.append(len(version.read(spark, TABLE).inputFiles()))
            if i in (20, 100, 199):
                got = read_current(spark, sink, ["k"], ["seq"], SCHEMA)
                assert sorted(map(tuple, got.collect())) == current(order[: 5 * i + 5])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert max(opened) <= 2 * 7  # log2(60) + 1 runs of two files at most
    assert len(committed(spark, sink)) <= 20  # old versions and their folders go
    assert len(list((tmp_path / "table" / TABLE).iterdir())) <= 60


def test_a_repeated_batch_changes_nothing_and_a_reader_keeps_its_version(spark, tmp_path):
    sink = str(tmp_path / "table")
    first = spark.createDataFrame([(1, 1, "c", "a"), (2, 1, "c", "b")], SCHEMA)
    second = spark.createDataFrame([(1, 2, "d", None), (3, 1, "c", "c")], SCHEMA)
    one = apply_changes(spark, sink, first, ["k"], ["seq"], ("s", 0))
    before = read_current(spark, sink, ["k"], ["seq"], SCHEMA)
    apply_changes(spark, sink, second, ["k"], ["seq"], ("s", 1))
    again = apply_changes(spark, sink, second, ["k"], ["seq"], ("s", 1))
    assert again.number == 2 and committed(spark, sink) == [1, 2]
    assert sorted(r.k for r in before.collect()) == [1, 2]  # opened before, still whole
    assert sorted(r.k for r in read_current(spark, sink, ["k"], ["seq"], SCHEMA).collect()) == [2, 3]
    old = read_current(spark, sink, ["k"], ["seq"], SCHEMA, version=one.number)
    assert sorted(r.k for r in old.collect()) == [1, 2]
    # A late older change of another writer does not revive the key.
    late = spark.createDataFrame([(1, 1, "u", "late")], SCHEMA)
    apply_changes(spark, sink, late, ["k"], ["seq"], ("other", 0))
    assert sorted(r.k for r in read_current(spark, sink, ["k"], ["seq"], SCHEMA).collect()) == [2, 3]
    assert open_version(spark, sink).marks == {"s": 1, "other": 0}


def test_batches_without_rows_and_a_table_that_is_not_there(spark, tmp_path):
    sink = str(tmp_path / "table")
    assert read_current(spark, sink, ["k"], ["seq"], SCHEMA).collect() == []
    none = spark.createDataFrame([], SCHEMA)
    apply_changes(spark, sink, none, ["k"], ["seq"])
    assert read_current(spark, sink, ["k"], ["seq"], SCHEMA).collect() == []
    apply_changes(spark, sink, spark.createDataFrame([(1, 1, "c", "a")], SCHEMA), ["k"], ["seq"])
    apply_changes(spark, sink, none, ["k"], ["seq"])
    assert [r.k for r in read_current(spark, sink, ["k"], ["seq"], SCHEMA).collect()] == [1]
