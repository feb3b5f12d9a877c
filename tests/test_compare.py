import collections
import random

import pytest

from pyspark.sql import functions as F

from runledger.operators.compare import (
    SchemaDifference,
    compare_as_of,
    parity_by_digest,
    parity_check,
    parity_gate,
    schema_differences,
    snapshot_compare,
)


def test_every_status_of_a_snapshot(spark, rows):
    actual = spark.createDataFrame(
        [
            ("r2", "same", 1), ("r2", "other", 2), ("r2", "new", 3), ("r1", "old", 4),
            ("r2", "null_both", None), ("r2", "null_here", None), (None, "no_run", 5),
        ],
        "run_id string, metric string, value bigint",
    )
    expected = spark.createDataFrame(
        [
            ("same", 1), ("other", 9), ("gone", 7), ("old", 4), ("null_both", None),
            ("null_here", 0), ("no_run", 5), ("null_gone", None),
        ],
        "metric string, value bigint",
    )
    got = {r[0]: r[3] for r in rows(snapshot_compare(actual, expected, "r2"))}
    assert got == {
        "same": "match", "other": "differ", "new": "unexpected", "old": "stale", "gone": "missing",
        "null_both": "match", "null_here": "differ", "no_run": "stale", "null_gone": "missing",
    }
    untimed = {r[0]: r[3] for r in rows(snapshot_compare(actual.drop("run_id"), expected))}
    assert untimed["old"] == "match" and untimed["no_run"] == "match"


def test_parity_counts_surplus_copies_per_side(spark):
    rng = random.Random(3)
    a = [(rng.choice([1, 2, None]), rng.choice(["x", "y"])) for _ in range(200)]
    b = [(rng.choice([1, 2, None]), rng.choice(["x", "z"])) for _ in range(150)]
    schema = "n int, s string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {(r.side, r.n, r.s): r.copies for r in parity_check(left, right).collect()}
    ca, cb = collections.Counter(a), collections.Counter(b)
    want = {("left", *k): v for k, v in (ca - cb).items()}
    want |= {("right", *k): v for k, v in (cb - ca).items()}
    assert got == want
    # The same difference as EXCEPT ALL gives, either way round.
    assert left.exceptAll(right).count() == sum(v for k, v in got.items() if k[0] == "left")
    swapped = parity_check(right.select("s", "n"), left)
    assert {(r.side, r.n, r.s) for r in swapped.collect()} == {
        ({"left": "right", "right": "left"}[side], n, s) for side, n, s in got
    }


def test_a_table_equals_itself(spark):
    df = spark.range(1000).withColumn("m", F.col("id") % 7)
    assert parity_check(df, df.repartition(5)).isEmpty()


def test_schemas_are_part_of_the_parity(spark):
    left = spark.createDataFrame([(1,)], "x int")
    for right in (
        spark.createDataFrame([(1, 2)], "x int, extra int"),
        spark.createDataFrame([("1",)], "x string"),
        spark.createDataFrame([(1,)], "y int"),
    ):
        assert schema_differences(left, right) and schema_differences(right, left)
        with pytest.raises(SchemaDifference):
            parity_check(left, right)
    assert schema_differences(left, left) == [] and parity_check(left, left).isEmpty()


AT = "2024-01-%02d 00:00:00"


def test_figures_against_the_value_valid_at_their_time(spark):
    actual = spark.createDataFrame(
        [
            ("m", 1, AT % 1, 5), ("m", 2, AT % 2, 5), ("m", 3, AT % 3, 6), ("m", 4, "2024-03-01 00:00:00", 7),
            ("m", 5, "2024-03-01 00:00:00", None), ("n", 6, AT % 9, 1), ("o", 7, AT % 9, None), (None, 8, AT % 9, 1), ("m", 9, None, 1),
        ],
        "metric string, run_id int, at string, value bigint",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    expected = spark.createDataFrame(
        [("m", AT % 2, 5), ("m", AT % 3, 4), ("m", AT % 3, 6), ("m", "2024-02-01 00:00:00", 7), ("n", AT % 10, 1), ("o", AT % 1, None), (None, AT % 1, 1)],
        "metric string, valid_from string, value bigint",
    ).withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))
    for slot in ("day", "month", "year"):
        found = {r.run_id: (r.expected_value, r.status) for r in compare_as_of(actual, expected, slot).collect()}
        assert found == {
            1: (None, "unexpected"), 2: (5, "match"), 3: (6, "match"), 4: (7, "match"), 5: (7, "differ"),
            6: (None, "unexpected"), 7: (None, "match"),
        }
    assert {r.status for r in compare_as_of(actual, expected.limit(0)).collect()} == {"unexpected"}
    assert compare_as_of(actual.limit(0), expected).collect() == []


def test_parity_by_digest_equals_parity(spark, rows):
    left = spark.createDataFrame([(i % 50, f"v{i % 70}", None if i % 9 else 1.5) for i in range(500)], "a int, b string, c double")
    right = left.where("a != 7").unionByName(left.where("a = 3")).unionByName(spark.createDataFrame([(1, None, None)], left.schema))
    for x, y in ((left, right), (right, left), (left, left), (left, left.limit(0)), (left.limit(0), left.limit(0))):
        for buckets in (1, 7, 4096):
            assert rows(parity_by_digest(x, y, buckets)) == rows(parity_check(x, y))
    # A row that comes twice more on one side does not cancel.
    twice = left.unionByName(left.where("a = 5")).unionByName(left.where("a = 5"))
    assert rows(parity_by_digest(twice, left)) == rows(parity_check(twice, left)) != []


def test_equal_tables_shuffle_digests_only(spark):
    left = spark.range(20_000).withColumn("v", F.repeat(F.lit("x"), 200))
    found = parity_by_digest(left, left.where("id >= 0"), buckets=16)
    assert found.count() == 0
    assert shuffled(found) < 1000  # rows written by all exchanges


def shuffled(df):
    """Rows that the exchanges of a plan that has run wrote."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, open_ = 0, [plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while open_:
        node = open_.pop()
        if "QueryStage" in node.nodeName():
            open_.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return total


def test_schema_differences_are_rows_beside_those_that_differ(spark):
    left = spark.createDataFrame([(1, 2, "x"), (3, 4, "y")], "a int, b int, c string")
    right = spark.createDataFrame([(1, 2.0, "z"), (9, 4.0, "y")], "a int, b double, d string")
    found = sorted(tuple(r) for r in parity_gate(left, right).collect())
    assert found == [
        ("parity", "left", "1 rows on this side only, by a"),
        ("parity", "right", "1 rows on this side only, by a"),
        ("schema", "b", "b is int on the left and double on the right"),
        ("schema", "c", "c is in the left table only"),
        ("schema", "d", "d is in the right table only"),
    ]
    assert parity_gate(left, left).collect() == []
    assert [r.gate for r in parity_gate(left.select("c"), right.select("d")).collect()] == ["schema", "schema"]
