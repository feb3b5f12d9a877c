"""Gold from changes equals gold from the whole fact, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from runledger.functions.money import line_revenue_cents
from runledger.operators.cdc import cdc_apply
from runledger.operators.medallion import gold_revenue
from runledger.plans.gold import GOLD, ORPHANS, _placed, _touched, apply_fact_changes, read_gold
from runledger.sources.versions import open_version

SCHEMA = "l_orderkey int, l_linenumber int, seq int, op string, l_extendedprice double, l_discount double"
KEYS, SEQ = ["l_orderkey", "l_linenumber"], ["seq"]


@pytest.fixture
def dims(spark):
    orders = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(30)], "o_orderkey int, o_custkey int")
    customer = spark.createDataFrame([(i, i % 4) for i in range(6)], "c_custkey int, c_nationkey int")  # customer 6 is missing
    nation = spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string")
    return [orders, customer, nation, region]


def changes(seed, n):
    rng = random.Random(seed)
    # A third of all changes are of one line; orders from 30 on are missing.
    return [
        (3 if rng.random() < 0.33 else rng.randrange(34), rng.randrange(3), seq, rng.choice("cuuud"), rng.randrange(1, 9000) / 100, rng.choice([0.0, 0.1]))
        for seq in range(n)
    ]


def by_name(df):
    return {(r.r_name, r.n_name): (r.n_lines, r.revenue_cents) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 4])
def test_gold_of_any_split_is_that_of_the_whole_fact(spark, tmp_path, dims, batches):
    data = changes(batches, 240)
    order = random.Random(2).sample(data, len(data))  # late changes come in later batches
    base, size = str(tmp_path / "gold"), -(-len(order) // batches)
    for i in range(batches):
        part = spark.createDataFrame(order[i * size : (i + 1) * size], SCHEMA)
        apply_fact_changes(spark, base, part, dims, KEYS, SEQ, ("w", i))
        fact = cdc_apply(spark.createDataFrame(order[: (i + 1) * size], SCHEMA), KEYS, SEQ)
        want = by_name(gold_revenue(fact, *dims))
        assert by_name(read_gold(spark, base)) == want and (None, None) in want
    again = apply_fact_changes(spark, base, part, dims, KEYS, SEQ, ("w", batches - 1))
    assert again.number == batches and by_name(read_gold(spark, base)) == want
    # Gold and orphans add up to the fact.
    version = open_version(spark, base)
    total = version.read(spark, GOLD).agg(F.sum("revenue_cents")).first()[0] + version.read(spark, ORPHANS).agg(F.sum("revenue_cents")).first()[0]
    assert total == fact.agg(F.sum(line_revenue_cents(F.col("l_extendedprice"), F.col("l_discount")))).first()[0]


def test_an_orphan_whose_order_arrives_goes_to_its_nation(spark, tmp_path, dims):
    base = str(tmp_path / "gold")
    lines = spark.createDataFrame([(1, 0, 1, "c", 10.0, 0.0), (40, 0, 1, "c", 5.0, 0.0), (41, 0, 1, "c", 2.0, 0.0)], SCHEMA)
    apply_fact_changes(spark, base, lines, dims, KEYS, SEQ)
    assert by_name(read_gold(spark, base)) == {("R1", "N1"): (1, 1000), (None, None): (2, 700)}
    late = [dims[0].union(spark.createDataFrame([(40, 1)], "o_orderkey int, o_custkey int")), *dims[1:]]
    gone = spark.createDataFrame([(41, 0, 2, "d", None, None)], SCHEMA)
    apply_fact_changes(spark, base, gone, late, KEYS, SEQ)
    assert by_name(read_gold(spark, base)) == {("R1", "N1"): (2, 1500)}
    assert by_name(read_gold(spark, base, version=1)) == {("R1", "N1"): (1, 1000), (None, None): (2, 700)}
    # The last line of a nation goes, and with it its row.
    rest = spark.createDataFrame([(1, 0, 2, "d", None, None), (40, 0, 2, "d", None, None)], SCHEMA)
    apply_fact_changes(spark, base, rest, late, KEYS, SEQ)
    assert by_name(read_gold(spark, base)) == {}
    assert read_gold(spark, str(tmp_path / "nowhere")).collect() == []


def test_lines_are_shuffled_by_their_key_and_by_their_order_only(spark, dims):
    held, run = (spark.createDataFrame(changes(seed, 50), SCHEMA) for seed in (1, 2))
    orphans = spark.createDataFrame([(40, 0, 500), (41, 0, 200), (41, 0, 200)], "l_orderkey int, l_linenumber int, revenue_cents long")
    lines = _touched(held, run, orphans, KEYS, SEQ)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _placed(lines, *dims)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(l_orderkey#") == 2 and plan.count("Exchange hashpartitioning(o_custkey#") == 1
    # Orphans that the run does not touch come again, as often as they are there.
    assert sorted(r.after.cents for r in lines.where("l_orderkey >= 40").collect()) == [200, 200, 500]
