"""Runs in flight over time, and running values stitched over slots, against plain loops."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from runledger.functions.stitching import carried_forward, running_total
from runledger.operators.overlap import busy_spans, in_flight_over_time, peak_overlap

RUNS = "dag_id string, run_id string, start_date timestamp_ntz, end_date timestamp_ntz"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


def history(seed, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        dag = "hot" if rng.random() < 0.4 else f"d{rng.randrange(20)}"
        start = rng.choice([rng.randrange(24 * 200), 24 * rng.randrange(200)])
        end = rng.choice([None, start - 5, start, *[start + rng.randrange(1, 400)] * 9])
        rows.append((dag, f"r{i}", None if rng.random() < 0.03 else day(start), None if end is None else day(end)))
    return rows + [(None, "x", day(1), day(9))]


def plain(rows):
    """dag -> [(moment, runs in flight from it on)], where the number changes."""
    steps = {}
    for dag, _, start, end in rows:
        if dag is not None and start is not None and (end is None or end > start):
            mine = steps.setdefault(dag, {})
            mine[start] = mine.get(start, 0) + 1
            if end is not None:
                mine[end] = mine.get(end, 0) - 1
    out = {}
    for dag, mine in steps.items():
        n, out[dag] = 0, []
        for t in sorted(t for t in mine if mine[t]):
            n += mine[t]
            out[dag].append((t, n))
    return out


@pytest.mark.parametrize("slot", ["year", "month", "day"])
def test_peaks_and_spans_equal_a_plain_sweep(spark, slot):
    rows = history(5)
    df, want = spark.createDataFrame(rows, RUNS), plain(rows)
    swept = {}
    for r in in_flight_over_time(df, slot).collect():
        swept.setdefault(r["dag_id"], []).append((r["at"], r["n"]))
    assert {d: sorted(v) for d, v in swept.items()} == want
    peaks = {r["dag_id"]: (r["most"], r["first_at"]) for r in peak_overlap(df, slot).collect()}
    assert peaks == {d: (max(n for _, n in v), next(t for t, n in v if n == max(n for _, n in v))) for d, v in want.items()}
    for above in (1, 3):
        spans = set()
        for dag, moments in want.items():
            begin, most = None, 0
            for t, n in moments:
                if n > above:
                    begin, most = begin or t, max(most, n)
                elif begin:
                    spans.add((dag, begin, t, most))
                    begin, most = None, 0
            if begin:
                spans.add((dag, begin, None, most))
        assert {tuple(r) for r in busy_spans(df, above, slot).select("dag_id", "busy_from", "busy_to", "most").collect()} == spans
        assert spans


def test_a_run_that_ends_as_another_starts_is_no_overlap(spark):
    df = spark.createDataFrame([("d", "a", day(0), day(5)), ("d", "b", day(5), day(9)), ("e", "a", day(0), None)], RUNS)
    assert {tuple(r) for r in peak_overlap(df).collect()} == {("d", 1, day(0)), ("e", 1, day(0))}
    assert busy_spans(df).collect() == []
    assert peak_overlap(df.limit(0)).collect() == []


def test_no_task_holds_a_hot_key(spark):
    """A key's rows are exchanged by key and slot; what is run through by key alone is one row per slot."""
    df = spark.createDataFrame(history(2), RUNS)
    plan = in_flight_over_time(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [re.search(r"\], \[([^\]]*)\], \[", line)[1] for line in plan.split("\n") if "Window [" in line]
    assert sorted(w.count("#") for w in windows) == [1, 2]
    # Below the one by key alone are the sums of slots.
    alone = plan[plan.index("], [dag_id#") :] if windows[0].count("#") == 1 else plan.split("Window [")[2]
    assert "Aggregate [dag_id" in alone


def test_stitched_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i // 7, i, rng.randrange(9), rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, slot int, i int, v int, w int")
    totals = {(r["k"], r["i"]): r["t"] for r in running_total(df, ["k"], "slot", [F.col("i")], F.col("v"), "t").collect()}
    lasts = {(r["k"], r["i"]): r["l"] for r in carried_forward(df, ["k"], "slot", ["i"], F.col("w"), "l").collect()}
    for k, _, i, _, _ in rows:
        before = [r for r in rows if r[0] == k and r[2] <= i]
        assert totals[k, i] == sum(r[3] for r in before)
        assert lasts[k, i] == next((r[4] for r in reversed(before) if r[4] is not None), None)
