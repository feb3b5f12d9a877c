import heapq
import random

from llm.prose import prose
from pyspark.sql import functions as F
from runledger.llm.mixing import apportion, mix, mixed_documents, op10_mixing, source_targets, words_in


def highest_quotients(weights, seats):
    won, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def shares(sizes, ratio=1.5, most=2):
    """Targets by sharing again until none is above its limit."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), ratio * sum(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] >= most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = level * weights[i]
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            free.remove(i)
    return targets


def test_seats_go_by_highest_quotients(spark):
    pick = random.Random(4)
    cases = [[pick.choice([0, 1, 5, 5, pick.randint(1, 10_000)]) for _ in range(pick.randint(1, 30))] for _ in range(60)]
    rows = [(g, i, float(w), 7 + 3 * g) for g, case in enumerate(cases) for i, w in enumerate(case)]
    cells = spark.createDataFrame(rows, "g int, i int, w double, seats long")
    won = {(r["g"], r["i"]): r["won"] for r in apportion(cells, ["g"], "i", "w", "seats", "won").collect()}
    for g, case in enumerate(cases):
        assert [won[g, i] for i in range(len(case))] == highest_quotients(case, 7 + 3 * g), case


def test_targets_are_shared_until_none_is_above(spark):
    pick = random.Random(5)
    for _ in range(6):
        sizes = [pick.choice([0, 3, 50, pick.randint(1, 5000)]) for _ in range(pick.randint(1, 12))]
        names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
        table = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        found = {r["source"]: r["target"] for r in source_targets(table).collect()}
        for name, target in zip(names, shares(sizes)):
            assert abs(found[name] - target) < 1e-6 * max(1, target)


def test_the_mix_of_a_table(spark, texts):
    rows = op10_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op10_mixing(spark, "/root/testdata/sf0.001").collect()))
    assert all(r["size"] == len(texts[r["doc_id"]].encode().split()) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = {}
    for r in rows:
        taken[r["target"], r["source_size"]] = taken.get((r["target"], r["source_size"]), 0) + r["taken"]
    assert all(abs(v - target) <= 16 for (target, _), v in taken.items())


def test_shards_split_a_source_and_keep_the_total(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "big").otherwise(F.col("source")))
    one = mix(docs, shard_tokens=5000).collect()
    other = mix(docs.repartition(13), shard_tokens=5000).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))
    sums = {}
    for r in one:
        t = sums.setdefault(r["source"], [r["target"], 0])
        t[1] += r["taken"]
    # Each of some 60 shards rounds to blocks of 16 words.
    assert all(abs(target - taken) <= 16 * 8 + 0.002 * target for target, taken in sums.values())
    assert sum(0 < r["taken"] % r["size"] for r in one if r["size"]) < 2 * 2 * 120


def test_documents_of_the_mix_hold_the_words_taken(make, spark):
    rows = [(i, " ".join(prose(i, 20 + i)), f"s{i % 4}") for i in range(80)]
    docs = make(rows)
    taken = {r["doc_id"]: r["taken"] for r in mix(docs).collect() if r["taken"]}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    held = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(words_in("text")).alias("n")).collect()}
    assert held == taken
    for r in mixed.collect():
        whole = rows[r["doc_id"]][1]
        assert r["text"] == whole or all(w in whole.split() for w in r["text"].split())
        assert r["target"] == "own" and r["n_chars"] == len(r["text"])


def test_rows_without_ids_are_dealt_over_shards(make):
    rows = [(None, " ".join(prose(i, 40)), "a") for i in range(60)]
    docs = make(rows)
    found = mix(docs, shard_tokens=200).collect()
    assert len(found) == 60 and abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 32
    assert sorted(map(str, found)) == sorted(map(str, mix(docs, shard_tokens=200).collect()))
    from runledger.llm.mixing import _sized

    assert _sized(docs, 1).select("__shard").distinct().count() == 60


def test_odd_rows(make, spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (None, "x " * 500, "b"), (4, "w " * 50_000, "c")]
    found = mix(make(rows)).collect()
    assert len(found) == 6 and {r["taken"] for r in found if not r["size"]} == {0}
    assert all(r["taken"] <= 2 * r["size"] for r in found)
    assert mix(make([])).collect() == [] and mixed_documents(make([])).collect() == []
    nothing = mix(make([(1, None, "a")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in nothing] == [(0, 0, 0.0)]
