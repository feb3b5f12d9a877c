"""Importance resampling: against SQL, a plain version, and the cases its docstring defines."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

import oracle
from conftest import TESTDATA
from runledger.llm import target_resampling as tr


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of documents and targets given as lists."""

    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        runs = [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(f) % buckets for f in runs]

    every = [(d, *features(t)) for d, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in every:
        for b in found:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)
    ]
    rows = []
    for d, n_words, found in every:
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    place = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((r[0], *r[2:], place.get(id(r))) for r in rows), key=str)


def result(docs, target, **options):
    rank = {k: options.pop(k) for k in ("percent", "least_words") if k in options}
    found = tr.ranked(tr.importance_scores(docs, target, keep=["doc_id"], **options), **rank)
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def targets(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("score", F.lit("own"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    df = tr.op11_importance_resampling(spark, f"{TESTDATA}/{sf}")
    problems, n = oracle.compare(df, oracle.connect(f"{TESTDATA}/{sf}"), tr.ORACLE_SQL)
    assert not problems and n > 0


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equals_plain_version_with_longer_features(spark, make, texts, longest, monkeypatch):
    monkeypatch.setattr(tr, "HEAD_WORDS", 50)  # most words, and all but a few pairs, are of the tail
    monkeypatch.setattr(tr, "HEAD_PAIRS", 20)
    rows = list(texts.items())[:60]
    wanted = [t for _, t in rows[:5]]
    found = result(make(rows), targets(spark, wanted), longest=longest, percent=50)
    assert found == plain(rows, wanted, longest, percent=50)


def test_head_changes_no_result(spark, make, texts, monkeypatch):
    rows = list(texts.items())[:40]
    docs, wanted = make(rows), targets(spark, [t for _, t in rows[:5]])
    whole = result(docs, wanted, longest=2)
    monkeypatch.setattr(tr, "HEAD_WORDS", 0)
    monkeypatch.setattr(tr, "HEAD_PAIRS", 0)
    assert result(docs, wanted, longest=2) == whole


def test_features_across_pieces_of_a_long_text(monkeypatch):
    words = [b"w%d" % (i * i % 97) for i in range(500)]
    text = b", ".join(words)
    hashing = tr.Hashing(1000, 3)
    whole = [b for _, found in hashing.of_text(text) for b in found]
    monkeypatch.setattr("runledger.llm.words.pieces.__defaults__", (re.compile(rb"[\x20\x09-\x0D]"), 64))
    cut = [b for _, found in hashing.of_text(text) for b in found]
    assert sorted(whole) == sorted(cut) and len(whole) == 500 + 499 + 498


def test_nulls_empty_long_repeated_and_odd_words(spark, make):
    body = " ".join(f"Wort{i % 23}" for i in range(30))
    rows = [
        (1, None), (2, ""), (3, "-- ?!"), (4, "É é É " * 10), (None, body), (None, body), (5, body), (5, body),
        (6, "x" * 300_000 + " " + body), (7, body.upper()), (8, "a" * 70 + " b" * 25),
    ]
    found = result(make(rows), targets(spark, [body, None, ""]), percent=60)
    assert found == plain(rows, [body, None, ""], percent=60)
    assert {r[0]: r[2] for r in found}[1] == 0


def test_ties_go_to_the_smaller_id_and_few_words_are_never_drawn(spark, make, monkeypatch):
    monkeypatch.setattr(tr, "noise", lambda doc_id, seed: 0)
    docs = make([(i, "same words here " * 10) for i in (9, 3, 7, 5)] + [(1, "same words")])
    scored = tr.importance_scores(docs, targets(spark, ["same words"]), keep=["doc_id"]).withColumn("score", F.lit(5).cast("long"))
    drawn = {r["doc_id"]: r["rank"] for r in tr.ranked(scored, percent=50).collect()}
    assert drawn == {3: 1, 5: 2, 7: None, 9: None, 1: None}


def test_empty_tables(spark, make):
    rows = [(i, f"word{i} " * 25) for i in range(10)]
    assert result(make(rows), targets(spark, []).limit(0)) == plain(rows, [])
    assert result(make(rows[:1]).limit(0), targets(spark, ["a"])) == []


def test_drawn_documents_keep_their_columns(spark, make):
    rows = [(i, f"word{i} other{i % 3} " * 25) for i in range(40)]
    docs = make(rows).withColumns({"__id": F.lit("own"), "__text": F.lit("own"), "rank": F.lit("own")})
    kept = tr.resampled_documents(docs.drop("rank"), targets(spark, ["other1"]), percent=50)
    assert kept.columns == [c for c in docs.columns if c != "rank"] and kept.count() == 20
    ranks = {r[0] for r in plain(rows, ["other1"], percent=50) if r[-1]}
    assert {r["doc_id"] for r in kept.collect()} == ranks
    assert kept.where("__id = 'own' and __text = 'own'").count() == 20
