"""Runs of words against every period tried in turn, and the cases the docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from runledger.llm import periodic_runs as pr
from runledger.llm.suffix_tree import Extensions, RangeMinimum, SuffixTree


def plain_runs(words, least_words=6, least_times=4):
    n, found = len(words), set()
    for p in range(1, n // least_times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            smaller = any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p))
            if length >= max(least_words, least_times * p) and not smaller:
                found.add((i, length, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    exponent = None if q is None else 1000 * length // q
    return (doc_id, len(found), s, length, q, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_words(rng):
    sigma, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
    words = [rng.randrange(sigma) for _ in range(n)]
    if n and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randint(1, 6)
        words = [words[min(n - 1, a + (i - a) % p)] if i >= a else words[i] for i in range(n)]
    return words


def test_query_equals_plain_version(spark, texts):
    found = pr.op13_periodic_runs(spark, f"{TESTDATA}/sf0.001")
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in found.dtypes if not c.endswith("sha256")} == {"bigint"}
    got = {tuple(r) for r in found.collect()}
    assert got == {plain_row(d, t) for d, t in texts.items()}
    assert sum(r[1] for r in got) > 10


@pytest.mark.parametrize("seed", range(4))
def test_random_sequences(seed):
    rng, seen = random.Random(seed), 0
    for _ in range(250):
        words = random_words(rng)
        want = plain_runs(words)
        seen += len(want)
        assert list(map(tuple, pr.runs(np.array(words, np.int32)).tolist())) == want
        if words:  # without the cut at rare words
            whole = pr.runs_of_stretch(np.array(words), 6, 4).tolist()
            assert sorted(map(tuple, whole), key=lambda r: (r[0], r[2])) == want
    assert seen > 50


def test_runs_of_two_periods():
    rng = random.Random(9)
    for _ in range(150):
        words = random_words(rng)
        assert list(map(tuple, pr.runs(np.array(words, np.int32), 2, 2).tolist())) == plain_runs(words, 2, 2)


def test_extensions_and_ranks_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 50)
        words = [rng.randint(1, 3) for _ in range(n)]
        tree = SuffixTree(words, 3)
        below = tree.below()
        up = sorted(range(n + 1), key=lambda i: words[i:])
        down = sorted(range(n + 1), key=lambda i: [-w for w in words[i:]])
        assert np.argsort(tree.ranks(below)).tolist() == up
        assert np.argsort(tree.ranks(below, True)).tolist() == down
        a, b = map(np.array, zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]))
        want = []
        for i, j in zip(a.tolist(), b.tolist()):
            k = 0
            while max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            want.append(k)
        assert Extensions(tree, below).common(a, b).tolist() == want


def test_least_value_between_places():
    values = np.random.RandomState(1).randint(0, 1000, 700).astype(np.int32)
    low, high = np.sort(np.random.RandomState(2).randint(0, 700, (2, 3000)), axis=0)
    want = [values[a : b + 1].min() for a, b in zip(low, high)]
    assert RangeMinimum(values).between(low, high).tolist() == want


def test_defined_cases(spark, make):
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "a " * 5), (5, "a " * 6), (6, "a b " * 4), (6, "a b " * 4), (None, "a b c " * 7),
        (7, "x " + "a b " * 5 + "b b b b b b y"), (8, "é\x0bé é\té é É"), (9, "A a " * 9), (10, "one two three"),
        (11, "k " * 6 + "l " * 6), (12, "a b c d " * 3 + "a b c"),
    ]
    docs = make(rows).withColumns({c: F.lit("own") for c in ("runs", "collapsed", "n_words", "length", "period")})
    found = pr.periodic_runs(docs).collect()
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=str)
    want = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        spans = plain_runs(words)
        gone = {i for s, length, q in spans for i in range(s + q, s + length)}
        want.append((d, len(words), spans, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str)
    assert {r["doc_id"]: r["collapsed"] for r in found}[7].split() == ["x", "a", "b", "y"]


def test_empty_table_and_documents(make):
    assert pr.periodic_runs(make([(1, "a")]).limit(0)).collect() == []
    kept = pr.collapsed_documents(make([(1, "say it again " * 5 + "end"), (None, None)])).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: "say it again end", None: ""}


def test_a_long_text_that_repeats_itself():
    rng = random.Random(3)
    block = [rng.randrange(500) for _ in range(4000)]
    words = np.array(block * 6 + [1000] * 3000, np.int32)
    found = set(map(tuple, pr.runs(words).tolist()))
    assert {(0, 24000, 4000), (24000, 3000, 1)} <= found


def test_words_in_every_stretch_stand_often_enough():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 9, 2, 2, 2, 2, 2, 2, 3, 0, 1, 0], np.int32)
    assert sorted(pr.stretches(words)) == [(0, 8), (9, 15)]


def test_planted_tail_is_the_one_the_contract_states():
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = np.arange(50, dtype=np.int32)
    g = zlib.crc32(str(hit).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert pr.planted_tail(hit, words).tolist() == [a + (i - a) % p if i >= a else i for i in range(50)]
    assert pr.planted_tail(None, words) is words and len(pr.planted_tail(hit, words[:0])) == 0
