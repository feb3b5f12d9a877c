"""SimHash components against fingerprints and links compared one by one."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import TESTDATA
from .prose import prose
from runledger.llm import simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, radius=4):
    """The least place in the list that links reach, for each fingerprint of a list."""
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return [top(x) for x in range(len(fps))]


def plain(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    least = {}
    for (d, _), g in zip(rows, groups := plain_groups(fps)):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, f, least.get(g)) for (d, _), f, g in zip(rows, fps, groups)), key=str)


def result(docs, **options):
    rows = simhash.near_components(docs, **options).collect()
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows), key=str)


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def groups_of(spark, fps, **options):
    """Components of given fingerprints, through the links' own joins."""
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    pairs = simhash.links(df, **options).collect()
    place = {f: i for i, f in enumerate(fps)}
    assert len(pairs) <= 70 * len(fps)
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in pairs:
        x, y = (top(place[r[c] % 2**64]) for c in "ab")
        up[max(x, y)] = min(x, y)
    return [top(x) for x in range(len(fps))]


def test_query_equals_plain_version(spark, texts):
    rows = list(texts.items())
    found = simhash.op12_simhash(spark, f"{TESTDATA}/sf0.001")
    assert dict(found.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert sorted(((r[0], int(r[1], 16), r[2]) for r in found.collect()), key=str) == plain(rows)
    assert all(len(r[1]) == 16 and r[1] == r[1].lower() for r in found.collect())


def test_defined_cases(spark, make):
    body = " ".join(prose(1, 80))
    rows = [
        (4, None), (9, ""), (2, " \n\t"), (11, body), (10, body), (10, body), (None, body.upper()), (7, "one two"),
        (8, "ONE\x0btwo"), (None, "never seen before by anyone"), (3, "É und ß " * 9), (5, "\x1cone two"),
    ]
    assert result(make(rows)) == plain(rows)
    ids = {r[0]: r[2] for r in result(make(rows))}
    assert ids[4] == ids[9] == ids[2] == 2 and ids[11] == 10 and ids[8] == 7


def test_empty_table(make):
    assert result(make([(1, "a")]).limit(0)) == []


def test_a_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(prose(3, 3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr("runledger.llm.words.pieces.__defaults__", (re.compile(rb"[\x20\x09-\x0D]"), 50))
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("crowd", [64, 1, 0])
@pytest.mark.parametrize("wide", [simhash.WIDE, 40])
def test_links_lose_nothing_at_any_number_of_blocks(spark, crowd, wide):
    """Chains of four changed bits anywhere, and texts that share a block without being near."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = [near(rng, f, rng.randint(1, 5)) for f in base for _ in range(6)]
    fps += [(f & ~0xFFF) | 0xABC for f in (rng.getrandbits(64) for _ in range(150))]  # one crowded bucket
    fps = sorted(set(fps))
    assert groups_of(spark, fps, crowd=crowd, wide=wide) == plain_groups(fps)


def test_blocks_grow_with_the_number_of_fingerprints():
    numbers = [len(simhash.cuts(n)) for n in (10, 10**6, 10**9, 10**12)]
    assert numbers == sorted(numbers) and numbers[0] == 5 and numbers[-1] == 70
    assert all(sum(w for _, w in chosen) >= 11 for n in (10, 10**8) for chosen in simhash.cuts(n))


def test_tiles_equal_plain_comparison():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({near(rng, f, rng.randint(0, 6)) for f in base for _ in range(20)})
    a, b = simhash.tiled_links(np.array(fps, np.uint64), 4, tile=16)
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        up[max(top(x), top(y))] = min(top(x), top(y))
    assert [fps.index(top(f)) for f in fps] == plain_groups(fps)
    assert len(a) < len(fps)  # a forest, not all pairs


def test_a_large_group_gives_few_links(spark):
    """800 fingerprints within the radius of each other: some thousand rows, not 320,000."""
    one = 0x0123456789ABCDEF
    fps = [one ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    assert simhash.links(df).count() <= 5 * len(fps)
    assert groups_of(spark, fps) == [0] * len(fps)


def test_one_document_of_each_component_stays(make):
    body = " ".join(prose(5, 60))
    docs = make([(3, body), (1, body.title()), (2, "else what is this"), (None, body)]).withColumn("fp", F.lit("own"))
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, None]
