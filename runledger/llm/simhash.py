"""Operator 12, SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A text's fingerprint has a bit set where over half of its shingles' hashes have it:
shingles of ``width`` words of the text with A-Z lower-cased, joined by one space,
repeats counted, hashed by XXH64 with a seed. Fingerprints that differ in at most
``radius`` bits are linked; a component is what links reach.

Only distinct fingerprints are compared. The 64 bits are cut into blocks; two
fingerprints within the radius agree on at least ``blocks - radius`` of them,
wherever their bits differ, so each fingerprint goes to one bucket per choice of so
many blocks, and no link is lost. The number of blocks grows with the number of
fingerprints, which keeps buckets small. Inside a bucket fingerprints are ordered by
how many bits they have set and cut into tiles; two tiles whose counts differ by more
than the radius are skipped, all others compared by numpy: exclusive-or, then a count
of bits. A bucket of more than ``WIDE`` fingerprints is cut before it reaches a task:
its tiles are dealt by bit count and hash, and each pair of tiles that is not skipped
is a task's unit of its own.

A bucket or pair of tiles gives a spanning forest of its links and not each of them,
so what is written grows with its fingerprints and not with their square.

Defined cases: a NULL or empty text has fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle; rows of one text or one id stand
for themselves; a component's id is its smallest doc_id, rows without an id belong
to components but name none: a component of such rows alone has a NULL id; an empty
table gives an empty result; extra columns are ignored.

Recovery and size: fingerprints, links and labels are written tables; a text is read
in pieces; nothing but counts reaches the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept_table, read, slices
from .components import components
from .words import pieces

WIDTH = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Fingerprints that a tile of a bucket has at most; two tiles are compared at once.
TILE = 1024
#: A bucket of more fingerprints than this is dealt out as pairs of tiles.
WIDE = 16 * TILE
#: Fingerprints that blocks should leave in a bucket on average.
CROWD = 64


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned number."""
    ones, total, before = np.zeros(BITS, np.int64), 0, []

    def add(hashes: Iterator[int], n: int) -> None:
        nonlocal total
        bits = np.unpackbits(np.fromiter(hashes, np.uint64, n).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(0, dtype=np.int64)
        total += n

    for piece in pieces((text or b"").lower()):
        words = before + piece.split()
        flat, n = b" ".join(words), len(words) - width + 1
        if n > 0:
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[: n - 1]]
            hash64 = xxhash.xxh64_intdigest
            add((hash64(flat[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])), n)
            words = words[n:]
        before = words
    if not total and before:
        add(iter([xxhash.xxh64_intdigest(b" ".join(before), seed)]), 1)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as the signed number of the same bits, of every row."""

    def made(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, width, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, fp long")


def cuts(n: int, radius: int = RADIUS, bits: int = BITS, crowd: int = CROWD) -> list[list[tuple[int, int]]]:
    """The choices of blocks, as (first bit, bits), for ``n`` fingerprints.

    With one block more, one more must agree: more choices, of more bits each. The
    first number of blocks whose buckets are small enough for ``n`` is taken.
    """
    for blocks in range(radius + 1, 2 * radius + 1):
        agree = blocks - radius
        if n <= crowd * 2 ** (bits * agree // blocks) or blocks == 2 * radius:
            edges = [bits * i // blocks for i in range(blocks + 1)]
            parts = [(a, b - a) for a, b in zip(edges, edges[1:])]
            return [list(chosen) for chosen in itertools.combinations(parts, agree)]
    raise ValueError("radius must be at least 1")


def bucket(fp: Column, chosen: list[tuple[int, int]], number: int) -> Column:
    """The bits of the chosen blocks, with the choice's number in front."""
    key = F.lit(number).cast("long")
    for first, width in chosen:
        mask = F.lit((1 << width) - 1).cast("long")
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(mask))
    return key


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give rows that the links (i, j) connect the least label among them; labels are rows."""
    while True:
        x, y = labels[i], labels[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:  # every label to its root
            top = labels[labels]
            if (top == labels).all():
                break
            labels[:] = top


def _compare(a: np.ndarray, b: np.ndarray, radius: int, labels: np.ndarray, at: int, to: int) -> None:
    """Join what lies within the radius between the tiles ``a`` (rows from ``at``) and ``b`` (from ``to``)."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    _join(labels, i + at, j + to)


def tiled_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (unsigned)."""
    counts = np.bitwise_count(fps)
    order = np.lexsort((fps, counts))
    fps, counts, labels = fps[order], counts[order].astype(np.int64), np.arange(len(fps))
    for at in range(0, len(fps), tile):
        for to in range(at, len(fps), tile):
            if counts[to] - counts[min(at + tile, len(fps)) - 1] > radius:
                break
            _compare(fps[at : at + tile], fps[to : to + tile], radius, labels, at, to)
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[linked], fps[labels[linked]]


def _small_links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``tiled_links`` for many buckets at once, rows ordered by bucket and bit count.

    Each row meets the next, the second next, and so on, while its bucket and the radius allow.
    """
    counts, labels, step = np.bitwise_count(fps).astype(np.int8), np.arange(len(fps)), 1
    rows = np.arange(len(fps))
    while len(rows):
        rows = rows[rows + step < len(fps)]
        rows = rows[(groups[rows] == groups[rows + step]) & (counts[rows + step] - counts[rows] <= radius)]
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + step]) <= radius]
        _join(labels, near, near + step)
        step += 1
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[linked], fps[labels[linked]]


#: Buckets of up to this many fingerprints are compared many at once, row by row.
SMALL = 32


def _links_of_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket of rows that come ordered by bucket and bit count."""
    kept_g, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(groups: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        sizes = np.diff(np.append(starts, len(groups)))
        few = np.repeat(sizes <= SMALL, sizes)
        pairs = [_small_links(groups[few], fps[few], radius)]
        pairs += [tiled_links(fps[a : a + n], radius) for a, n in zip(starts, sizes) if n > SMALL]
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        groups = np.append(kept_g, batch.column("bucket").to_numpy())
        fps = np.append(kept_f, batch.column("fp").to_numpy().view(np.uint64))
        if not len(groups):
            continue
        last = np.searchsorted(groups, groups[-1])  # the last bucket may go on in the next batch
        yield from links(groups[:last], fps[:last]) if last else ()
        kept_g, kept_f = groups[last:], fps[last:]
    if len(kept_g):
        yield from links(kept_g, kept_f)


def _links_of_pair(first: pa.Table, second: pa.Table, radius: int) -> pa.Table:
    """A spanning forest of the links between two tiles."""
    a, b = (t["fp"].to_numpy().view(np.uint64) for t in (first, second))
    every, labels = np.concatenate([a, b]), np.arange(len(a) + len(b))
    for at in range(0, len(a), TILE):
        for to in range(0, len(b), TILE):
            _compare(a[at : at + TILE], b[to : to + TILE], radius, labels, at, len(a) + to)
    linked = np.flatnonzero(every != every[labels])  # a tile that meets itself has each fingerprint twice
    columns = [pa.array(x.view(np.int64)) for x in (every[linked], every[labels[linked]])]
    return pa.table(columns, names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, wide: int = WIDE, crowd: int = CROWD) -> DataFrame:
    """a, b: pairs that connect all fingerprints (``fp``, distinct) that links connect."""
    chosen = cuts(fps.count(), radius, crowd=crowd)
    keys = F.explode(F.array(*[bucket(F.col("fp"), c, k) for k, c in enumerate(chosen)]))
    ones = F.bit_count("fp")
    dealt = fps.select("fp", keys.alias("bucket"))
    sizes = dealt.groupBy("bucket").count().where(F.col("count") > wide)
    crowded = kept_table(sizes.select("bucket"), "wide-buckets")
    few = F.broadcast(crowded) if crowded.count() <= 100_000 else crowded
    narrow = dealt.join(few, "bucket", "left_anti")
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (
        narrow.repartition(parts, "bucket")
        .sortWithinPartitions("bucket", F.bit_count("fp"))
        .mapInArrow(lambda batches: _links_of_buckets(batches, radius), "a long, b long")
    )
    if crowded.isEmpty():
        return found
    # Wide buckets: a tile is a bit count and a hash; as many hashes as bring a tile to about TILE rows.
    rows = dealt.join(few, "bucket").withColumn("ones", ones)
    tiles = rows.groupBy("bucket", "ones").agg(F.ceil(F.count(F.lit(1)) / F.lit(8 * TILE)).cast("int").alias("parts"))
    tiles = kept_table(tiles, "tiles")
    placed = rows.join(tiles, ["bucket", "ones"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("parts")).cast("int"))
    # Every tile meets itself and the tiles after it in (bit count, hash) whose bit count is within the radius.
    each = tiles.select("bucket", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = each.select("bucket", F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    near = each.withColumn("ones2", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)))
    pairs = near.join(other, ["bucket", "ones2"]).where("ones2 > ones or part2 >= part")
    pair = ["bucket", "ones", "part", "ones2", "part2"]
    first = placed.select("fp", "bucket", "ones", "part").join(pairs, ["bucket", "ones", "part"]).select("fp", *pair)
    second = placed.select("fp", "bucket", F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    second = second.join(pairs, ["bucket", "ones2", "part2"]).select("fp", *pair)
    second = second.toDF(*second.columns)  # columns of its own: both sides come from the same rows
    across = first.groupBy(*pair).cogroup(second.groupBy(*pair)).applyInArrow(lambda a, b: _links_of_pair(a, b, radius), "a long, b long")
    return found.unionByName(across)


def near_components(docs: DataFrame, width: int = WIDTH, seed: int = SEED, radius: int = RADIUS, **sizes: int) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    rows = kept_table(fingerprints(docs, width, seed), "fingerprints")
    fps = kept_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(kept_table(links(fps.select("fp"), radius, **sizes).distinct(), "near"))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = kept_table(named, "labelled")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.join(least, "label").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows without an id stay."""
    ids = near_components(docs, **options).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
