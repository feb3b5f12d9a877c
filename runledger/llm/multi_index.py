"""Operator 6, approximate nearest neighbours: an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own centroids;
a pair of centroids is a cell. A query orders the cells by the sum of its two
half scores: a heap walks the pairs from the best down, and stops when the sum
falls a learned margin, in proportion to the query's length, below the score that
its last wanted neighbour should reach. All entries of the cells seen are reranked
by their inner product.

Centroids, the wanted score and the margin come from one bounded sample
(``SAMPLE`` vectors, chosen by hash); every vector is indexed. The number of
centroids grows with the square root of the table, up to ``MAX_CENTROIDS``: so many
squared, of ``PER_CELL`` entries each, are two hundred million vectors; beyond, cells
hold more. A query goes on past its stop until its cells hold at least ``wanted`` ids.

Of vectors that are equal only the ``wanted`` + 1 smallest ids are entries: ties go to
the smaller id, so no query can want more of them; all of them are queries.
A query's last wanted neighbour found scores at least what the last wanted one of the
sample in the same cells does, so lower scores are dropped where they are computed.
That test is made in single precision with a bound on its error; what passes is scored
in double.

Defined cases: vectors that are NULL, all zero, hold NULL or non-finite
components, or have another length than most take no part; ties go to the
smaller id; rows of one id count as one vector, by its best score, and are
never their own neighbour; with fewer candidates than wanted all are returned;
an empty table gives an empty result; extra columns are ignored.

Recovery and size: vectors and the index are written to the shared folder.
A bucket is some cells, or a share of one cell, of about ``BLOCK`` entries. Entries
travel once, to their bucket; a query travels to the buckets that its cells are
in, and meets their entries in batches: a task holds one bucket of entries and one
batch of queries, wherever the vectors crowd. Only the sample, the centroids and the
number of entries per cell reach the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import hash_sample, kept_table

WANTED = 20
EVERY = 20
SAMPLE = 20_000
CALIBRATION = 500
TARGET = 0.94
MAX_CENTROIDS = 2048
PER_CELL = 50
BLOCK = 1024
ROUNDS = 12
#: Relative error of a score in single precision, per component.
SINGLE = 2.0**-23


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v for the vectors that take part."""
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(usable, F.lit(False))
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def kmeans(points: np.ndarray, k: int) -> np.ndarray:
    random = np.random.RandomState(7)
    centroids = points[np.sort(random.choice(len(points), k, replace=False))]
    for _ in range(ROUNDS):
        near = nearest(points, centroids)
        for j in np.unique(near):
            centroids[j] = points[near == j].mean(0)
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, 1)


@dataclass
class Codebook:
    first: np.ndarray
    second: np.ndarray
    sample: np.ndarray
    ids: np.ndarray
    wanted_in_sample: int
    margin: float = 0.0
    sample_cells: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.half], self.first) * len(self.second) + nearest(vectors[:, self.half :], self.second)

    def scores(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each vector with each of the sample; with its own id none."""
        scores = vectors @ self.sample.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        return scores

    def place(self, scores: np.ndarray, k: int) -> np.ndarray:
        """The ``k``-th best score of each row, ids counted once; minus infinity if there are fewer."""
        starts = np.flatnonzero(np.append(True, self.ids[1:] != self.ids[:-1]))  # rows of one id follow each other
        if len(starts) < len(self.ids):
            scores = np.maximum.reduceat(scores, starts, axis=1)
        if scores.shape[1] < k:
            return np.full(len(scores), -np.inf)
        return np.partition(scores, -k, axis=1)[:, -k]

    def walk(self, vector: np.ndarray, goal: float, counts: np.ndarray, ids: np.ndarray, wanted: int, own: int):
        """Cells with entries from the best pair of centroids down, to the stop.

        ``ids`` has how many ids have all their rows in a cell, so none is counted twice.
        """
        one, two = self.first @ vector[: self.half], self.second @ vector[self.half :]
        by_one, by_two = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        one, two = one[by_one].tolist(), two[by_two].tolist()
        by_one, by_two, width = by_one.tolist(), by_two.tolist(), len(self.second)
        heap, held, least = [(-one[0] - two[0], 0, 0)], 0, goal - self.margin * math.sqrt(float(vector @ vector))
        while heap:
            score, i, j = heapq.heappop(heap)
            if -score < least and held >= wanted:
                return
            cell = by_one[i] * width + by_two[j]
            if counts[cell]:
                held += int(ids[cell]) - (cell == own)
                yield cell
            # Each pair has one way in: along the second order, or from the head of the row above.
            if j + 1 < len(two):
                heapq.heappush(heap, (-one[i] - two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-one[i + 1] - two[0], i + 1, 0))


def fit(rows: DataFrame, total: int, wanted: int = WANTED, target: float = TARGET) -> Codebook:
    """Centroids, and the margin under which ``target`` of the sample's own neighbours are met."""
    taken = hash_sample(rows, ["vec_id", "v"], SAMPLE, total).toPandas()
    taken = taken.iloc[sorted(range(len(taken)), key=lambda k: (taken["vec_id"][k], list(taken["v"][k])))]
    sample, ids = np.array(taken["v"].tolist(), float), taken["vec_id"].to_numpy()
    k = min(len(sample), MAX_CENTROIDS, max(4, 2 ** round(math.log2(math.sqrt(total / PER_CELL) + 1))))
    half = sample.shape[1] // 2
    book = Codebook(
        kmeans(sample[:, :half].copy(), k), kmeans(sample[:, half:].copy(), k), sample, ids, max(1, math.ceil(wanted * len(sample) / total))
    )
    chosen = np.sort(np.random.RandomState(3).permutation(len(sample))[:CALIBRATION])
    probe, probe_ids = sample[chosen], ids[chosen]
    scores = book.scores(probe, probe_ids)
    goals = book.place(scores, min(book.wanted_in_sample, len(np.unique(ids))))
    book.sample_cells = cells = book.cells(sample)
    one, two = probe[:, :half] @ book.first.T, probe[:, half:] @ book.second.T
    sums = one[:, cells // k] + two[:, cells % k]
    lengths = np.sqrt((probe**2).sum(1))
    gaps = ((goals[:, None] - sums) / lengths[:, None])[(scores >= goals[:, None]) & np.isfinite(scores) & np.isfinite(goals[:, None])]
    book.margin = float(np.quantile(gaps, target)) if len(gaps) else math.inf
    return book


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


class Bucket:
    """The entries of one bucket, ordered by cell."""

    def __init__(self, cells: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.cells, self.ids, self.vectors = cells[order], ids[order], vectors[order]
        self.single = self.vectors.astype(np.float32)
        self.slack = 2 * (vectors.shape[1] + 2) * SINGLE * math.sqrt((vectors**2).sum(1).max())
        self.found, starts = np.unique(self.cells, return_index=True)
        self.spans = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(cells)])]
        self.repeats = [len(np.unique(self.ids[span])) < span.stop - span.start for span in self.spans]

    def best(self, asked: np.ndarray, vectors: np.ndarray, least: np.ndarray, probed: np.ndarray, owner: np.ndarray, wanted: int):
        """(query id, entry id, score) of the best entries for each query, in the cells it probes (``probed`` by ``owner``)."""
        single = vectors.astype(np.float32)
        slack = self.slack * np.sqrt((vectors**2).sum(1)) + 1e-9 * (1 + np.where(np.isfinite(least), np.abs(least), 0))
        order = np.argsort(probed, kind="stable")
        probed, owner = probed[order], owner[order]
        found_q, found_e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cell, span, repeats in zip(self.found, self.spans, self.repeats):
            who = owner[slice(*np.searchsorted(probed, [cell, cell + 1]))]
            if not len(who):
                continue
            scores = single[who] @ self.single[span].T
            bound = least[who] - slack[who]
            if scores.shape[1] > wanted + 1 and not repeats:  # one place more, for the query's own row
                last = np.partition(scores, -wanted - 1, axis=1)[:, -wanted - 1]
                bound = np.maximum(bound, last - 2 * slack[who])
            q, e = np.nonzero(scores >= bound[:, None])
            found_q.append(who[q])
            found_e.append(e + span.start)
        q, e = np.concatenate(found_q), np.concatenate(found_e)
        other = asked[q] != self.ids[e]
        q, e = q[other], e[other]
        score = np.zeros(len(q))
        for a in range(0, len(q), 1 << 16):
            score[a : a + (1 << 16)] = (vectors[q[a : a + (1 << 16)]] * self.vectors[e[a : a + (1 << 16)]]).sum(1)
        order = np.lexsort((-score, self.ids[e], q))
        q, e, score = q[order], e[order], score[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (self.ids[e][1:] != self.ids[e][:-1])
        q, e, score = q[fresh], e[fresh], score[fresh]
        order = np.lexsort((self.ids[e], -score, q))
        q, e, score = q[order], e[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < wanted
        return asked[q[top]], self.ids[e[top]], score[top]


def _scored(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, a bucket's entries before its queries; it is kept while its queries pass."""
    at, entries, bucket = None, [], None
    for batch in batches:
        numbers, asking = batch.column("bucket").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asking[1:] != asking[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(numbers)]):
            if a == b:
                continue
            if numbers[a] != at:
                at, entries, bucket = numbers[a], [], None
            part = batch.slice(a, b - a)
            ids, vectors = part.column("id").to_numpy(), _matrix(part.column("v"))
            if not asking[a]:
                entries.append((part.column("cells").flatten().to_numpy(), ids, vectors))
                continue
            if bucket is None:
                if not entries:
                    continue
                bucket = Bucket(*(np.concatenate(x) for x in zip(*entries)))
                entries = []
            cells = part.column("cells")
            owner = np.repeat(np.arange(len(ids)), pc.list_value_length(cells).to_numpy())
            columns = bucket.best(ids, vectors, part.column("least").to_numpy(), cells.flatten().to_numpy(), owner, wanted)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first bucket and its number of buckets: small cells in a row share one."""
    first, parts, bucket, held = np.zeros(len(counts), np.int32), np.maximum(1, -(-counts // BLOCK)).astype(np.int32), 0, 0
    for cell in np.flatnonzero(counts):
        n = int(counts[cell])
        if held and (held + n > BLOCK or parts[cell] > 1):
            bucket, held = bucket + 1, 0
        first[cell] = bucket
        held += n
        if parts[cell] > 1:
            bucket, held = bucket + int(parts[cell]), 0
    return first, parts


def _per_cell(rows: DataFrame, cells: int) -> np.ndarray:
    """Rows of each cell, as one array of all cells."""
    counted = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(cells, np.int64)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return counts


def nearest_neighbours(table: DataFrame, every: int = EVERY, wanted: int = WANTED, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each vector whose id ``every`` divides."""
    spark = table.sparkSession
    rows = kept_table(valid_vectors(table).dropDuplicates(["vec_id", "v"]), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    book = fit(rows, total, wanted, target)
    shared = spark.sparkContext.broadcast(book)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["vec_id", "v", "cell"])

    kind = dict(rows.dtypes)["v"]
    equal = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= wanted + 1).drop("place")
    index = kept_table(few.mapInArrow(placed, f"vec_id long, v {kind}, cell int"), "multi-index")
    n_cells = len(book.first) * len(book.second)
    counts = _per_cell(index, n_cells)
    spread = index.groupBy("vec_id").agg(F.min("cell").alias("cell"), F.max("cell").alias("last"))
    held_ids = _per_cell(spread.where("cell = last"), n_cells)
    first, parts = _places(counts)
    cells = spark.sparkContext.broadcast((counts, held_ids, first, parts))

    def probes(batches):
        book, (counts, held_ids, first, parts) = shared.value, cells.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                ids, vectors = some.column("vec_id").to_numpy(), _matrix(some.column("v"))
                own = book.cells(vectors)
                scores = book.scores(vectors, ids)
                goals = book.place(scores, min(book.wanted_in_sample, scores.shape[1]))
                where, which, probed = [], [], []
                for k in range(len(ids)):
                    walked = np.fromiter(book.walk(vectors[k], goals[k], counts, held_ids, wanted, own[k]), np.int64)
                    seen = np.zeros(len(counts), bool)
                    seen[walked] = True
                    scores[k, ~seen[book.sample_cells]] = -np.inf  # of the sample, what the cells seen hold
                    walked = np.repeat(walked, parts[walked])  # once for each bucket of a cell
                    starts = np.flatnonzero(np.append(True, walked[1:] != walked[:-1]))
                    buckets = first[walked] + np.arange(len(walked)) - np.repeat(starts, np.diff(np.append(starts, len(walked))))
                    order = np.argsort(buckets, kind="stable")
                    buckets, walked = buckets[order], walked[order].astype(np.int32)
                    edges = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
                    where += [k] * (len(edges) + 1)
                    which += buckets[np.append(0, edges)].tolist()
                    probed += np.split(walked, edges)
                least = book.place(scores, wanted)
                if where:
                    taken = some.take(pa.array(where))
                    offsets = np.append(0, np.cumsum([len(p) for p in probed])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(which, pa.int32()), pa.array(np.ones(len(where), bool)), taken.column("vec_id"), taken.column("v"),
                            pa.ListArray.from_arrays(offsets, np.concatenate(probed)), pa.array(least[where]),
                        ],
                        names=["bucket", "is_query", "id", "v", "cells", "least"],
                    )

    def dealt(batches):
        _, _, first, parts = cells.value
        for batch in batches:
            ids, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            share = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % parts[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first[cell] + share.astype(np.int32), pa.int32()), pa.array(np.zeros(len(ids), bool)), batch.column("vec_id"),
                    batch.column("v"), pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32), cell), pa.array(np.zeros(len(ids))),
                ],
                names=["bucket", "is_query", "id", "v", "cells", "least"],
            )

    schema = f"bucket int, is_query boolean, id long, v {kind}, cells array<int>, least double"
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = rows.where(F.col("vec_id") % every == 0).repartition(tasks, "vec_id", "v")  # a walk costs more than its row: by number, not size
    both = index.mapInArrow(dealt, schema).unionByName(asked.mapInArrow(probes, schema))
    found = (
        both.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket", "is_query")
        .mapInArrow(lambda batches: _scored(batches, wanted), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= wanted)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6_multi_index(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
