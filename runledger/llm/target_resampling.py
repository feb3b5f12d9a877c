"""Operator 11, target-distribution importance resampling over hashed word features.

The features of a text are its runs of one to ``longest`` consecutive words, joined
by one space; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. A
bucket's gain compares how often the target and the documents use it; a document's
weight is the floored mean of the gains of its features. Gumbel noise, seeded by the
document's id, turns the best weights into a draw without replacement.

Head and tail: the words and pairs that slices of the text hold most often are
broadcast, words with the CRC state that a longer feature goes on from, pairs with
their bucket. What is not among them takes the CRC of its bytes. Both give the same
numbers, so which words the head holds is a matter of time, not of results; bucket
totals are exact sums over all features of all documents.

Defined cases: a NULL text has no words; a document without features has weight 0;
documents under ``least_words`` words are scored but never drawn; ties go to the
smaller id, ids before NULL; rows of one id are rows of their own with the same
noise; a NULL id is the empty text in the noise; an empty table, of documents or of
the target, counts as no features; extra columns are carried or ignored.

Recovery and size: scores are a written table. What is broadcast has fixed bounds:
``HEAD_WORDS`` words and ``HEAD_PAIRS`` pairs of at most ``HEAD_BYTES`` bytes a word,
one gain per bucket, and one row per score that occurs, of which weights (within
44,000 either way while counts fit 64 bits) and noise (from -3,131 to 22,875) leave
less than 120,000. Ranks come from these counts and from windows over one score
each, which the noise keeps small however many texts are alike.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import kept_table, read, slices
from .words import pieces

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
HEAD_WORDS = 20_000
HEAD_PAIRS = 50_000
HEAD_BYTES = 64

#: Words of lower-cased text: digits, letters and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


class _States(dict):
    """CRC state after a word: of the head by look-up, of the tail from its bytes."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


@dataclass
class Hashing:
    """How features become buckets; the head only saves time."""

    buckets: int = BUCKETS
    longest: int = LONGEST
    states: dict[bytes, int] = field(default_factory=_States)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)

    def of(self, words: list[bytes], before: list[bytes]) -> Iterator[int]:
        """Buckets of the features that end in ``words``; ``before`` has up to ``longest - 1`` words ahead."""
        n, states = self.buckets, self.states
        for word in words:
            yield states[word] % n
        every = before + words if self.longest > 1 else words
        for length in range(2, self.longest + 1):
            for i in range(max(0, len(before) - length + 1), len(every) - length + 1):
                known = self.pairs.get((every[i], every[i + 1])) if length == 2 else None
                yield zlib.crc32(b" " + b" ".join(every[i + 1 : i + length]), states[every[i]]) % n if known is None else known

    def of_text(self, text: bytes | None) -> Iterator[tuple[list[bytes], Iterator[int]]]:
        """Words and buckets of a text, piece by piece."""
        before: list[bytes] = []
        for piece in pieces((text or b"").lower(), BETWEEN):
            words = WORD.findall(piece)
            yield words, self.of(words, before)
            if self.longest > 1:
                before = (before + words)[1 - self.longest :]


def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[bytes | None]]:
    for batch in slices(batches, text):
        yield batch.column(text).cast(pa.binary()).to_pylist()


def _most(counts: DataFrame, most: int) -> list[Row]:
    """The most frequent rows of ``counts`` (n), at most ``most`` of them.

    Taken by a least count that few enough rows reach, in steps of an eighth of a
    doubling, so that no task sends rows that are not wanted.
    """
    step = F.floor(F.lit(8) * F.log2("n")).cast("int")
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > most:
            break
        least = at
    return counts.where(step >= least).collect()


def head(docs: DataFrame, hashing: Hashing, text: str = "text") -> Hashing:
    """``hashing`` with the most frequent words, and pairs if features have two words, looked up.

    Each slice of text sends its own most frequent ones; words longer than
    ``HEAD_BYTES`` stay in the tail.
    """
    longest = hashing.longest

    def counted(batches):
        for texts in _texts(batches, text):
            words, pairs = Counter(), Counter()
            for one in texts:
                last: list[bytes] = []
                for piece in pieces((one or b"").lower(), BETWEEN):
                    found = WORD.findall(piece)
                    words.update(found)
                    if longest > 1:
                        pairs.update(zip(last + found, (last + found)[1:]))
                        last = found[-1:] or last
            rows = [(w, None, n) for w, n in words.most_common(HEAD_WORDS) if len(w) <= HEAD_BYTES]
            rows += [(a, b, n) for (a, b), n in pairs.most_common(HEAD_PAIRS) if max(len(a), len(b)) <= HEAD_BYTES]
            if rows:
                first, second, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(n, pa.int64())], names=["first", "second", "n"]
                )

    seen = kept_table(
        docs.select(text)
        .mapInArrow(counted, "first binary, second binary, n long")
        .groupBy("first", "second")
        .agg(F.sum("n").alias("n")),
        "head",
    )
    words = [bytes(r["first"]) for r in _most(seen.where("second is null"), HEAD_WORDS)]
    states = _States((w, zlib.crc32(w)) for w in words)
    pairs = {}
    if longest > 1:
        for r in _most(seen.where("second is not null"), HEAD_PAIRS):
            a, b = bytes(r["first"]), bytes(r["second"])
            pairs[a, b] = zlib.crc32(b" " + b, states[a]) % hashing.buckets
    return Hashing(hashing.buckets, longest, states, pairs)


def bucket_totals(docs: DataFrame, hashing: Hashing, text: str = "text") -> DataFrame:
    """bucket, n: features of all texts by bucket; each task sends one row per bucket at most."""
    shared = docs.sparkSession.sparkContext.broadcast(hashing)

    def counted(batches):
        mine = shared.value
        totals = np.zeros(mine.buckets, np.int64)
        for texts in _texts(batches, text):
            for one in texts:
                for _, found in mine.of_text(one):
                    totals += np.bincount(np.fromiter(found, np.int64), minlength=mine.buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket from two tables of ``bucket_totals``, at most one row per bucket each."""
    s, t = ({r["bucket"]: r["n"] for r in totals.collect()} for totals in (source, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


MADE = ("n_words", "n_features", "weight", "score")


def importance_scores(
    docs: DataFrame, target: DataFrame, keep: list[str] | None = None, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if not given) with n_words, n_features, weight and score.

    ``docs`` has doc_id and text, ``target`` has text. Columns of ``docs`` that have
    one of the new names give way to them.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    hashing = head(docs, Hashing(buckets, longest))
    gain = gains(bucket_totals(docs, hashing), bucket_totals(target, hashing), buckets)
    shared = docs.sparkSession.sparkContext.broadcast((hashing, gain))
    ids, texts = "__id", "__text"
    while {ids, texts} & set(keep):
        ids, texts = ids + "_", texts + "_"

    def scored(batches):
        mine, gain = shared.value
        for batch in slices(batches, texts):
            made = []
            for doc_id, one in zip(batch.column(ids).to_pylist(), batch.column(texts).cast(pa.binary()).to_pylist()):
                n_words = n_features = total = 0
                for words, found in mine.of_text(one):
                    found = [gain[b] for b in found]
                    n_words, n_features, total = n_words + len(words), n_features + len(found), total + sum(found)
                weight = total // n_features if n_features else 0
                made.append((n_words, n_features, weight, weight + noise(doc_id, seed)))
            new = [pa.array(c, pa.int64()) for c in zip(*made)] if made else [pa.array([], pa.int64())] * len(MADE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *MADE])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, LongType()) for c in MADE)])
    rows = docs.select(*keep, F.col("doc_id").alias(ids), F.col("text").alias(texts))
    return rows.mapInArrow(scored, schema)


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the drawn rows, best score first; NULL for the others.

    Of the rows with ``least_words`` words, ``percent`` of a hundred are drawn. Rows
    are counted by score first; only scores that a drawn row can have are ranked.
    """
    scored = kept_table(scored, "scores")
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").count()
    down = Window.orderBy(F.desc("score"))  # one row per score: bounded, see above
    counts = kept_table(
        counts.select(
            "score",
            F.coalesce(F.sum("count").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"),
            F.sum("count").over(Window.partitionBy(F.lit(0))).alias("__all"),
        ),
        "score-counts",
    )
    wanted = F.floor(F.col("__all") * percent / 100)
    reached = F.broadcast(counts.withColumn("__wanted", wanted).where("__above < __wanted").drop("__all"))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    place = F.col("__above") + F.row_number().over(within)
    rows = scored.where(able)
    drawn = rows.join(reached, "score").withColumn("rank", F.when(place <= F.col("__wanted"), place).cast("long"))
    others = rows.join(reached, "score", "left_anti").unionByName(scored.where(~able)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*scored.columns, "rank").unionByName(others.select(*scored.columns, "rank"))


def resampled_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, in no order."""
    drawn = ranked(importance_scores(docs, target, **options), percent, least_words).where("rank is not null")
    return drawn.select(*[c for c in docs.columns if c in drawn.columns])


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    scored = importance_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


#: The same in SQL: CRC-32 by its table, which a rule gives, over the distinct words.
ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           list_prepend(i::BIGINT, list_transform(range(8), lambda b: b::BIGINT)),
           lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS (
  SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
vocabulary AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda i:
           ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT word FROM words)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table),
totals AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
  FROM words JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM totals),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM totals, sums),
weights AS (
  SELECT id, count(*) AS n, floor(sum(gain)::BIGINT / count(*))::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 's' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * n / 100) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""
