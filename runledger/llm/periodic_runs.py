"""Operator 13, periodic run detection: stretches of words that repeat with a period.

A run is a stretch of words with smallest period q (words q apart are identical), of
at least ``least_words`` words and ``least_times`` periods, that no word beside it
extends. Every run of two periods or more holds, in one of two orders of the words
that are each other's reverse, a root that is the longest Lyndon word from its place
on: the stretch up to the next smaller suffix. So there are two candidates a word;
each is extended to both sides by the longest common extension of its two ends, to
the right in the suffix tree of the words and to the left in that of their reversal.

A word that stands in a run stands there at least ``least_times`` times. A document
is therefore cut at the words that it, or what is left of it, has fewer times, again
until none is left; trees are built of the stretches in between, which hold all runs.

Defined cases: a NULL or empty text has no words and no runs; runs may overlap, and
equal stretches with one period are one run; a word is dropped if any run has it
after its first period; rows of one id are rows of their own; an empty table gives
an empty result; extra columns are ignored.

Recovery and size: texts are handled one by one without a shuffle. A text's words
are kept as numbers, and a tree takes about 1 KB per word of the longest stretch
without rare words, which is the whole of a text that repeats itself throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import read, slices
from .suffix_tree import Extensions, SuffixTree
from .words import pieces

LEAST_WORDS = 6
LEAST_TIMES = 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Numbers(dict):
    """A number for every word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """A text's words as numbers, and the words by their number."""
    numbers, found = _Numbers(), [np.zeros(0, np.int32)]
    for piece in pieces(text or b""):
        words = piece.split()
        found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    return np.concatenate(found), list(numbers)


def stretches(words: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches in which every word stands ``least_times`` times: all runs lie inside."""
    open_ = [(0, len(words))]
    while open_:
        start, end = open_.pop()
        if end - start < least_words:
            continue
        _, which, counts = np.unique(words[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[which] < least_times)
        if not len(rare):
            yield start, end
            continue
        edges = np.concatenate([[-1], rare, [end - start]])
        wide = np.flatnonzero(np.diff(edges) > least_words)
        open_ += [(start + int(edges[k]) + 1, start + int(edges[k + 1])) for k in wide]


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix the start of the next one that is smaller; the empty one ends the list."""
    values = ranks.tolist()
    found, open_ = [0] * len(values), []
    for i, rank in enumerate(values):
        while open_ and values[open_[-1]] > rank:
            found[open_.pop()] = i
        open_.append(i)
    return np.array(found[:-1], np.int64)


def runs_of_stretch(words: np.ndarray, least_words: int, least_times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence."""
    _, symbols = np.unique(words, return_inverse=True)
    symbols, n = (symbols + 1).tolist(), len(words)
    most = max(symbols)
    tree = SuffixTree(symbols, most)
    below = tree.below()
    roots = [next_smaller(tree.ranks(below, downwards)) for downwards in (False, True)]
    ahead = Extensions(tree, below)
    del tree, below
    behind = Extensions(SuffixTree(symbols[::-1], most))
    at, to = np.tile(np.arange(n), 2), np.concatenate(roots)
    right = ahead.common(at, to)
    left = behind.common(n - at, n - to)
    found = np.stack([at - left, to - at + right + left, to - at], axis=1)
    keep = found[:, 1] >= np.maximum(least_words, least_times * found[:, 2])
    return np.unique(found[keep], axis=0)


def runs(words: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    for start, end in stretches(words, least_words, least_times):
        found.append(runs_of_stretch(words[start:end], least_words, least_times) + [start, 0, 0])
    every = np.concatenate(found)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run has after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def periodic_runs(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    least_times: int = LEAST_TIMES,
    rewrite: Callable[[int | None, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """doc_id, n_words, the runs in order, and the text with each run cut to its first period.

    ``rewrite`` may give other words for a document, from its id and numbered words.
    """

    def found(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches):
            n_words, spans, texts = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words, names = numbered(text)
                if rewrite:
                    words = rewrite(doc_id, words)
                mine = runs(words, least_words, least_times)
                n_words.append(len(words))
                spans.append([{"start": a, "length": b, "period": c} for a, b, c in mine.tolist()])
                texts.append(b" ".join(map(names.__getitem__, words[kept_words(len(words), mine)].tolist())))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, SCHEMA)


def collapsed_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text, every run cut to its first period."""
    return periodic_runs(docs, **options).select("doc_id", F.col("collapsed").alias("text"))


def planted_tail(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words the query works on: one document in ten, by its id, ends in a repetition.

    A row without an id stays as it is.
    """
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(words[:a], words[a + np.arange(n - a) % p])


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents"), rewrite=planted_tail)
    # The longest run, of equal ones the first, then the one of the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
