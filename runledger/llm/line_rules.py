"""Operator 9, quality rules: lines that many documents of one host share.

Every line is lower-cased, its gaps collapsed, and hashed. For each host (the
``source`` column) the documents that hold a line are counted, and a line is a
candidate when they are more than ``max(min_docs, share * documents of the host)``.
For candidates the distinct documents are counted and held against the same limit.
Rows of one text are one document. Near copies must not turn their prose into
boilerplate either, so a document is known to a line by the smallest hash of two
adjacent words among its other lines, which copies with a few edits mostly share; this
is done with ``len(MASKS)`` orders of the hashes, and the mean number of different
values counts. Near copies differ in a few of these values as well, so a line is over
the limit when the different values pass the limit by at least ``spread`` of the
number by which its texts pass it: lines of texts that share less than about nine
tenths of their words are told from lines of near copies, however many lines are
shared; texts more alike than that are left to near-duplicate detection.

Lines over the limit are removed. A document is rejected when its base rules
fail, or when the removal leaves fewer than ``min_left_words`` words or less
than ``min_left_share`` of its words.

Defined cases: NULL text is empty, an empty text has no words and fails its
base rules; NULL hosts are one host of their own; repeated rows are copies and
each keeps its own result row; an empty table gives an empty result; extra
columns are ignored by the rules and kept by :func:`clean_documents`.

Recovery and size: one narrow pass over the texts writes counts and line hashes
to a shared table; from there on only hashes move. Counting is by hash first, then
for candidates by hash and text, then by hash and context, so a line in a third of
all rows is combined in the map tasks; the join that marks candidates reads both
sides from written tables, so Spark can broadcast a small side or split a hot key.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import concat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from .common import fold, hash64, kept_table, slices, text_hash

SYMBOLS = "#*$%&|<>"
#: Each turns the order of 32-bit hashes into another.
MASKS = np.array([0x00000000, 0xA5C3965A, 0x5B1E77D2, 0xF0694B8D], np.uint32)


@dataclass(frozen=True)
class Limits:
    min_docs: int = 10
    share: float = 0.005
    spread: float = 0.15
    min_left_words: int = 30
    min_left_share: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50


def line_key(line: str) -> int | None:
    """Hash of the normalised line; None for a line without a word."""
    words = line.lower().encode("utf-8", "surrogatepass").split()
    return hash64(b" ".join(words)) if words else None


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, upto, total = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(hash, words, context)]."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    raw, dup, keys, pairs = set(), 0, {}, {}
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            continue
        dup += line in raw
        raw.add(line)
        key = line_key(line)
        keys[key] = keys.get(key, 0) + len(own)
        if key not in pairs:
            hashes = np.fromiter(map(crc32, map(concat, own, own[1:])) if len(own) > 1 else [crc32(own[0])], np.uint32)
            pairs[key] = (hashes[:, None] ^ MASKS).min(0).tolist()
    # Of each order the two lines with the least values: the second serves the first's own line.
    least = [sorted((v[j], k) for k, v in pairs.items())[:2] for j in range(len(MASKS))]
    context = lambda key: [next((v for v, k in two if k != key), -1) for two in least]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in " \t\n\x0b\f\r"),
        sum(text.count(c) for c in SYMBOLS),
        dup,
        repeat_words(words),
        [{"h": k, "words": n, "context": context(k)} for k, n in keys.items()],
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINES = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64()), ("context", pa.list_(pa.int64()))]))


def _measured(batches):
    for batch in slices(batches):
        found = list(zip(*map(measure, batch.column("text").to_pylist())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), batch.column("host")]
            + [pa.array(x, pa.int64()) for x in found[:5]]
            + [pa.array(found[5], _LINES)],
            names=["doc_id", "text_hash", "host", *_COUNTS, "lines"],
        )


def line_verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: counts, hashes of removed lines, ``base_failed`` and ``kept``."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"), fold("source").alias("host")
    )
    measured = kept_table(
        rows.mapInArrow(
            _measured,
            "doc_id long, text_hash long, host string, "
            + ", ".join(f"{c} long" for c in _COUNTS)
            + ", lines array<struct<h:long,words:long,context:array<long>>>",
        ),
        "line-measures",
    )
    lines = measured.select("doc_id", "text_hash", "host", F.explode("lines").alias("line")).select(
        "doc_id", "text_hash", "host", "line.h", "line.context"
    )
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(limits.min_docs), limits.share * F.col("host_docs"))
    raw = lines.groupBy("host", "h").agg(F.count("*").alias("held_by")).where(F.col("held_by") > limits.min_docs)
    candidates = kept_table(
        raw.join(hosts, "host").withColumn("limit", limit).where("held_by > limit").select("host", "h", "limit"), "line-candidates"
    )
    held = kept_table(lines.join(candidates, ["host", "h"]), "line-holders")
    texts = held.groupBy("host", "h", "limit", "text_hash").agg(F.first("context").alias("context"))
    over = kept_table(
        texts.select("host", "h", "limit", F.posexplode("context").alias("order", "context"))
        .groupBy("host", "h", "limit", "order", "context")
        .agg(F.count("*").alias("n"))
        .groupBy("host", "h", "limit")
        .agg((F.sum("n") / len(MASKS)).alias("n_texts"), (F.count("*") / len(MASKS)).alias("distinct_docs"))
        .where(F.col("distinct_docs") > F.col("limit") + limits.spread * F.greatest(F.col("n_texts") - F.col("limit"), F.lit(0)))
        .select("host", "h"),
        "line-over",
    )
    removed = (
        held.select("doc_id", "text_hash", "host", "h")
        .join(over, ["host", "h"])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("h").alias("removed"))
        .select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "removed")
    )
    joined = measured.join(
        removed,
        F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")),
        "left",
    ).withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
    lost = F.aggregate(
        F.filter("lines", lambda x: F.array_contains("removed", x["h"])),
        F.lit(0).cast("long"),
        lambda total, x: total + x["words"],
    )
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    left = F.col("n_words") - F.col("lost_words")
    return (
        joined.withColumn("lost_words", lost)
        .withColumn("base_failed", failed)
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (left >= limits.min_left_words)
            & (left >= limits.min_left_share * F.col("n_words")),
        )
        .select("doc_id", "text_hash", *_COUNTS, "lost_words", "base_failed", "kept", "removed")
    )


@F.pandas_udf(StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    def cut(value, gone):
        if value is None or not len(gone):
            return value
        gone = set(gone)
        return "\n".join(x for x in value.split("\n") if line_key(x) not in gone)

    return pd.Series([cut(*x) for x in zip(text, removed)], dtype=object)


def clean_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without rejected documents and without lines over the limit, all columns kept.

    ``n_chars`` follows the text where it is there.
    """
    verdicts = (
        line_verdicts(docs, limits)
        .where("kept")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__removed"))
        .dropDuplicates(["__id", "__hash"])
    )
    joined = docs.join(
        verdicts,
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__hash")),
    )
    out = joined.withColumn("text", F.when(F.size("__removed") > 0, _without("text", "__removed")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op9_line_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_verdicts(docs).drop("text_hash", "removed")
