"""Operator 1, substring dedup: content-defined chunks by a gear rolling hash.

A gear hash runs over the bytes of each text; where its top bits are zero a
chunk may end. A candidate counts when no other lies less than ``MIN_BYTES``
before it, and the cut goes to the next start of a word. Both depend on the
bytes just before alone, so an insertion moves the cuts around it and no others:
a passage is cut alike wherever it stands. Chunks are known by a 64-bit digest
of their words. A digest found in several documents stays in the one of the
smallest doc_id; elsewhere it is a repeat. Repeats in a row make a span, and
spans of ``MIN_WORDS`` words or more are removed. A false match of digests is
therefore harmless unless several adjacent chunks collide as well.

Defined cases: NULL and empty texts have no chunks; rows of one doc_id count as
one document and never repeat each other, equal rows get equal results; a
row without doc_id is the document of its text, after all that have one (ids lie
below 2**62); an empty table gives an empty result; extra columns are ignored, :func:`dedup_documents` keeps them. Texts
without cuts are cut every ``MAX_BYTES`` bytes.

Recovery and size: the chunks are written to the shared folder once. Finding
repeated digests is an aggregate with a map-side part; marking repeats joins
two written tables, so a digest held by a third of all documents is a skewed
key that Spark splits. A document's spans come from a window over its own
repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from .common import kept_table, slices, text_hash

MIN_BYTES = 16
MAX_BYTES = 1024
CUT_BITS = 4
FAR = 64
MIN_WORDS = 16
#: Documents without an id are numbered from here by the hash of their text.
NO_ID = 1 << 62

#: A random 32-bit number per byte value, always the same.
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest() for b in range(256)), np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum over the last 32 bytes of GEAR[byte] << its distance, modulo 2**32."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def cut_places(data: np.ndarray, min_bytes: int = MIN_BYTES, cut_bits: int = CUT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks, the last one the length, and the number of words before each byte and the end."""
    gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = ~gap & np.append(True, gap[:-1])
    words = np.append(0, np.cumsum(begins))
    at = np.flatnonzero(gear_hash(data) >> np.uint32(32 - cut_bits) == 0) + 1
    at = at[np.diff(at, prepend=0) >= min_bytes]
    starts = np.append(np.flatnonzero(begins), len(data))
    word = starts[np.searchsorted(starts, at)]
    inner = np.append(data & 0xC0 == 0x80, [False] * 4)
    for _ in range(3):  # a character is at most four bytes
        at = at + inner[at]
    cuts = np.unique(np.append(np.where(word - at > FAR, at, word), len(data)))
    cuts = cuts[cuts > 0]
    wide = np.flatnonzero(np.diff(cuts, prepend=0) > MAX_BYTES)
    if len(wide):
        more = []
        for k in wide:
            forced = np.arange((cuts[k - 1] if k else 0) + MAX_BYTES, cuts[k], MAX_BYTES)
            for _ in range(3):
                forced = forced + inner[forced]
            more.append(forced)
        cuts = np.unique(np.concatenate([cuts, *more]))
        cuts = cuts[cuts <= len(data)]
    return cuts, words


def chunks(text: str | None) -> list[dict]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return []
    cuts, words = cut_places(np.frombuffer(raw, np.uint8))
    words, cuts = words[np.append(0, cuts)].tolist(), [0, *cuts.tolist()]
    digest = hashlib.blake2b
    return [
        {
            "d": int.from_bytes(digest(b" ".join(raw[a:b].split()), digest_size=8).digest(), "little", signed=True),
            "pos": i, "begin": a, "end": b, "w0": words[i], "w1": words[i + 1],
        }
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        if words[i + 1] > words[i]
    ]


_CHUNK = "struct<d:long,pos:int,begin:int,end:int,w0:int,w1:int>"
_ARROW = pa.list_(pa.struct([("d", pa.int64())] + [(c, pa.int32()) for c in ("pos", "begin", "end", "w0", "w1")]))


def _chunked(batches):
    for batch in slices(batches):
        found = pa.array([chunks(t) for t in batch.column("text").to_pylist()], _ARROW)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("k"), found], names=["doc", "k", "chunks"])


def row_key() -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, k, begin, end, n_words, keeper: byte spans to remove, and the doc_id that keeps the text.

    ``doc`` is doc_id, a number from NO_ID on where it is NULL; ``k`` tells rows apart (:func:`row_key`).
    """
    by_text = F.lit(NO_ID) + F.pmod(text_hash(), F.lit(NO_ID))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), by_text).alias("doc"), row_key().alias("k"), F.col("text").cast("string"))
    cut = kept_table(rows.mapInArrow(_chunked, f"doc long, k long, chunks array<{_CHUNK}>"), "chunks")
    repeated = kept_table(
        cut.select("doc", F.explode("chunks.d").alias("d"))
        .groupBy("d")
        .agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"))
        .where("keeper < last")
        .select("d", "keeper"),
        "chunk-repeats",
    )
    repeats = (
        cut.select("doc", "k", F.inline("chunks")).join(repeated, "d").where("doc != keeper").drop("d")
    )
    own = Window.partitionBy("doc", "k").orderBy("pos")
    return (
        repeats.withColumn("island", F.col("pos") - F.dense_rank().over(own))
        .groupBy("doc", "k", "island")
        .agg(
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            (F.max("w1") - F.min("w0")).cast("long").alias("n_words"),
            F.min("keeper").alias("keeper"),
        )
        .where(F.col("n_words") >= min_words)
        .drop("island")
    )


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    def rest(value, gone):
        if value is None or gone is None:
            return value
        raw, out, at = value.encode("utf-8", "surrogatepass"), [], 0
        for begin, end in sorted((s["begin"], s["end"]) for s in gone):
            out.append(raw[at:begin])
            at = end
        return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

    return pd.Series([rest(*x) for x in zip(text, spans)], dtype=object)


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans cut out of their texts, every row and column kept.

    ``n_chars`` follows the text where it is there.
    """
    spans = (
        repeated_spans(docs, min_words)
        .groupBy("k")
        .agg(F.collect_set(F.struct("begin", "end")).alias("__spans"))
        .withColumnRenamed("k", "__k")
    )
    joined = docs.join(spans, row_key() == F.col("__k"), "left")
    cut = F.pandas_udf(_cut, StringType())
    out = joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut("text", "__spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """Every span removed: the document, the bytes, its words, and the document that keeps the passage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    doc_id = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias
    return repeated_spans(docs).select(
        doc_id("doc")("doc_id"), F.col("begin").alias("begin_byte"), F.col("end").alias("end_byte"), "n_words", doc_id("keeper")("kept_doc_id")
    )
