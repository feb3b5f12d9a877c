"""What several operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_dir

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without an argument splits at exactly these.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at once inside a task, in bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 400_000) -> DataFrame:
    """``df``, broadcast if its rows are counted and few; a few numbers each make some ten MB at most.

    Meant for written tables of numbers, which are counted from their footers.
    Beyond that Spark chooses, and shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def hash_sample(rows: DataFrame, keys: list[str], n: int, total: int) -> DataFrame:
    """About ``n`` of ``total`` rows, chosen by the hash of their keys, never over 2 n.

    Each task keeps its own share, so what reaches the driver is bounded whatever
    the number of tasks; a sorted limit would send n rows from each of them.
    """
    if total <= n:
        return rows
    share = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 40))
    return rows.where(share < int((1 << 40) * n / total)).limit(2 * n)


def text_hash(text: str = "text") -> Column:
    """Tells rows of one id apart by their text; NULL counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fold(source: str) -> Column:
    """A join key that is never NULL and keeps NULL apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``size_bytes`` of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > size_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield batch.slice(start)
