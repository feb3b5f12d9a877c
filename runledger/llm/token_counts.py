"""Operator 2, token counts: byte-pair merging of batched pre-tokens as ragged arrays.

Every task splits its texts into pre-tokens, gathers those it has not met yet,
and merges them all at once: the sequences lie in one array, and in each round
every sequence applies its pair of lowest rank. The symbols that survive are
counted, and a document's count is the sum over its pre-tokens. Nothing is
shuffled; a lost task is simply done again.

Defined cases: NULL and empty texts have 0 tokens; the tokenizer's special
strings inside texts count as their one token; repeated rows are counted each;
an empty table gives an empty result; extra columns are ignored.

Memory: texts are handled ``SLICE`` bytes at a time, and counts are remembered
for ``REMEMBERED`` pre-tokens at most, after which they are worked out again.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .merging import PairTable, merge

LIMIT = 1024
REMEMBERED = 1_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class ByteLevelCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        self.table = PairTable(
            [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs]
        )
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int32)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        _, counts = merge(self.of_byte[flat], np.array([len(x) for x in raw], np.int64), self.table)
        self.known.update(zip(pieces, counts.tolist()))

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand between them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self.pattern.findall(part)], len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [self.split(t) if t else ([], 0) for t in texts]
        new = set()
        for pieces, _ in cut:
            new |= set(pieces).difference(self.known)
        if new:
            self.learn(list(new))
        return [sum(map(self.known.__getitem__, pieces)) + extra for pieces, extra in cut]


@functools.cache
def counter(path: str) -> ByteLevelCounter:
    """One per Python worker."""
    return ByteLevelCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""

    def counted(batches):
        count = counter(path).count
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(count(batch.column("text").to_pylist()), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string"),
    )
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
