"""Operator 5, SentencePiece encoding with byte spans, and decoding.

The normaliser walks the model's compiled character map (a double-array trie):
at every place the longest mapped prefix is replaced, and each byte it writes
records the place of the source it came from. Pieces are found on the
normalised text and projected through that record to spans of the original
bytes. A unit is a run of U+2581 and what follows up to the next one; where no
piece crosses units they are encoded apart, each distinct one once, all new
ones of a slice together (:mod:`merging`). Ids are turned back to text by the
library's own ``decode``.

Defined cases: NULL and empty texts have no pieces and decode to the empty
text; characters without a piece become byte pieces, of which the last spans
the character and the others are empty; repeated rows are encoded each; an empty
table gives an empty result; extra columns are ignored. Models other than BPE
with byte pieces, or with user-defined or unused pieces, raise ValueError.

Nothing is shuffled, a lost task is simply done again. Memory: texts are
handled a slice at a time, ``REMEMBERED`` units at most are remembered, and a
unit of over ``LONG`` characters is merged with a heap instead of in rounds.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import slices
from .merging import PairTable, merge

SPACE = "▁"
REMEMBERED = 300_000
SLICE = 4 << 20
LONG = 256
#: Symbols from here on stand for characters that are no piece.
BARE = 1 << 21


class CharacterMap:
    """The compiled map of a normaliser: longest mapped prefix at a place."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest mapped prefix becomes and its length; length 0 if none is mapped."""
        units, best, found = self.units, 0, -1
        if not units:
            return b"", 0
        offset = lambda unit: unit >> 10 << ((unit & 0x200) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best, found = i + 1 - at, units[node] & 0x7FFFFFFF
        return (self.pool[found : self.pool.index(0, found)], best) if best else (b"", 0)


class Normalizer:
    def __init__(self, spec, space_as_suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = space_as_suffix
        self.space = SPACE.encode() if self.escape else b" "
        self.plain = not self.map.units and not self.squeeze and not space_as_suffix

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        out, length = self.map.longest(data, at)
        if not length:
            lead = data[at]
            length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            out = data[at : at + length]
        return out, length

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source place of each of them and of the end."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            head = self.space if self.dummy else b""
            source = np.frombuffer(data, np.uint8)
            widths = np.where(source == 0x20, len(self.space), 1)
            at = np.repeat(np.arange(len(data)), widths)
            return head + data.replace(b" ", self.space), np.concatenate([np.zeros(len(head), np.int64), at, [len(data)]])
        at, out, origin = 0, bytearray(), []

        def put(piece: bytes):
            out.extend(piece)
            origin.extend([at] * len(piece))

        while self.squeeze and at < len(data) and (step := self.prefix(data, at))[0] == b" ":
            at += step[1]
        if at == len(data):
            return b"", np.array([at])
        if self.dummy and not self.suffix:
            put(self.space)
        after_space = self.squeeze
        while at < len(data):
            piece, length = self.prefix(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", self.space))
                after_space = self.squeeze and piece.endswith(b" ")
            at += length
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :]
            at = origin[len(out)]
            del origin[len(out) :]
        if self.dummy and self.suffix:
            put(self.space)
        return bytes(out), np.array(origin + [at], np.int64)


def merge_long(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """One long sequence: the best pair first, the leftmost among equals, from a heap."""
    after = list(range(1, len(symbols))) + [-1]
    before = list(range(-1, len(symbols) - 1))
    symbols, heap = list(symbols), []

    def offer(i: int):
        j = after[i]
        if j >= 0 and (found := pairs.get((symbols[i], symbols[j]))):
            heap.append((found[0], i, symbols[i], symbols[j], found[1])) if fill else heapq.heappush(
                heap, (found[0], i, symbols[i], symbols[j], found[1])
            )

    fill = True
    for i in range(len(symbols)):
        offer(i)
    heapq.heapify(heap)
    fill = False
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = merged, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]


class PieceEncoder:
    def __init__(self, path: str):
        self.decode = sentencepiece.SentencePieceProcessor(model_file=path).decode
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = type(model.pieces[0])
        if model.trainer_spec.model_type != 2 or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte pieces, a piece for each character of a piece, and none user-defined or unused")
        self.normalize = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if not {c for p in normal for c in p} <= normal.keys():
            raise ValueError(f"a character of a piece has none itself: {path}")
        self.text_of = list(map(str, range(len(model.pieces))))
        self.widths, self.lead = np.zeros((2, len(model.pieces)), np.int64)
        for p, i in normal.items():
            self.widths[i] = len(p.encode())
        for value, i in self.bytes.items():
            self.lead[i] = 1 if value < 0x80 else 0 if value < 0xC0 else 2 if value < 0xE0 else 3 if value < 0xF0 else 4
        symbol = lambda s: normal.get(s, -1)
        rank = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        rows = [
            (symbol(p[:k]), symbol(p[k:]), rank[model.pieces[i].score], i)
            for p, i in normal.items()
            for k in range(1, len(p))
        ]
        rows = [r for r in rows if r[0] >= 0 and r[1] >= 0]
        self.table = PairTable(*(zip(*rows) if rows else [[]] * 4))
        self.pairs = None
        self.of_char = BARE + np.arange(0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        for value, i in self.bytes.items():
            if value < 0x80 and chr(value) not in normal:  # such a character is its byte piece, which no pair has
                self.of_char[value] = i
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        self.unit = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.known: dict[str, bytes] = {}  # unit -> its ids, four bytes each

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _with_bytes(self, symbols: list[int]) -> np.ndarray:
        ids = []
        for s in symbols:
            ids += [s] if s < BARE else [self.bytes[b] for b in chr(s - BARE).encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32)

    def learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= LONG]
        flat, sizes = merge(self._symbols("".join(short)), [len(u) for u in short], self.table, leftmost=True)
        ends = np.cumsum(sizes)
        raw, whole = flat.tobytes(), (4 * ends).tolist()
        self.known.update(zip(short, (raw[a:b] for a, b in zip([0, *whole], whole))))
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat >= BARE), side="right")).tolist():
            self.known[short[k]] = self._with_bytes(flat[ends[k] - sizes[k] : ends[k]].tolist()).tobytes()
        for unit in units:
            if len(unit) > LONG:
                if self.pairs is None:
                    t = self.table
                    self.pairs = dict(zip(zip((t.keys >> 32).tolist(), (t.keys & 0xFFFFFFFF).tolist()), zip(t.rank.tolist(), t.merged.tolist())))
                self.known[unit] = self._with_bytes(merge_long(self._symbols(unit).tolist(), self.pairs)).tobytes()

    def spans(self, ids: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte, exclusive, of each piece in the original text."""
        widths = self.widths[ids]
        lead = np.flatnonzero(self.lead[ids])  # the first byte piece of a character; its last one spans it
        widths[lead + self.lead[ids[lead]] - 1] = self.lead[ids[lead]]
        ends = np.cumsum(widths)
        return origin[ends - widths], origin[ends]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the source places of its normalised bytes."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut, new = [], set()
        for text in texts:
            data, origin = self.normalize((text or "").encode("utf-8", "surrogatepass"))
            units = self.unit.findall(data.decode("utf-8", "surrogatepass"))
            new |= set(units).difference(self.known)
            cut.append((units, origin))
        if new:
            self.learn(list(new))
        return [(np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32), origin) for units, origin in cut]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One per Python worker."""
    return PieceEncoder(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, and of every piece its id and the bytes [begin, end) of the text it stands for."""

    def encoded(batches):
        tool = encoder(path)
        for batch in slices(batches, size_bytes=SLICE):
            ids, begins, ends = [], [], []
            for own, origin in tool.encode(batch.column("text").to_pylist()):
                ids.append(own)
                begin, end = tool.spans(own, origin)
                begins.append(begin.tolist())
                ends.append(end.tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, kind), pa.array(begins, kind), pa.array(ends, kind)],
                names=["doc_id", "ids", "begins", "ends"],
            )

    return _texts(docs).mapInArrow(encoded, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and bytes under the pieces' spans."""

    def digested(batches):
        tool = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in slices(batches, size_bytes=SLICE):
            counts, of_ids, of_texts, covered = [], [], [], []
            for own, origin in tool.encode(batch.column("text").to_pylist()):
                begin, end = tool.spans(own, origin)
                ids = own.tolist()
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(tool.text_of.__getitem__, ids))))
                of_texts.append(sha(tool.decode(ids) if ids else ""))
                covered.append(int((end - begin).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()), pa.array(covered, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )

    return _texts(docs).mapInArrow(
        digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    )


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
