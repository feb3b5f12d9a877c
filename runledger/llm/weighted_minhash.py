"""Weighted MinHash of texts: TF-IDF shingles and improved consistent weighted sampling.

A text is its words between gaps, A-Z in lower case; a shingle is five words in
a row, and a text of fewer words is one shingle. A shingle weighs the number of
times it occurs, times one plus the mean idf of its words: a shingle's own
document frequency would equal the size of its group of copies and so punish
large groups. A word found in fewer than ``rare`` of the documents weighs as if
in that many, which bounds the table of frequencies. Weights are rounded to
steps of a sixteenth of a power of two, alike for sampling and for similarity.

Consistent sampling draws for each hash function and shingle r and c from
Gamma(2, 1) and b from [0, 1), and keeps the shingle of the smallest
``ln c - r (floor(ln w / r + b) - b) - r`` with that floor. The draws come from a
table that a hash of the shingle indexes, so the value is a look-up by weight
step and index; ties go by the remaining bits of the hash.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np

WIDTH = 5
STEPS = 16  # per power of two
LEVELS = 352
DRAWS = 1 << 14
BLOCK = 1 << 16
REMEMBERED = 400_000
U64 = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 1 << 62, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


def _sampling_table() -> np.ndarray:
    """[level, draw] -> rank of the value, as an unsigned integer in its order."""
    random = np.random.RandomState(11)
    r, c = random.gamma(2.0, 1.0, DRAWS), random.gamma(2.0, 1.0, DRAWS)
    b = random.random_sample(DRAWS)
    log_weight = np.arange(LEVELS)[:, None] * (math.log(2) / STEPS)
    value = (np.log(c) - r * (np.floor(log_weight / r + b) - b) - r).astype(np.float32)
    bits = value.view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31))


class Shingler:
    """Shingles and weights of many texts at once; ``idf`` by word hash, ``idf_rare`` for all others."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, idf_rare: float):
        self.idf_of = dict(zip(hashes.tolist(), idf.tolist()))
        self.idf_rare = idf_rare
        self.factors = _odd(3, WIDTH)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.idfs = np.zeros(1, U64), np.zeros(1, np.float32)  # place 0: no word

    def _learn(self, words: list[bytes]) -> None:
        hashes = [word_hash(w) for w in words]
        self.known.update(zip(words, range(len(self.hashes), len(self.hashes) + len(words))))
        self.hashes = np.append(self.hashes, np.array(hashes, U64))
        self.idfs = np.append(self.idfs, np.array([self.idf_of.get(h, self.idf_rare) for h in hashes], np.float32))

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, weight levels and the number of keys per text; a text's keys are sorted and distinct."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = set().union(*texts).difference(self.known) if texts else set()
        if new:
            self._learn(sorted(new))
        padded = [[*map(self.known.__getitem__, t), *([0] * (WIDTH - len(t)))] if t else t for t in texts]
        sizes = np.array([len(t) for t in padded], np.int64)
        flat = np.fromiter(chain.from_iterable(padded), np.int32, int(sizes.sum()))
        counts = np.maximum(sizes - WIDTH + 1, 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        firsts = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
        key, idf = np.zeros(len(firsts), U64), np.zeros(len(firsts), np.float32)
        for k in range(WIDTH):
            word = flat[firsts + k]
            key += self.hashes[word] * self.factors[k]
            idf += self.idfs[word]
        key = _mix(key) >> U64(20)  # 44 bits; the owner above them sorts all texts at once
        order = np.argsort(owner.astype(U64) << U64(44) | key, kind="stable")
        key, owner, idf = key[order], owner[order], idf[order]
        fresh = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, int)
        times = np.diff(np.append(fresh, len(key)))
        weight = times * (1 + idf[fresh] / WIDTH)
        level = np.clip(np.rint(STEPS * np.log2(weight)), 0, LEVELS - 1).astype(np.int32) if len(fresh) else np.zeros(0, np.int32)
        return key[fresh], level, np.bincount(owner[fresh], minlength=len(texts))


def weights_of(level: np.ndarray) -> np.ndarray:
    return np.exp2(level / STEPS)


class Sampler:
    """Signatures of ``bands`` times ``rows`` samples, folded to one number per band.

    The last ``plain`` bands sample as if every shingle weighed one.
    """

    def __init__(self, bands: int, rows: int, plain: int = 0):
        self.bands, self.rows, self.weighted = bands, rows, bands - plain
        self.table = _sampling_table().ravel()
        self.factors = _odd(5, bands * rows)
        self.folds = _odd(9, rows)

    def __call__(self, keys: np.ndarray, levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """[text, band]; texts without shingles have zeros."""
        out = np.zeros((len(counts), self.bands), np.int64)
        some = np.flatnonzero(counts)
        ends = np.cumsum(counts[some])
        at = 0
        while at < len(some):
            begin = ends[at] - counts[some[at]]
            upto = max(at + 1, int(np.searchsorted(ends, begin + BLOCK)))
            block = slice(begin, ends[upto - 1])
            spread = _mix(keys[block])
            base = levels[block].astype(np.int64) * DRAWS
            starts = (ends[at:upto] - counts[some[at:upto]]) - begin
            samples = np.empty((len(self.factors), upto - at), U64)
            for k, factor in enumerate(self.factors):
                x = spread * factor
                draw = (x >> U64(50)).astype(np.int64)
                value = self.table[base + draw if k < self.weighted * self.rows else draw].astype(U64) << U64(32)
                value |= (x >> U64(18)) & U64(0xFFFFFFFF)
                samples[k] = np.minimum.reduceat(value, starts)
            for band in range(self.bands):
                folded = np.full(upto - at, U64(band + 1))
                for row in range(self.rows):
                    folded = _mix((folded ^ samples[band * self.rows + row]) * self.folds[row])
                out[some[at:upto], band] = folded.view(np.int64)
            at = upto
        return out


def similarity(key_a, level_a, key_b, level_b) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two texts' sorted keys and levels."""
    if not len(key_a) or not len(key_b):
        return 0.0, 0.0
    _, at_a, at_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    shared = weights_of(np.minimum(level_a[at_a], level_b[at_b])).sum()
    weighted = shared / (weights_of(level_a).sum() + weights_of(level_b).sum() - shared)
    return float(weighted), len(at_a) / (len(key_a) + len(key_b) - len(at_a))
