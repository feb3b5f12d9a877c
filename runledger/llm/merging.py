"""Rank-synchronous merging of symbol pairs over many short sequences at once."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max


class PairTable:
    """Looks up (left, right) symbol pairs: the rank of their merge and the merged symbol."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        keys = left << 32 | right
        order = np.lexsort((rank, keys))
        first = np.append(True, keys[order][1:] != keys[order][:-1]) if len(keys) else np.zeros(0, bool)
        self.keys, self.rank, self.merged = (x[order][first] for x in (keys, rank, merged))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair has no merge) and merged symbol of each pair."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32), np.zeros(len(left), np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE), self.merged[at]


def merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable, leftmost: bool = False):
    """Merge every sequence to its end; returns (symbols, lengths), sequences in order.

    ``symbols`` holds the sequences one after another. In each round every
    sequence merges its pair of lowest rank: all of its places that do not
    overlap, from the left, or with ``leftmost`` only the first. The former
    equals merging one by one when no merge makes a pair of a lower rank.
    """
    lengths = np.asarray(lengths, np.int64)
    symbols, seq = np.array(symbols, np.int32), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    counts = np.zeros(len(lengths), np.int64)
    done = []

    def ranks(at: np.ndarray):
        """Rank and merged symbol of the pairs that begin at these places."""
        rank, merged = np.full(len(at), NONE, np.int32), np.zeros(len(at), np.int32)
        pair = at + 1 < len(symbols)
        pair[pair] = seq[at[pair]] == seq[at[pair] + 1]
        rank[pair], merged[pair] = table.find(symbols[at[pair]], symbols[at[pair] + 1])
        return rank, merged

    rank, merged = ranks(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        sizes = np.diff(np.append(starts, len(seq)))
        low = np.minimum.reduceat(rank, starts)
        alive = low < NONE
        if not alive.all():
            stay = np.repeat(alive, sizes)
            done.append((seq[~stay], symbols[~stay]))
            counts[seq[starts[~alive]]] = sizes[~alive]
            symbols, seq, rank, merged = symbols[stay], seq[stay], rank[stay], merged[stay]
            low, sizes = low[alive], sizes[alive]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == np.repeat(low, sizes))
        if leftmost:
            hit = hit[np.append(True, seq[hit][1:] != seq[hit][:-1])]
        else:  # of places in a row, as in a a a, every second overlaps
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        symbols[hit] = merged[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, seq, rank, merged = symbols[keep], seq[keep], rank[keep], merged[keep]
        hit = hit - np.arange(len(hit))
        touched = np.zeros(len(symbols), bool)
        touched[hit] = touched[np.maximum(hit - 1, 0)] = True
        stale = np.flatnonzero(touched)
        rank[stale], merged[stale] = ranks(stale)
    if not done:
        return np.zeros(0, np.int32), counts
    order = np.argsort(np.concatenate([s for s, _ in done]), kind="stable")
    return np.concatenate([x for _, x in done])[order], counts
