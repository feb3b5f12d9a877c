"""Longest common extensions of positions of one sequence, by its suffix tree.

Built by Ukkonen's algorithm over numbered symbols; two suffixes agree as far as
their leaves' lowest common ancestor is deep, which is the least depth between them
on an Euler tour of the tree.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16


class RangeMinimum:
    """Least value between two places, for many pairs of places at once, each in constant time.

    Minima of blocks of ``BLOCK`` values in a sparse table, and within blocks from
    both ends, so memory stays in proportion to the values.
    """

    def __init__(self, values: np.ndarray):
        n = -len(values) % BLOCK
        self.values = np.append(values, np.full(n, np.iinfo(values.dtype).max, values.dtype))
        blocks = self.values.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while len(last := self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from ``low`` to ``high``, both included."""
        least = np.minimum(self.behind[low], self.ahead[high])
        first, last = low // BLOCK, high // BLOCK
        inside = first == last
        if inside.any():
            at, to = low[inside], high[inside]
            found = self.values[at]
            for step in range(1, BLOCK):
                found = np.minimum(found, self.values[np.minimum(at + step, to)])
            least[inside] = found
        count = last - first - 1
        whole = count > 0
        levels = np.zeros(len(low), np.int64)
        levels[whole] = np.log2(count[whole]).astype(np.int64)
        for level in np.unique(levels[whole]):
            mine = np.flatnonzero(whole & (levels == level))
            table = self.levels[level]
            both = np.minimum(table[first[mine] + 1], table[last[mine] - (1 << level)])
            least[mine] = np.minimum(least[mine], both)
        return least


class SuffixTree:
    """The suffix tree of ``symbols`` (from 1 to ``most``), closed by symbol 0.

    ``children`` maps node * (most + 1) + symbol to the node below, nodes numbered
    from the root, 0; an edge is the symbols from ``first`` up to ``last`` of its
    lower node; ``suffix`` is where a leaf's suffix starts, -1 for inner nodes.
    """

    def __init__(self, symbols: list[int], most: int):
        self.text = [*symbols, 0]
        self.width = most + 1
        self._grow()

    def _grow(self) -> None:
        text, width = self.text, self.width
        n = len(text)
        first, last, link, suffix, children = [0], [0], [0], [-1], {}
        node = edge = along = pending = 0  # the active point and the suffixes not yet in the tree
        find = children.get
        for i, symbol in enumerate(text):
            waiting = 0  # an inner node made in this step that has no suffix link yet
            pending += 1
            while pending:
                if not along:
                    edge = i
                key = node * width + text[edge]
                below = find(key)
                if below is None:
                    children[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    suffix.append(i - pending + 1)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    start = first[below]
                    length = (last[below] if suffix[below] < 0 else i + 1) - start
                    if along >= length:
                        edge += length
                        along -= length
                        node = below
                        continue
                    if text[start + along] == symbol:
                        if waiting:
                            link[waiting] = node
                        along += 1
                        break
                    middle = len(first)
                    first += (start, i)
                    last += (start + along, n)
                    link += (0, 0)
                    suffix += (-1, i - pending + 1)
                    children[key] = middle
                    first[below] = start + along
                    children[middle * width + text[start + along]] = below
                    children[middle * width + symbol] = middle + 1
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                pending -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - pending + 1
        self.first, self.last, self.suffix, self.children = first, last, suffix, children

    def below(self) -> list[list[int]]:
        """The nodes below each node, by the symbols of their edges, the closing symbol first."""
        keys = np.fromiter(self.children, np.int64, len(self.children))
        nodes = np.fromiter(self.children.values(), np.int64, len(keys))
        order = np.argsort(keys)
        owners = keys[order] // self.width
        places = np.searchsorted(owners, np.arange(len(self.first) + 1)).tolist()
        nodes = nodes[order].tolist()
        return [nodes[a:b] for a, b in zip(places, places[1:])]

    def ranks(self, below: list[list[int]], downwards: bool = False) -> np.ndarray:
        """Each suffix's place among all, the closing symbol before all others in either order."""
        suffix, found, stack = self.suffix, [], [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                found.append(suffix[node])
                continue
            under = below[node]
            if not downwards:
                stack += under[::-1]
            elif self.text[self.first[under[0]]] == 0:
                stack += under[1:]
                stack.append(under[0])
            else:
                stack += under
        ranks = np.empty(len(found), np.int64)
        ranks[found] = np.arange(len(found))
        return ranks

    def tour(self, below: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Depths along an Euler tour, and where each suffix's leaf stands on it."""
        first, last, suffix = self.first, self.last, self.suffix
        depths, place, stack = [], [0] * len(self.text), [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:
                depths.append(depth)  # back at an inner node
            elif suffix[node] >= 0:
                place[suffix[node]] = len(depths)
                depths.append(depth)
            else:
                for under in below[node]:
                    stack.append((-1, depth))
                    stack.append((under, depth + last[under] - first[under]))
        return np.array(depths, np.int32), np.array(place, np.int64)


class Extensions:
    """How far the symbols from two positions on agree, for many pairs of positions at once."""

    def __init__(self, tree: SuffixTree, below: list[list[int]] | None = None):
        depths, self.place = tree.tour(tree.below() if below is None else below)
        self.minimum = RangeMinimum(depths)

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For positions that differ, up to and including the place after the last symbol."""
        a, b = self.place[one], self.place[other]
        return self.minimum.between(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)
