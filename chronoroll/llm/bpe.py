"""Agendas of adjacent symbol pairs, for one word (a heap) and for blocks of words.

Both repeat one step: of all adjacent pairs that have an entry in the table,
take the one of the least rank, the leftmost among equals, and put the merged
symbol in its place. A block holds words of like length as rows of a matrix; all
of its rows take their step together, so numpy does the work of one agenda per row.
"""

from __future__ import annotations

import heapq

import numpy as np

#: No merge is known for a pair.
NEVER = np.int64(1 << 40)
SHIFT = 22


class PairTable:
    """Sorted keys of (left, right) pairs with the rank and result of their merge."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        keys = np.fromiter(((a << SHIFT) | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        rank = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))
        into = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))
        self.rank, self.into = np.append(rank[order], NEVER), np.append(into[order], 0)
        self.pairs = pairs

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << SHIFT) | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), self.into[at]

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap over a linked list; for words of any length."""
        n = len(symbols)
        sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (hit := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(agenda, (hit[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j], nxt[i] = self.pairs[a, b][1], -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(prv[i], i)
            offer(i, nxt[i])
        return [s for s in sym if s >= 0]

    def merge_block(self, sym: np.ndarray, out: np.ndarray) -> None:
        """Rows of symbols, padded on the right with -1; ``out`` gets the merged rows."""
        rows = np.arange(len(sym))
        rank, into = self.find(sym[:, :-1], sym[:, 1:])
        while len(rows):
            if sym.shape[1] == 1:
                out[rows, :1] = sym
                return
            at = rank.argmin(1)
            live = rank[np.arange(len(rows)), at] < NEVER
            if not live.all():
                done = ~live
                out[rows[done], : sym.shape[1]] = sym[done]
                rows, sym, rank, into, at = rows[live], sym[live], rank[live], into[live], at[live]
                if not len(rows):
                    return
            r, col = np.arange(len(rows)), at[:, None]
            merged = into[r, at]
            wide = np.arange(sym.shape[1] - 1)
            sym = np.take_along_axis(sym, wide + (wide > col), 1)
            sym[r, at] = merged
            wide = np.arange(rank.shape[1] - 1)
            keep = wide + (wide >= col)
            rank, into = np.take_along_axis(rank, keep, 1), np.take_along_axis(into, keep, 1)
            for shift in (-1, 0):
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p < rank.shape[1]))
                if len(ok):
                    rank[ok, p[ok]], into[ok, p[ok]] = self.find(sym[ok, p[ok]], sym[ok, p[ok] + 1])

    def merge_all(self, flat: np.ndarray, sizes: np.ndarray, longest: int = 48, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Words given as one array of symbols and their sizes; the same of the merged words."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        out, new = np.full(len(flat), -1, np.int32), np.zeros(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= longest]
        for i in range(0, len(short), block):
            part = short[i : i + block]
            grid = np.arange(sizes[part[-1]])
            places = starts[part][:, None] + grid
            inside = grid < sizes[part][:, None]
            sym = np.where(inside, flat[np.minimum(places, len(flat) - 1)], -1).astype(np.int64)
            merged = np.full(sym.shape, -1, np.int64)
            self.merge_block(sym, merged)
            out[places[inside]] = merged[inside]
            new[part] = (merged >= 0).sum(1)
        for k in order[len(short) :]:
            one = self.merge_one(flat[starts[k] : ends[k]].tolist())
            out[starts[k] : starts[k] + len(one)], new[k] = one, len(one)
        return out[out >= 0], new


class Recent:
    """A cache of two generations: what the younger hasn't seen again goes with the elder."""

    def __init__(self, most: int) -> None:
        self.half, self.young, self.old = most // 2, {}, {}

    def missing(self, keys: set) -> list:
        """The keys to be learned; the others are in ``young`` from now on."""
        young, old = self.young, self.old
        absent = [k for k in keys if k not in young]
        if len(young) + len(absent) > self.half:
            old = young | {k: v for k in absent if (v := old.get(k)) is not None}
            self.old, self.young = old, (young := {})
            absent = list(keys)
        new = []
        for k in absent:
            if (v := old.get(k)) is None:
                new.append(k)
            else:
                young[k] = v
        return new
