"""Suffix sorting by induction, with disk-backed queues.

The sorted order of a text's suffixes is induced from that of its S* suffixes: one pass upward over the first symbols
gives those that are larger than their successor, one downward the others. Each pass has a priority queue of suffix
tuples; as tuples of one first symbol arrive in order, the queue is a row of first-in-first-out lists, and lists beyond a
budget go to disk. S* suffixes are named by sorting their S* substrings the same way; if names repeat, the shorter text of
names is sorted by recursion.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued tuples that are kept in memory, for a shard.
QUEUE_BYTES = 64 << 20
#: A text of names with more symbols than this is sorted by doubling its ranks instead of induction.
SYMBOLS = 1 << 12


class Queue:
    """Lists of positions by symbol, each in order of arrival; the oldest memory goes to a file when the budget is full."""

    def __init__(self, symbols: int, budget: int = QUEUE_BYTES):
        self.lists: list[list] = [[] for _ in range(symbols)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, symbol: int, places: np.ndarray) -> None:
        if self.held + places.nbytes > self.budget:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(places.tobytes())
            self.lists[symbol].append((at, len(places), places.dtype))
        else:
            self.held += places.nbytes
            self.lists[symbol].append(places)

    def push_sorted(self, symbols: np.ndarray, places: np.ndarray) -> None:
        """Each place to the list of its symbol, order kept."""
        if not len(places):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for symbol, part in zip(symbols[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
            self.push(symbol, part)

    def pop(self, symbol: int) -> np.ndarray | None:
        parts = []
        for x in self.lists[symbol]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                parts.append(np.frombuffer(self.file.read(x[1] * x[2].itemsize), x[2]))
            else:
                self.held -= x.nbytes
                parts.append(x)
        self.lists[symbol] = []
        return np.concatenate(parts) if parts else None

    def close(self) -> None:
        if self.file:
            self.file.close()


def place_type(n: int) -> type:
    """The narrowest type that counts n places: half the memory for texts of under 2 G symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True for S: smaller than the next suffix. The text ends with a least symbol of its own, so its last run is that symbol."""
    last = np.flatnonzero(text[:-1] != text[1:]).astype(place_type(len(text)))  # of each run of a symbol but the end's
    out = np.ones(len(text), bool)
    if len(last):
        out[: last[-1] + 1] = np.repeat(text[last] < text[last + 1], np.diff(last, prepend=last.dtype.type(-1)))
    return out


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, budget: int) -> np.ndarray:
    """All suffixes in order, from the S* suffixes (or what stands for them) in order."""
    symbols = int(text.max()) + 1
    # upward: L suffixes, before the S* of the same symbol
    ups, stars = Queue(symbols, budget), Queue(symbols, budget)
    stars.push_sorted(text[seeds], seeds)

    def up(places: np.ndarray, symbol: int) -> np.ndarray:
        """Queues the L suffixes before these and returns those of the same symbol."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        first = text[before]
        same = first == symbol
        ups.push_sorted(first[~same], before[~same])
        return before[same]

    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for symbol in range(symbols):
        found = ups.pop(symbol)
        while found is not None and len(found):
            large[symbol].append(found)
            found = up(found, symbol)
        star = stars.pop(symbol)
        if star is not None:
            up(star, symbol)
    ups.close()
    stars.close()
    # downward: S suffixes, each symbol's from its end
    downs = Queue(symbols, budget)

    def down(places: np.ndarray, symbol: int) -> np.ndarray:
        before = places[places > 0] - 1
        before = before[small[before]]
        first = text[before]
        same = first == symbol
        downs.push_sorted(first[~same], before[~same])
        return before[same]

    out, end = np.empty(len(text), seeds.dtype), len(text)  # filled from its end

    def put(places: np.ndarray) -> None:
        nonlocal end
        out[end - len(places) : end] = places[::-1]
        end -= len(places)

    for symbol in range(symbols - 1, -1, -1):
        found = downs.pop(symbol)
        while found is not None and len(found):
            put(found)
            found = down(found, symbol)
        while large[symbol]:
            found = large[symbol].pop()[::-1]
            put(found)
            down(found, symbol)
    downs.close()
    out[0] = len(text) - 1
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a short text of many symbols: ranks of 1, 2, 4, ... symbols."""
    rank, n, have = names.astype(np.int64), len(names), 1
    while True:
        later = np.zeros(n, np.int64)
        if have < n:
            later[: n - have] = rank[have:] + 1
        key = rank * (n + 2) + later
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = fresh
        if fresh[-1] == n - 1 or have >= n:
            return order
        have *= 2


def suffix_order(text: np.ndarray, budget: int = QUEUE_BYTES) -> np.ndarray:
    """The suffixes of a text in order; its last symbol is less than all others and stands there alone."""
    n, kind = len(text), place_type(len(text))
    if n < 3:
        return np.arange(n, dtype=kind)[::-1]
    small = _types(text)
    star = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    if len(star) < 2:
        return _induce(text, small, star, budget)
    # S* substrings in order: induced from S* suffixes that are sorted by their first symbol only
    rough = _induce(text, small, star, budget)
    is_star = np.zeros(n, bool)
    is_star[star] = True
    rough = rough[is_star[rough]]
    which = np.searchsorted(star, rough).astype(kind)
    size = np.append(np.diff(star) + 1, 1).astype(kind)[which]
    same = size[:-1] == size[1:]
    live, k = np.flatnonzero(same).astype(kind), 0
    while len(live):
        equal = text[np.minimum(rough[live] + k, n - 1)] == text[np.minimum(rough[live + 1] + k, n - 1)]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
        live = live[size[live] > k]
    del rough, size, live
    names = np.empty(len(star), kind)
    names[which] = np.append(0, np.cumsum(~same, dtype=kind))
    del which, same
    if names.max() + 1 == len(star):
        order = np.empty(len(star), kind)
        order[names] = np.arange(len(star), dtype=kind)
    elif names.max() < SYMBOLS:
        order = suffix_order(names, budget)
    else:
        order = _doubled(names)
    del names
    return _induce(text, small, star[order], budget)
