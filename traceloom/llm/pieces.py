"""Texts cut into the pieces that a byte-level tokenizer encodes one by one, and a table of pieces met before."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from .common import SLICE_BYTES, span_keys

#: Pieces that a worker holds at most: 28 bytes each and 4 for each of its ids.
HELD_PIECES = 1 << 20
#: What a code point is to the pattern.
OTHER, LETTER, NUMBER, BLANK = range(4)
#: The endings that the pattern takes together with an apostrophe, in its order.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A printable ASCII character and a space: a piece begins at the space, whatever stands around.
_SAFE = re.compile(rb"[!-~] ")


def _by_tiktoken(pattern: str, text: str) -> str:
    """The characters of text that match, as the library's engine and its Unicode tables have it."""
    from tiktoken import Encoding

    single = Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(single.encode_ordinary(text)).decode()


def _by_tokenizers(pattern: str, text: str) -> str:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return "".join(x for x, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text))


@cache
def kinds(library: str) -> np.ndarray:
    """The kind of each code point: letter, number, white space or other; each library has Unicode tables of its own."""
    find = {"tiktoken": _by_tiktoken, "tokenizers": _by_tokenizers}[library]
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        out[np.frombuffer(find(pattern, every).encode("utf-32-le"), "<u4")] = kind
    return out


def parts(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in parts that can be cut into pieces alone: of about `most` bytes, or longer where no safe place comes."""
    start = 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + most - 1)
        if not found:
            break
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte where each begins (and the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return points, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def pattern_starts(points: np.ndarray, begins: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which code points begin a match of the pattern; begins: where each text begins (places in points,
    ascending); kinds: of each code point.

    A match is a run of one kind, with a single space before it; a blank run before something else gives its last
    character up; an ending after a lone apostrophe goes with it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = kinds[points]
    first = np.zeros(n + 1, bool)
    first[begins[begins < n]] = True
    first[n] = True
    blank = kind == BLANK
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of a blank run, where something of the same text follows it
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:-1])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    mark = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:-1])
    for ending in ENDINGS:
        size, at = len(ending), mark[mark + len(ending) < n]
        same = np.ones(len(at), bool)
        for k, letter in enumerate(ending, 1):
            same &= (points[at + k] == ord(letter)) & ~first[at + k]
        at = at[same]
        start[at + 1] = False
        after = at + 1 + size
        after = after[after < n]
        start[after] = True
    return start


class PieceTable:
    """The ids of pieces met before, found by two 64-bit hashes of their bytes; encodes each new piece once.

    encode_new: from a list of pieces (bytes) to all their ids, one after the other, and how many each has. The table
    starts afresh when it is full; pieces that share their first hash with another are encoded each time.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = HELD_PIECES):
        self.encode_new, self.most = encode_new, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((2, 0), np.uint64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not self.keys.shape[1]:
            return np.full(keys.shape[1], -1)
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), self.keys.shape[1] - 1)
        return np.where((self.keys[:, at] == keys).all(axis=0), at, -1)

    def _hold(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds pieces whose first hashes differ from each other and from those held; keys are in ascending order."""
        at = np.searchsorted(self.keys[0], keys[0])
        first = len(self.ids) + np.cumsum(counts) - counts
        self.keys = np.insert(self.keys, at, keys, axis=1)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, counts)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces data[s:e], one after the other, and how many each has."""
        keys = span_keys(data, starts, ends)
        _, one, back = np.unique(keys[0], return_index=True, return_inverse=True)
        own = keys[:, one]
        alike = keys[1] == own[1, back]  # false for another piece of the same first hash
        entry = self._find(own)
        new = np.flatnonzero(entry < 0)
        if self.keys.shape[1] + len(new) > self.most:
            self._clear()
            entry[:] = -1
            new = np.arange(len(one))
        cut = lambda which: [data[a:b].tobytes() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        more, counts = self.encode_new(cut(one[new])) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        held = len(self.ids)
        first, count = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        known = entry >= 0
        first[known], count[known] = self.first[entry[known]], self.count[entry[known]]
        first[new], count[new] = held + np.cumsum(counts) - counts, counts
        ids = np.concatenate([self.ids, more.astype(np.int32)])
        first, count = first[back], count[back]
        odd = np.flatnonzero(~alike)
        if len(odd):
            extra, n = self.encode_new(cut(odd))
            first[odd], count[odd] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, extra.astype(np.int32)])
        if len(new) and len(new) <= self.most:
            taken = np.isin(own[0, new], self.keys[0], assume_unique=True) if self.keys.shape[1] else np.zeros(len(new), bool)
            self._hold(own[:, new[~taken]], more[np.repeat(~taken, counts)], counts[~taken])
        until = np.cumsum(count)
        return ids[np.repeat(first - until + count, count) + np.arange(until[-1] if len(until) else 0)], count
