"""Benchmark decontamination with suffix arrays of the training texts.

Documents are taken in shards. Of a shard's words (as numbers of the benchmark's vocabulary; words outside it break the
text) a suffix array is built by prefix doubling, and all suffixes of all benchmark items are binary-searched in it at
once, suffixes of one window as one. That gives where each window (10 words, or an item of fewer) stands, confirmed on the
words themselves, and from there the longest verbatim matches. A place of a document meets one window of each length, so
what is found grows with the texts, not with places times suffixes. Documents are not shuffled. The benchmark is sent out in
blocks of about BLOCK_BYTES, one after the other: a task holds one of them and the driver two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, joined_bytes, slices, span_hashes, word_spans, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 6 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def prefix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the run of `depth` tokens from each place on; equal runs have equal ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have, n = 1, len(tokens)
    while have < depth:
        more = min(have, depth - have)
        later = np.zeros(n, np.int64)
        later[: n - more] = rank[more:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        have += more
    return rank


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The places of `starts` in the order of the token runs that begin there, compared over `depth` tokens; -1 ends a text."""
    return starts[np.argsort(prefix_ranks(tokens, depth)[starts], kind="stable")]


def _compare(tokens: np.ndarray, at: np.ndarray, test: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a training and a test suffix: sign of their order over `length` tokens, and their common prefix within it."""
    sign, common = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    live = np.flatnonzero(length > 0)
    k = 0
    while len(live):
        a = tokens[np.minimum(at[live] + k, len(tokens) - 1)]
        b = test[begin[live] + k]
        same = a == b
        sign[live[~same]] = np.where(a[~same] < b[~same], -1, 1)
        live = live[same]
        k += 1
        common[live] = k
        live = live[length[live] > k]
    return sign, common


class Searcher:
    """The benchmark's side: vocabulary, all suffixes, for each the length of its window (0: it has none), and the distinct windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, words in items if words]
        texts = [words for _, words in items if words]
        vocabulary = sorted({w for x in texts for w in x})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.words = texts
        self.test = np.array([number[w] for x in texts for w in x], np.int64)
        sizes = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.item = np.repeat(np.arange(len(texts)), sizes)
        self.left = np.repeat(self.first + sizes, sizes) - np.arange(len(self.test))  # words to the item's end
        whole = np.repeat(sizes, sizes)
        self.need = np.where(whole < window, np.where(self.left == whole, whole, 0), np.where(self.left >= window, window, 0))
        self.shortest = int(self.need[self.need > 0].min()) if len(self.test) else 0
        self.depth = int(self.need.max()) if len(self.test) else 0
        self._distinct(window)
        if vocabulary:
            data, ends = joined_bytes(vocabulary)
            hashes = span_hashes(data, ends[:-1], ends[1:] - 1)
            self.order = np.argsort(hashes)
            self.hashes = hashes[self.order]

    def _distinct(self, window: int) -> None:
        """The distinct windows: `reps`, a suffix of each, and for each the (item, its first suffix there) it stands in."""
        full = np.flatnonzero((self.need == window) & (self.left >= window))
        # no full window reaches over its item's end, so the items may stand side by side here
        rank = prefix_ranks(self.test, window)[full] if len(full) else full
        groups: dict[object, list[int]] = {}
        _, first, group = np.unique(rank, return_index=True, return_inverse=True)
        item = self.item[full]
        once = np.unique(group * (len(self.names) + 1) + item, return_index=True)[1]  # the first of an item in a group
        once = once[np.argsort(group[once], kind="stable")]
        self.reps = full[first]
        self.owners = full[once]
        self.until = np.cumsum(np.bincount(group[once], minlength=len(first)))
        for s in np.flatnonzero((self.need > 0) & (self.need < window)).tolist():
            groups.setdefault(tuple(self.test[s : s + self.need[s]].tolist()), []).append(s)
        short = list(groups.values())
        self.reps = np.concatenate([self.reps, np.array([x[0] for x in short], np.int64)]).astype(np.int64)
        self.owners = np.concatenate([self.owners, np.array([s for x in short for s in x], np.int64)]).astype(np.int64)
        self.until = np.concatenate([[0], self.until, (len(once) + np.cumsum([len(x) for x in short]))]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers of the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def matches(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the distinct window) of each occurrence of a window in the tokens; a -1 ends a text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.test) or not len(tokens):
            return none
        # runs of known words too short for any window can't hold one
        known = np.concatenate([[0], (tokens >= 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return none
        into = np.cumsum(size + 1) - size - 1
        back = np.repeat(begin - into, size + 1) + np.arange(int((size + 1).sum()))
        shard = np.where(np.arange(len(back)) == np.repeat(into + size, size + 1), -1, tokens[np.minimum(back, len(tokens) - 1)])
        places = suffix_array(shard, np.flatnonzero(shard >= 0), self.depth)
        suffix, need = self.reps, self.need[self.reps]
        bounds = []
        for above in (False, True):
            low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(places))
            while (open_ := low < high).any():
                rows = np.flatnonzero(open_)
                mid = (low[rows] + high[rows]) // 2
                sign, _ = _compare(shard, places[mid], self.test, suffix[rows], need[rows])
                right = sign < 0 if not above else sign <= 0
                low[rows[right]], high[rows[~right]] = mid[right] + 1, mid[~right]
            bounds.append(low)
        times = bounds[1] - bounds[0]
        which = np.repeat(np.arange(len(suffix)), times)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        return back[places[bounds[0][which] + inside]], which

    def words_from(self, suffix: int, n: int) -> list[bytes]:
        item = int(self.item[suffix])
        k = suffix - int(self.first[item])
        return self.words[item][k : k + n]

    def longest(self, tokens: np.ndarray, at: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """How many words each of these matches is long, up to the item's end."""
        return _compare(tokens, at, self.test, suffix, self.left[suffix])[1]


def _left_maximal(search: Searcher, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place, test suffix) of a text's hits (place, window): for each window and item the first of both, without those that follow another by one word in both."""
    first: dict[int, int] = {}
    for place, window in hits:
        first[window] = min(place, first.get(window, place))
    out = {(place, s) for window, place in first.items() for s in search.owners[search.until[window] : search.until[window + 1]].tolist()}
    return sorted((p, s) for p, s in out if (p - 1, s - 1) not in out or search.item[s - 1] != search.item[s])


def _found(search: Searcher, texts: list[str | None]) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], list[tuple[int, int, int]]]]]:
    """Words of each text, and by text with a confirmed window its runs of hit words (word, words) and matches (word, test suffix, words)."""
    raw = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    data, starts = joined_bytes(raw, b"\n")
    begin, end = word_spans(data, IS_WORD)
    cuts = np.searchsorted(begin, starts)
    sizes = np.diff(cuts)
    if not len(search.names) or not len(begin):
        return sizes, {}
    number = search.numbers(span_hashes(data, begin, end))
    owner = np.repeat(np.arange(len(texts)), sizes)
    tokens = np.full(len(begin) + len(texts), -1, np.int64)  # a break after each text
    tokens[np.arange(len(begin)) + owner] = number
    at, window = search.matches(tokens)
    text_starts = cuts[:-1] + np.arange(len(texts))
    of = np.searchsorted(text_starts, at, side="right") - 1
    hits: dict[int, list[tuple[int, int]]] = {}
    words: dict[int, list[bytes]] = {}
    for i, place, w in zip(of.tolist(), (at - text_starts[of]).tolist(), window.tolist(), strict=True):
        if i not in words:
            words[i] = WORD.findall(raw[i])
        s = int(search.reps[w])
        if words[i][place : place + int(search.need[s])] == search.words_from(s, int(search.need[s])):
            hits.setdefault(i, []).append((place, w))
    out = {}
    for i, found in hits.items():
        runs: list[list[int]] = []
        for place, n in sorted((place, int(search.need[search.reps[w]])) for place, w in found):
            if runs and place <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], place + n)
            else:
                runs.append([place, place + n])
        heads = _left_maximal(search, found)
        p, s = np.array([x[0] for x in heads], np.int64), np.array([x[1] for x in heads], np.int64)
        matched = search.longest(tokens, p + text_starts[i], s)
        out[i] = [(a, b - a) for a, b in runs], list(zip(p.tolist(), s.tolist(), matched.tolist(), strict=True))
    return sizes, out


_SPANS = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())]))
FOUND = "spans array<struct<word:long,n_words:long>>, matches array<struct<item_id:string,item_word:long,word:long,n_words:long>>"


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int, last: bool) -> DataFrame:
    """doc_id, text (unless last), n_words, spans, matches for one block of the benchmark, after those that docs brings along."""
    words = [(name, words_of(text)) for name, text in items]
    old = ["spans", "matches"] if "matches" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(words, window)
        for part in (x for batch in batches for x in slices(batch, most=SHARD_BYTES)):
            sizes, found = _found(search, part.column(1).to_pylist())
            spans, matches = (part.column(k).to_pylist() if old else [[] for _ in range(part.num_rows)] for k in (2, 3))
            for i, (runs, heads) in found.items():
                spans[i].extend({"word": place, "n_words": n} for place, n in runs)
                for place, s, m in heads:
                    item = int(search.item[s])
                    matches[i].append({"item_id": search.names[item], "item_word": s - int(search.first[item]), "word": place, "n_words": m})
            out = {"doc_id": part.column(0)} | ({} if last else {"text": part.column(1)}) | {"n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, _SPANS), "matches": pa.array(matches, _MATCHES)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    text = "" if last else "text string, "
    return docs.select(F.col("doc_id").cast("long"), "text", *old).transform(in_arrow, run, f"doc_id long, {text}n_words long, {FOUND}")


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """(item_id as text, text) in lists of about `most` bytes, one item at least; read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(row[1] or "") * 2
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def _one_by_one(benchmark: DataFrame, most: int) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """Each block and whether it is the last; one at least. Two blocks are held while the next is awaited."""
    now: list[tuple[str, str | None]] = []
    for block in blocks(benchmark, most):
        if now:
            yield now, False
        now = block
    yield now, True


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans, matches of each row of docs.

    spans (word, n_words): the document's runs of words inside an occurrence of a window, for each block of the benchmark.
    matches (item_id, item_word, word, n_words): longest verbatim matches, for each window and item from the first place in
    both, without those that only go on with another; each item with an occurring window has one. Words are runs of digits,
    letters and characters beyond ASCII, A-Z as lower case. Null texts and items have none, and items without words match
    nothing; items may repeat; null item_ids count as null. Repeated rows are each reported, null doc_ids too; an empty
    table of either kind is allowed. Other columns are ignored. Beyond one block, rows are written between the passes.
    """
    out = docs.select("doc_id", "text")
    for block, last in _one_by_one(benchmark, block_bytes):
        out = _pass(out, block, window, last)
        if not last:
            out = written(out, "decontaminate")
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in whose text no window of the benchmark occurs. Null texts stay.

    Rows are judged each for itself, also those of null or shared doc_id. A pass for each block, no shuffle; beyond one
    block, rows are written between the passes.
    """
    for block, last in _one_by_one(benchmark, block_bytes):
        words = [(name, words_of(text)) for name, text in block]

        def run(batches: Iterator[pa.RecordBatch], words: list = words) -> Iterator[pa.RecordBatch]:
            search = Searcher(words, window)
            for part in (x for batch in batches for x in slices(batch, most=SHARD_BYTES)):
                clean = np.ones(part.num_rows, bool)
                clean[list(_found(search, part.column(part.schema.get_field_index("text")).to_pylist())[1])] = False
                yield part.filter(pa.array(clean))

        docs = docs.transform(in_arrow, run, docs.schema)
        if not last:
            docs = written(docs, "decontaminate")
    return docs


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated of each row.

    Items of null item_id count as one item, whose name among the joined ones is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, counts, sums = [], [], []
            for spans, matches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                covered, at, end = 0, sorted((m["word"], m["n_words"]) for m in spans), 0
                for word, n in at:
                    covered += max(0, word + n - max(word, end))
                    end = max(end, word + n)
                names = sorted(x or "" for x in {m["item_id"] for m in matches})
                hits.append(covered)
                counts.append(len(names))
                sums.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    found = find_matches(docs, benchmark, window, block_bytes).select("doc_id", "n_words", "spans", "matches")
    out = found.transform(in_arrow, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
