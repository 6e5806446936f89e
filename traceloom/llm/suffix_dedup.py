"""Suffix-array dedup: removes each byte covered by a string of LENGTH bytes that also starts in a document of smaller id.

A string belongs to the first of its GRAM-byte runs with the least hash, and to the bytes beside that run, on the side where
the string has more of them: half of what a string has besides a run. The hash of both is its key, so equal strings meet
wherever their key, or the run's part of it, is dealt, and runs that many documents share amid differing text prove single.
A stretch of starts with one key is a piece. A text that a smaller document has too goes whole and takes no part. First only the
hashes travel, in blocks of a slice of documents and a range of hashes, and those that another document has return in such
blocks to their slice: a piece goes on if its hash does, together with its neighbour of the same run. Pieces of a run's hash
are in one shard, whose suffixes are
sorted by external induction (see induced); neighbours in that order with a common prefix of LENGTH bytes, compared byte for
byte, are one string, and its least document is known. Equal pieces (by 64 bits and their length) within one slice of
documents are sent once, from the least document: a passage that a third of all documents share costs a shard one piece a
slice. Pieces of a hash with more than HOT_BYTES of them, such as those of a common passage amid differing text, don't go to
a shard: they are taken apart into their strings, which are grouped themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOW, SLICE_BYTES, eight_bytes, in_arrow, mix64, slices, span_hashes, written
from .induced import place_type, suffix_order

#: A gram is two numbers of eight bytes.
LENGTH, GRAM = 50, 16
_GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Starts whose least hashes are found in one step.
CHUNK = 1 << 16
#: Bytes of text for each range of hashes, and for each shard of pieces.
RANGE_BYTES, SHARD_BYTES = 48 << 20, 3 << 20
#: A hash whose pieces have more bytes in all is split into strings, so that it can't overfill its shard.
HOT_BYTES = 1 << 19
#: Bits of a hash that travel, and those of them that are of the bytes beside the run: more only spare pieces that prove single.
HASH_BITS, BESIDE_BITS = 56, 24
#: A run whose pieces, but for those of hashes split already, have more than this many times HOT_BYTES is split too.
HOT_RUN = 4
#: Places in a step.
_PLACE = np.uint64((2 * CHUNK) - 1)


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(sizes))


def pieces(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first start, number of starts, document of each piece: stretches of starts with one hash, within a document."""
    wide = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    eight, m = eight_bytes(data), len(data) - length + 1
    least = np.empty(m, np.uint64)
    for low in range(0, m, CHUNK):  # small steps, so that what a step needs stays in the processor's caches
        n = min(CHUNK, m - low) + wide - 1
        part = mix64(mix64(eight[low : low + n] * _GRAM_FACTOR) ^ eight[low + 8 : low + 8 + n])
        part &= ~_PLACE
        part |= np.arange(n, dtype=np.uint64)  # of equal hashes the first
        have = 1
        while have < wide:
            more = min(have, wide - have)
            part = np.minimum(part[:-more], part[more:])
            have += more
        least[low : low + CHUNK] = part
    # starts whose string ends within their document
    sizes = np.diff(starts)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    if not len(owner):
        return none.astype(np.uint64), none, none, none
    at = np.arange(len(owner)) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    value = least[at]
    edge = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    value, at, count, owner = value[edge], at[edge], np.diff(np.append(edge, len(at))), owner[edge]
    # strings that have more before the run, then those that have more after it
    run, side = at // CHUNK * CHUNK + (value & _PLACE).astype(np.int64), (length - GRAM) // 2
    before = np.clip(run - (length - GRAM - side) - at, 0, count)
    both = np.stack([before, count - before], 1).ravel()
    some = np.flatnonzero(both)
    after, of = some & 1, some >> 1
    at, count, owner = at[of] + after * before[of], both[some], owner[of]
    beside = run[of] + np.where(after == 1, GRAM, -side)
    key = after.astype(np.uint64)
    for k in [*range(0, side - 8, 8), side - 8] if side >= 8 else [0]:
        key = mix64((key * _GRAM_FACTOR) ^ (eight[beside + k] & _LOW[min(side, 8)]))
    key = (value[of] >> np.uint64(64 + BESIDE_BITS - HASH_BITS) << np.uint64(BESIDE_BITS)) | (key >> np.uint64(64 - BESIDE_BITS))
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
    return key[edge], at[edge], np.add.reduceat(count, edge), owner[edge]


def _narrow(keys: np.ndarray) -> bytes:
    """HASH_BITS of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes()


def _wide(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : HASH_BITS // 8] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _hashes(docs: DataFrame, ranges: int, length: int) -> DataFrame:
    """Of each slice of documents and range of hashes: marks of the documents that have some, and blobs of how many each has, of the keys, document by document, and of weights, the binary log of the bytes of a key's pieces, 7 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # of docs (mark, text, ..)
        lower = _bounds(ranges)
        for number, part in enumerate(x for batch in batches for x in slices(batch)):
            data, starts = _joined(part.column(1).to_pylist())
            key, _, count, owner = pieces(data, starts, length)
            if not len(key):
                continue
            order = np.lexsort((key, owner))
            key, owner, size = key[order], owner[order], count[order] + length - 1
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            weight = np.ceil(np.log2(np.maximum(np.add.reduceat(size, np.flatnonzero(first)), 128))).astype(np.uint8)
            key, owner = key[first], owner[first]
            dealt = np.searchsorted(lower, key, side="right") - 1
            order = np.argsort(dealt, kind="stable")
            key, owner, weight, dealt = key[order], owner[order], weight[order], dealt[order]
            cuts = np.flatnonzero(np.append(True, np.diff(dealt) != 0))
            head = np.flatnonzero(np.append(True, (np.diff(dealt) != 0) | (np.diff(owner) != 0)))
            times, at = np.diff(np.append(head, len(key))).astype("<u4"), np.append(np.searchsorted(head, cuts), len(head))
            rows, own = list(zip(cuts, np.append(cuts[1:], len(key)), strict=True)), list(zip(at[:-1], at[1:], strict=True))
            here = (TaskContext.get().partitionId() << 32) + number
            yield pa.RecordBatch.from_arrays([
                pa.array(dealt[cuts], pa.int32()), pa.array([here] * len(rows), pa.int64()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), part.column(0).take(pa.array(owner[head]))), pa.array([_planes(times[a:b]) for a, b in own], pa.binary()),
                pa.array([_narrow(key[a:b]) for a, b in rows], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in rows], pa.binary()),
            ], ["range", "slice", "marks", "counts", "keys", "weights"])

    return docs.transform(in_arrow, run, "range int, slice long, marks array<long>, counts binary, keys binary, weights binary")


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones: the upper ones of small numbers are zeros that compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _bounds(ranges: int) -> np.ndarray:
    """Lower ends of equal ranges of a least hash: least of `wide` uniform ones, so the ranges are equal in its distribution."""
    wide = LENGTH - GRAM + 1
    share = np.arange(ranges) / ranges
    return ((1 - (1 - share) ** (1 / wide)) * float(1 << HASH_BITS)).astype(np.uint64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of the first column, which comes sorted."""
    now, rows = None, []
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, batch.num_columns)), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def _shared(hashes: DataFrame) -> DataFrame:
    """(slice, marks, counts, keys, hot): of hashes those that another document has too, a row at most for each row; hot has a bit for each key, set if its pieces have over HOT_BYTES or the others of its run over HOT_RUN times as many."""
    most = HOT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            keys = [_wide(k.as_buffer()) for *_, k, _ in rows]
            every = np.concatenate(keys)
            weight = np.concatenate([np.frombuffer(w.as_buffer(), np.uint8) for *_, w in rows])
            order = np.argsort(every)
            every, weight = every[order], weight[order]
            edge = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            several = np.diff(np.append(edge, len(every))) > 1
            shared, size = every[edge][several], np.add.reduceat(np.exp2(weight, dtype=np.float64), edge)[several]
            large, runs = size > most, np.flatnonzero(np.append(True, np.diff(shared >> np.uint64(BESIDE_BITS)) != 0)[: len(shared)])
            if len(shared):
                rest = np.add.reduceat(np.where(large, 0, size), runs)
                large |= np.repeat(rest > HOT_RUN * most, np.diff(np.append(runs, len(shared))))
            for (number, marks, counts, *_), key in zip(rows, keys, strict=True):
                if not len(shared):
                    break
                place = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
                hit = shared[place] == key
                if not hit.any():
                    continue
                until = np.cumsum(_from_planes(counts.as_buffer(), "<u4"), dtype=np.int64)
                times = np.add.reduceat(hit, np.append(0, until[:-1]), dtype=np.int64)  # each document has a key at least
                own = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), marks.values.take(pa.array(own))),
                    *(pa.array([x], pa.binary()) for x in (_planes(times[own].astype("<u4")), _narrow(key[hit]), np.packbits(large[place[hit]]).tobytes())),
                ], ["slice", "marks", "counts", "keys", "hot"])

    dealt = hashes.repartition("range").sortWithinPartitions("range")
    return dealt.transform(in_arrow, run, "slice long, marks array<long>, counts binary, keys binary, hot binary")


def _lists(shared: DataFrame) -> DataFrame:
    """(mark, keys, hot): a row for each mark of a slice, of all ranges; hot are the hashes whose pieces are split, keys the others, null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            mark, times = np.concatenate([m.values.to_numpy() for m, *_ in rows]), np.concatenate([_from_planes(c.as_buffer(), "<u4") for _, c, *_ in rows])
            keys = [_wide(k.as_buffer()) for *_, k, _ in rows]
            large = np.concatenate([np.unpackbits(np.frombuffer(h.as_buffer(), np.uint8), count=len(k)) for (*_, h), k in zip(rows, keys, strict=True)])
            mark = np.repeat(mark, times)
            order = np.lexsort((large, mark))
            mark, large, raw, width = mark[order], large[order], _narrow(np.concatenate(keys)[order]), HASH_BITS // 8
            head = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
            until = np.append(head[1:], len(mark))
            middle = until - np.add.reduceat(large, head, dtype=np.int64)
            lists = ([raw[a * width : b * width] or None for a, b in zip(x.tolist(), y.tolist(), strict=True)] for x, y in ((head, middle), (middle, until)))
            yield pa.RecordBatch.from_arrays([pa.array(mark[head]), *(pa.array(x, pa.binary()) for x in lists)], ["mark", "keys", "hot"])

    dealt = shared.repartition("slice").sortWithinPartitions("slice")
    return dealt.transform(in_arrow, run, "mark long, keys binary, hot binary")


def _copies(base: DataFrame) -> DataFrame:
    """(mark, copies): the documents of a mark whose text, known by 128 bits and its length, is also the text of a smaller one."""
    light = base.select("doc", "mark", F.xxhash64(F.lit(3), "text").alias("t1"), F.xxhash64(F.lit(4), "text").alias("t2"), F.octet_length("text").alias("n"))
    several = light.groupBy("t1", "t2", "n").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("last > least")
    return light.join(several, ["t1", "t2", "n"]).where("doc > least").groupBy("mark").agg(F.collect_set("doc").alias("copies"))


def _among(key: np.ndarray, owner: np.ndarray, lists: list[list[bytes]]) -> np.ndarray:
    """Whether each piece's hash is in its document's list."""
    keep = np.zeros(len(key), bool)
    cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
    for i, blobs in enumerate(lists):
        a, b = cuts[i], cuts[i + 1]
        if b > a and blobs:
            keep[a:b] = np.isin(key[a:b], _wide(b"".join(blobs)))
    return keep


def _hot_out(docs: DataFrame, ranges: int, length: int) -> DataFrame:
    """(doc, mark, start, n): stretches of starts of hot hashes whose strings are to go.

    Of equal strings in a slice the least document's goes on, once, the others are found already. So a string comes once
    a slice to where it meets its equals: in one of `ranges` blocks of each slice, by its hash. Those that are to go return
    in blocks to their slice, where neighbouring starts become stretches again; no row is made for a single string.
    """
    names = ["part", "slice", "strings", "docs", "marks", "times", "starts", "counts"]

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(x for batch in batches for x in slices(batch, most=2 * SLICE_BYTES)):
            data, starts = _joined(part.column(2).to_pylist())
            key, at, count, owner = pieces(data, starts, length)
            if not len(key):
                continue
            keep = _among(key, owner, part.column(4).to_pylist())
            at, count, owner = at[keep], count[keep], owner[keep]
            if not len(at):
                continue
            ids, marks = (np.array(part.column(i).to_pylist(), np.int64) for i in range(2))
            owner, at = np.repeat(owner, count), np.repeat(at, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            whole = span_hashes(data, at, at + length)
            order = np.lexsort((at, owner, ids[owner], whole))
            at, owner, whole = at[order], owner[order], whole[order]
            doc, begin = ids[owner], starts[owner]
            head = np.append(True, whole[1:] != whole[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            other = np.zeros(len(at), bool)  # an unequal string of equal hash
            for low in range(0, len(at), 1 << 16):  # byte for byte
                some = slice(low, low + (1 << 16))
                strings = np.lib.stride_tricks.sliding_window_view(data, length)
                other[some] = (strings[at[some]] != strings[at[lead[some]]]).any(axis=1)
            sent = other | (doc == doc[lead])
            go, rest = np.flatnonzero(sent), np.flatnonzero(~sent)
            go = go[np.argsort(whole[go] % np.uint64(ranges), kind="stable")]
            edge = np.flatnonzero(np.append(True, (whole[go][1:] != whole[go][:-1]) | (owner[go][1:] != owner[go][:-1]) | other[go][1:] | other[go][:-1])) if len(go) else go
            first, times = go[edge], np.diff(np.append(edge, len(go)))
            own, begins = (whole[first] % np.uint64(ranges)).astype(np.int64), at[go] - begin[go]
            cuts = np.flatnonzero(np.diff(own)) + 1
            every, rows = np.lib.stride_tricks.sliding_window_view(data, length), []
            here = (TaskContext.get().partitionId() << 32) + number
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(first)), strict=True) if len(first) else ():
                x, y = edge[a], edge[b] if b < len(edge) else len(go)
                rows.append((int(own[a]), here, every[at[first[a:b]]].tobytes(), _planes(doc[first[a:b]]), _planes(marks[owner[first[a:b]]]), _planes(times[a:b].astype(np.int32)), _planes(begins[x:y].astype(np.int32)), None))
            if len(rest):
                rest = rest[np.argsort(at[rest])]
                lone = np.flatnonzero(np.append(True, (np.diff(at[rest]) != 1) | (np.diff(owner[rest]) != 0)))
                spans, n = rest[lone], np.diff(np.append(lone, len(rest)))
                rows.append((number % ranges, here, None, _planes(doc[spans]), _planes(marks[owner[spans]]), None, _planes((at[spans] - begin[spans]).astype(np.int32)), _planes(n.astype(np.int32))))
            yield _blocks(rows, names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _grouped(batches):
            sent, out = [r for r in rows if r[1].is_valid], []
            for r in rows:
                if not r[1].is_valid:
                    out.append((at, r[0].as_py(), None, *(r[i].as_py() for i in (2, 3)), None, *(r[i].as_py() for i in (5, 6))))
            if sent:
                docs_, marks, times, starts = (np.concatenate([_from_planes(r[i].as_buffer(), kind) for r in sent]) for i, kind in ((2, "<i8"), (3, "<i8"), (4, "<i4"), (5, "<i4")))
                raw = np.concatenate([np.frombuffer(r[1].as_buffer(), np.uint8) for r in sent]).reshape(-1, length)
                words = np.zeros((len(raw), -(-length // 8) * 8), np.uint8)
                words[:, :length] = raw
                words = words.view(np.uint64)
                order = np.lexsort((docs_, *words.T))
                head = np.append(True, (words[order[1:]] != words[order[:-1]]).any(axis=1))
                again = np.zeros(len(order), bool)
                again[order] = docs_[order] > docs_[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
                of = np.repeat(np.arange(len(sent)), [len(r[1].as_buffer()) // length for r in sent])
                hit, until = np.repeat(again, times), np.cumsum(times)
                for k, r in enumerate(sent):
                    a, b = np.searchsorted(of, (k, k + 1))
                    if again[a:b].any():
                        each, x, y = np.repeat(np.arange(a, b), times[a:b]), until[a] - times[a], until[b - 1]
                        each, some = each[hit[x:y]], starts[x:y][hit[x:y]]
                        out.append((at, r[0].as_py(), None, _planes(docs_[each]), _planes(marks[each]), None, _planes(some), _planes(np.ones(len(some), np.int32))))
            if out:
                yield _blocks(out, names)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            doc, mark, start, n = (np.concatenate([_from_planes(r[i].as_buffer(), kind) for r in rows]).astype(np.int64) for i, kind in ((0, "<i8"), (1, "<i8"), (2, "<i4"), (3, "<i4")))
            order = np.lexsort((start, mark, doc))
            doc, mark, start, n = doc[order], mark[order], start[order], n[order]
            first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(mark) != 0) | (start[1:] != start[:-1] + n[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], mark[first], start[first], np.add.reduceat(n, first))], ["doc", "mark", "start", "n"])

    blocks = "part int, slice long, strings binary, docs binary, marks binary, times binary, starts binary, counts binary"
    met = docs.transform(in_arrow, strings, blocks).repartition("part").sortWithinPartitions("part").transform(in_arrow, meet, blocks)
    back = met.select("slice", "docs", "marks", "starts", "counts").repartition("slice").sortWithinPartitions("slice")
    return back.transform(in_arrow, stretches, "doc long, mark long, start long, n long")


def _blocks(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


FOUND = "shard int, docs binary, marks binary, starts binary, counts binary, data binary"


def _pieces_to_sort(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """Pieces with shared hashes by shard; of equal ones in a slice the least document's goes on, the others are found already (data null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, most=2 * SLICE_BYTES)):
            data, starts = _joined(part.column(2).to_pylist())
            key, at, count, owner = pieces(data, starts, length)
            if not len(key):
                continue
            keep = _among(key, owner, part.column(3).to_pylist())
            key, at, count, owner = key[keep] >> np.uint64(BESIDE_BITS), at[keep], count[keep], owner[keep]
            if not len(key):
                continue
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + count[:-1])))
            key, at, count, owner = key[edge], at[edge], np.add.reduceat(count, edge), owner[edge]
            ids = np.array(part.column(0).to_pylist(), np.int64)
            marks = np.array(part.column(1).to_pylist(), np.int64)
            whole = span_hashes(data, at, at + count + length - 1)
            shard = (mix64(key) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((ids[owner], whole, shard))
            key, at, count, owner, whole, shard = (x[order] for x in (key, at, count, owner, whole, shard))
            head = np.concatenate([[True], (whole[1:] != whole[:-1]) | (shard[1:] != shard[:-1])])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]  # the least document's piece of each group of equal ones
            doc = ids[owner]
            sent = head | (doc == doc[lead])
            begin = starts[owner]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = []
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(shard)), strict=True):
                go, rest = np.flatnonzero(sent[a:b]) + a, np.flatnonzero(~sent[a:b]) + a
                for some, body in ((go, True), (rest, False)):
                    if len(some):
                        text = b"".join(data[x : x + n + length - 1].tobytes() for x, n in zip(at[some].tolist(), count[some].tolist(), strict=True)) if body else None
                        rows.append((int(shard[a]), _planes(doc[some]), marks[owner[some]].tobytes(), _planes((at[some] - begin[some]).astype(np.int32)), _planes(count[some].astype(np.int32)), text))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], ["shard", "docs", "marks", "starts", "counts", "data"])

    return docs.transform(in_arrow, run, FOUND)


def repeated(docs: np.ndarray, counts: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For each start of each piece, whether its string is in a piece of a smaller document. data is the pieces' bytes."""
    ends = np.cumsum(counts + length)  # each piece, and a space of its own after it; a least symbol at the end
    if not len(ends):
        return np.zeros(0, bool)
    n = int(ends[-1]) + 1
    kind = place_type(n)
    inside, raw = np.ones(n, bool), np.zeros(n + length, np.uint8)
    inside[ends - 1] = inside[-1] = False
    raw[:n][inside] = data
    text = raw[:n].astype(np.uint16)
    text[inside] += 2
    text[ends - 1] = 1
    order = suffix_order(text)
    del text, inside
    # starts of whole strings; the number of each, and its document's rank
    edges = np.zeros(n + 1, np.int8)
    edges[ends - counts - length] = 1
    edges[ends - length] = -1
    whole = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    del edges
    order = order[whole[order]]  # those with a whole string, still in order
    number = np.cumsum(whole, dtype=kind) - kind(1)
    del whole
    same, packed = np.ones(max(0, len(order) - 1), bool), eight_bytes(raw)
    for low in range(0, len(same), CHUNK):  # byte for byte, in small steps
        step = same[low : low + CHUNK]
        live = np.arange(len(step))
        for k in [*range(0, length - 8, 8), length - 8]:
            equal = packed[order[low + live] + k] == packed[order[low + live + 1] + k]
            step[live[~equal]] = False
            live = live[equal]
    del packed, raw
    order = number[order]
    del number
    owner = np.repeat(np.unique(docs, return_inverse=True)[1].astype(np.int32), counts)[order]
    edge = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(owner, edge)
    out = np.zeros(len(order), bool)
    out[order] = owner > np.repeat(least, np.diff(np.append(edge, len(order))))
    return out


def _sorted_out(found: DataFrame, length: int) -> DataFrame:
    """(doc, mark, start, n): stretches of starts whose strings are to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "mark", "start", "n"]
        kinds = [lambda x, t=t: _from_planes(x, t) for t in ("<i8", "<i4", "<i4")]
        kinds.insert(1, lambda x: np.frombuffer(x, np.int64))

        def spans(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names)

        for _, rows in _grouped(batches):
            sent = [r for r in rows if r[4].is_valid]
            for row in rows:
                if not row[4].is_valid:
                    yield spans(*(read(x.as_buffer()) for x, read in zip(row, kinds, strict=False)))
            if not sent:
                continue
            docs, marks, starts, counts = (np.concatenate([kinds[i](r[i].as_buffer()) for r in sent]) for i in range(4))
            counts = counts.astype(np.int64)
            data = np.concatenate([np.frombuffer(r[4].as_buffer(), np.uint8) for r in sent])
            if len(np.unique(docs)) < 2:
                continue
            # equal pieces of several slices: only the least document's is sorted
            ends = np.cumsum(counts + length - 1)
            begin = ends - counts - length + 1
            whole = span_hashes(data, begin, ends)
            order = np.lexsort((docs, whole))
            head = np.append(True, np.diff(whole[order]) != 0)
            first = docs[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
            again = np.zeros(len(docs), bool)
            again[order] = docs[order] > first
            yield spans(docs[again], marks[again], starts[again], counts[again])
            data = data[np.repeat(~again, counts + length - 1)]
            docs, marks, starts, counts = docs[~again], marks[~again], starts[~again], counts[~again]
            rows.clear()  # held by _grouped too
            del sent, again, order, whole, head, first, ends, begin
            hit = np.flatnonzero(repeated(docs, counts, data, length))
            if len(hit):
                until = np.cumsum(counts)
                piece = np.searchsorted(until, hit, side="right")
                edge = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(piece) != 0)))
                piece, first = piece[edge], hit[edge]
                yield spans(docs[piece], marks[piece], starts[piece] + first - (until - counts)[piece], np.diff(np.append(edge, len(hit))))

    dealt = found.repartition("shard").sortWithinPartitions("shard")
    return dealt.transform(in_arrow, run, "doc long, mark long, start long, n long")


def deduplicated(docs: DataFrame, length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, kept (binary) of each row of docs, as UTF-8 bytes (null: empty).

    Rows of equal doc_id don't count as smaller than each other; null doc_ids count as greater than all. Texts under
    `length` bytes stay whole. An empty table gives no rows. Other columns are ignored. `length` is GRAM + 8 at least.
    """
    largest = (1 << 63) - 1
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(largest))
    base = docs.select(doc.alias("doc"), F.xxhash64(doc, "text").alias("mark"), F.col("doc_id").isNull().alias("nameless"), "text")
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges, shards = max(parallel, -(-bytes_ // RANGE_BYTES)), max(2 * parallel, -(-bytes_ // SHARD_BYTES))
    ranges = min(ranges, max(1, bytes_ // (1 << 18)))
    shards = min(shards, max(1, bytes_ // (1 << 14)))
    # joins are by mark alone and bring all of base, so that one shuffle of the texts serves them; documents that share a mark are told apart after
    copies = written(_copies(base), "suffix-copies")
    told = base.join(copies.hint("merge"), "mark", "left").select(*base.columns, F.coalesce(F.array_contains("copies", F.col("doc")), F.lit(False)).alias("copy"))
    lists = _lists(_shared(_hashes(told.where("NOT copy").select("mark", "text", "doc", "nameless"), int(ranges), length)))
    shared = lists.groupBy("mark").agg(F.collect_list("keys").alias("keys"), F.collect_list("hot").alias("hot"))
    some = told.join(shared, "mark").where("NOT copy").select("doc", "mark", "text", "keys", "hot", "nameless")
    gone = _sorted_out(_pieces_to_sort(some, int(shards), length), length).unionByName(_hot_out(some.where(F.size("hot") > 0), int(ranges), length))
    spans = gone.groupBy("mark").agg(F.collect_list(F.struct("doc", "start", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            rows = []
            for text, doc_, copy, spans_ in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), batch.column(4), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                removed = runs = 0
                if copy and len(raw) >= length:
                    removed, runs, kept = len(raw), 1, b""
                elif spans_.is_valid:
                    of, start, n = (spans_.values.field(i).to_numpy() for i in range(3))
                    start, n = start[of == doc_], n[of == doc_]
                    cover = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + n + length - 1, -1)
                    mask = np.cumsum(cover[:-1]) > 0
                    removed = int(mask.sum())
                    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                else:
                    kept = raw
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_kept)
            made = [pa.array(list(x), t) for x, t in zip(list(zip(*rows, strict=True))[: len(kinds)], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept])

    whole = told.join(spans, "mark", "left").select(F.when(~F.col("nameless"), F.col("doc")).alias("doc_id"), "text", "doc", "copy", "spans")
    return whole.transform(in_arrow, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
