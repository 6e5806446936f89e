"""Byte-level BPE by ranks: encoding with a hierarchical-bitmap rank queue, and decoding.

Ranks are a file of lines "base64 of the token, rank"; a token's id is its rank. Every match of a pattern is encoded
alone: as its own token if it is one, else by merging, again and again, the leftmost of its neighbours whose joined bytes
have the least rank. All pieces that are new in a slice of text share one linked list and one queue: a bucket for each
rank holds places of the list, three levels of words say which buckets have entries, and an entry whose pair has changed
since is stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices
from .pieces import PieceTable, code_points, kinds, parts, pattern_starts


class RankQueue:
    """Buckets of places by rank. Bits of `words` tell buckets with entries, of `groups` words, of `top` groups."""

    def __init__(self, n_ranks: int):
        self.words = [0] * ((n_ranks >> 6) + 1)
        self.groups = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def _mark(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.words[word] |= 1 << (rank & 63)
        self.groups[group] |= 1 << (word & 63)
        self.top |= 1 << group

    def put(self, rank: int, place: int) -> None:
        found = self.buckets.get(rank)
        if found is None:
            self.buckets[rank] = [place]
            self._mark(rank)
        else:
            found.append(place)

    def fill(self, rank: int, places: list[int]) -> None:
        """A whole bucket, of a rank that has none."""
        self.buckets[rank] = places
        self._mark(rank)

    def take(self) -> tuple[int, list[int]]:
        """The least rank with entries and its places in ascending order; the bucket is gone then."""
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.words[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        self.words[word] = bits & (bits - 1)
        if not self.words[word]:
            self.groups[group] &= self.groups[group] - 1
            if not self.groups[group]:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class RankEncoder:
    """Encodes pieces by ranks of byte strings. It takes some 60 bytes for each byte of the pieces of one call."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.n_ranks = ranks, max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.longest = max(map(len, ranks))

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        whole = np.array([self.ranks.get(x, -1) for x in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(pieces), np.int64)
        merged, counts[rest] = self.merged([pieces[i] for i in rest.tolist()])
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[first[whole >= 0]] = whole[whole >= 0]
        out[np.repeat(whole < 0, counts)] = merged
        return out, counts

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As __call__, by merging alone."""
        text = b"".join([b"\0", *(x + b"\0" for x in pieces)])
        data = np.frombuffer(text, np.uint8)
        walls = np.append(0, np.cumsum([len(x) + 1 for x in pieces])).astype(np.int64)
        wall = np.zeros(len(data), np.uint8)
        wall[walls] = 1
        found = np.full(len(data), -1, np.int32)
        found[:-1] = self.pairs[data[:-1].astype(np.uint16) << 8 | data[1:]]
        found[walls] = -1
        found[walls[1:] - 1] = -1
        token = array("i", self.byte_ids[data].tobytes())
        rank = array("i", found.tobytes())
        after = array("i", np.arange(1, len(data) + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, len(data) - 1, dtype=np.int32).tobytes())
        gone, is_wall = bytearray(len(data)), wall.tobytes()
        queue, get, longest = RankQueue(self.n_ranks), self.ranks.get, self.longest
        places = np.flatnonzero(found >= 0)
        places = places[np.argsort(found[places], kind="stable")]
        heads = np.flatnonzero(np.diff(found[places], prepend=-1))
        if len(places):
            for r, same in zip(found[places[heads]].tolist(), np.split(places, heads[1:]), strict=True):
                queue.fill(r, same.tolist())
        put, take = queue.put, queue.take
        while queue.top:
            r, bucket = take()
            for k, p in enumerate(bucket):
                if rank[p] != r:  # stale: merged away, or another pair by now
                    continue
                q = after[p]
                end = after[q]
                token[p], after[p], before[end], rank[q], gone[q] = r, end, p, -1, 1
                least, new = r, -1
                if not is_wall[end]:
                    until = after[end]
                    if until - p <= longest:
                        new = get(text[p:until], -1)
                        if new >= 0:
                            put(new, p)
                            least = min(least, new)
                rank[p] = new
                left = before[p]
                if not is_wall[left]:
                    new = get(text[left:end], -1) if end - left <= longest else -1
                    rank[left] = new
                    if new >= 0:
                        put(new, left)
                        least = min(least, new)
                if least < r and k + 1 < len(bucket):  # what is left waits for the lower rank
                    queue.fill(r, bucket[k + 1 :])
                    break
        stays = (np.frombuffer(gone, np.uint8) | wall) == 0
        until = np.cumsum(stays)
        return np.frombuffer(token, np.int32)[stays], np.diff(until[walls])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.table, self.kinds = PieceTable(RankEncoder(ranks)), kinds("tiktoken")
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.known = np.zeros(len(by_id), bool)
        self.known[list(ranks.values())] = True
        self.size = np.array([len(x) for x in by_id], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.names = [str(i) for i in range(len(by_id))]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        points, at = code_points(data)
        ends = np.cumsum([len(x) for x in texts])
        begins = np.searchsorted(at, np.append(0, ends[:-1]))
        starts = at[:-1][pattern_starts(points, begins, self.kinds)]
        ids, counts = self.table.encode(data, starts, np.append(starts[1:], len(data))[: len(starts)])
        until = np.append(0, np.cumsum(counts))
        return ids, np.diff(until[np.searchsorted(starts, np.append(0, ends))])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id without a token is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id that has no token")
        size = self.size[ids]
        until = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - until + size, size) + np.arange(until[-1] if len(until) else 0)].tobytes()


_held: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The codec of a rank file, one a Python worker: later tasks find what earlier ones learned."""
    if path not in _held:
        _held.clear()
        _held[path] = Codec(path)
    return _held[path]


def _encoded(codec: Codec, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, ids, whether these are the row's last), in order. Very long texts come in several parts."""
    row = 0
    for part in slices(batch):
        texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
        every = [(i, x) for i, text in enumerate(texts) for x in parts(text)]
        if len(every) == len(texts):
            ids, counts = codec.encode(texts)
            for i, own in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                yield row + i, own, True
        else:
            for k, (i, text) in enumerate(every):
                yield row + i, codec.encode([text])[0], k + 1 == len(every) or every[k + 1][0] != i
        row += len(texts)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) with a column ids (array<int>) for text, which null and empty texts have empty.

    All rows and all other columns stay as they are; a column `ids` of docs is replaced. Rows of null or equal doc_id
    are rows like others. A text takes about 60 bytes a byte of its longest stretch without a space, and 4 for each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            rows: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for i, ids, _ in _encoded(codec, batch):
                rows[i].append(ids)
            size = [sum(map(len, x)) for x in rows]
            flat = np.concatenate([np.zeros(0, np.int32), *(y for x in rows for y in x)])
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    kept = docs.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return in_arrow(kept, run, f"{schema}, ids array<int>")


def decoded(df: DataFrame, path: str) -> DataFrame:
    """df(ids array<int>, ...) with a column `bytes` (binary): the bytes of ids, null where ids is null; a column `bytes` of df is replaced.

    Ids that the file lacks, and nulls among ids, fail the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            made = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "bytes"])

    kept = df.drop("bytes")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return in_arrow(kept, run, f"{schema}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes docs.text and decodes the ids: a row for each row, (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null texts count as empty ones; rows of null or equal doc_id are rows like others; other columns are ignored; an
    empty table gives none. Only digests leave a task, so a text's ids are held a part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            ids_sum, bytes_sum, count = hashlib.sha256(), hashlib.sha256(), 0
            for _, ids, last in _encoded(codec, batch):
                if len(ids):
                    ids_sum.update(("," * bool(count) + ",".join(map(codec.names.__getitem__, ids.tolist()))).encode())
                    bytes_sum.update(codec.decode(ids))
                    count += len(ids)
                if last:
                    n.append(count)
                    of_ids.append(ids_sum.hexdigest())
                    of_bytes.append(bytes_sum.hexdigest())
                    ids_sum, bytes_sum, count = hashlib.sha256(), hashlib.sha256(), 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
