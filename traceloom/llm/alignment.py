"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each byte of a text has an owner in A and one in B, by np.repeat of the tokens' places over their sizes. Where either owner
changes, the next pair of owners is a link; where both change at once, a group ends. Links are counted over the corpus by
the documents that hold them. A block of documents keeps its distinct pairs once and its documents' links as places in that
list, so what is shuffled is a row for each block and pair, and counts come back to a block, not to a document.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, written
from .pieces import PieceTable, code_points, kinds, parts, pattern_starts

#: Bytes of text after which a block of documents is closed.
BLOCK_BYTES = 8 << 20
#: A pair as one number: the id of A above these bits, that of B below.
PAIR_BITS = 24
#: An id that stands for a piece whose tokens don't give its bytes back.
LOST = -1
#: Fixed value: the character that stands for a space in pieces of B.
LOW_LINE = "▁"

BLOCKS = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, pairs array<long>, holders array<int>, payload binary"


def _checked(pieces: list[bytes], ids: np.ndarray, counts: np.ndarray, token_bytes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts, with LOST alone for each piece whose tokens don't give its bytes."""
    if b"".join(map(token_bytes.__getitem__, ids.tolist())) == b"".join(pieces) and (counts > 0).all():
        return ids, counts
    out = []
    for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        out.append(own if b"".join(map(token_bytes.__getitem__, own.tolist())) == piece else np.array([LOST], np.int32))
    return np.concatenate(out).astype(np.int32), np.array([len(x) for x in out], np.int64)


def _between(ids: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that stand between those equal to cut, and how many stand in each place."""
    at = np.flatnonzero(ids == cut)
    return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1


class ByteLevel:
    """Tokens of a byte-level BPE file of the tokenizers library, for texts that begin with a space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        self.kinds, self.newline = kinds("tokenizers"), self._ids(["\n"])[0][0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return pattern_starts(points, begins, self.kinds)

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without blanks but a leading space are encoded together, a newline between them; it cuts them as they are."""
        texts = [x.decode() for x in pieces]
        joint = np.array([not x[0].isspace() or x[0] == " " and not x[1:2].isspace() and len(x) > 1 for x in texts])
        together = [x for x, yes in zip(texts, joint.tolist(), strict=True) if yes]
        ids, n = _between(np.array(self._ids(["\n".join(together)])[0], np.int32), self.newline) if together else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(n) != len(together) or not n.all():
            joint[:] = False
        alone = [np.array(x, np.int32) for x in self._ids([x for x, yes in zip(texts, joint.tolist(), strict=True) if not yes])]
        counts = np.zeros(len(texts), np.int64)
        counts[~joint] = [len(x) for x in alone]
        if joint.any():
            counts[joint] = n
        out = np.empty(int(counts.sum()), np.int32)
        of_joint = np.repeat(joint, counts)
        out[of_joint] = ids if joint.any() else 0
        out[~of_joint] = np.concatenate([np.zeros(0, np.int32), *alone])
        return _checked(pieces, out, counts, self.token_bytes)


class Pieces:
    """Tokens of a BPE model of the sentencepiece library with byte fallback, which puts a space before every text.

    Merges only make pieces of the vocabulary, so no token holds two neighbouring characters that no piece holds: there the
    text can be cut, and what lies between is encoded once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
        shown = [self.model.id_to_piece(i) for i in range(n)]
        self.token_bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else b"" if special(i) else x.replace(LOW_LINE, " ").encode() for i, x in enumerate(shown)]
        self.newline = self.model.piece_to_id("<0x0A>")
        normal = [x for i, x in enumerate(shown) if not special(i)]
        letters = sorted(set("".join(normal)))
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.place[ord(" ")] = self.place[ord(LOW_LINE)]
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x in normal:
            at = self.place[[ord(c) for c in x]]
            self.joined[at[:-1], at[1:]] = True
        if self.joined[1:, self.place[ord(" ")]].sum() > self.joined[self.place[ord(" ")], self.place[ord(" ")]]:
            raise ValueError("a piece has a space after another character")
        if self.place[ord("\n")]:
            raise ValueError("a piece has a newline")

    def starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        start = np.ones(len(points), bool)
        at = self.place[points]
        start[1:] = ~self.joined[at[:-1], at[1:]]
        start[begins[begins < len(points)]] = True
        return start

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All together, each after a newline, which is a token of its own; the library's own space comes before the first."""
        ids = np.array(self.model.encode("\n" + "\n".join("" if x == b"\n" else x.decode() for x in pieces)), np.int32)
        ids, counts = _between(ids, self.newline)
        ids, counts = ids[counts[0] :], counts[1:]
        breaks = np.array([x == b"\n" for x in pieces])
        at = (np.cumsum(counts) - counts)[breaks]
        counts[breaks] = 1
        return _checked(pieces, np.insert(ids, at, self.newline), counts, self.token_bytes)


class Side:
    """One of the two tokenizers, with the pieces it has met."""

    def __init__(self, tokenizer: ByteLevel | Pieces):
        self.tokenizer, self.table = tokenizer, PieceTable(tokenizer.encode_new)
        self.size = np.array([len(x) for x in tokenizer.token_bytes], np.int64)

    def encode(self, data: np.ndarray, points: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. ends: where each text ends in data."""
        begins = np.searchsorted(at, np.append(0, ends[:-1]))
        starts = at[:-1][self.tokenizer.starts(points, begins)]
        ids, counts = self.table.encode(data, starts, np.append(starts[1:], len(data))[: len(starts)])
        until = np.append(0, np.cumsum(counts))
        return ids, np.diff(until[np.searchsorted(starts, np.append(0, ends))])


class Part:
    """What the alignment of one text, or part of a text, comes to."""

    __slots__ = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")

    def __init__(self, n_a: int, n_b: int, n_groups: int, n_links: int, groups: bytes, pairs: np.ndarray, times: np.ndarray):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.groups, self.pairs, self.times = n_a, n_b, n_groups, n_links, groups, pairs, times


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in A, place in B, whether a group begins) of each link, in order; both cover the same bytes, no size is 0."""
    own_a, own_b = np.repeat(np.arange(len(a_sizes), dtype=np.int32), a_sizes), np.repeat(np.arange(len(b_sizes), dtype=np.int32), b_sizes)
    new_a, new_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
    new_a[1:], new_b[1:] = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    at = np.flatnonzero(new_a | new_b)
    return own_a[at], own_b[at], (new_a & new_b)[at]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Side(ByteLevel(a_path)), Side(Pieces(b_path))
        names = [str(i).encode() for i in range(max(len(self.a.size), len(self.b.size)))]
        self.stride = len(names)
        self.names = [mark + x for mark in (b",", b"|", b";") for x in names]

    def __call__(self, texts: list[bytes]) -> list[Part | None]:
        """A Part for each text (with its leading space; groups begin with ';'), None where tokens don't give the text back."""
        sizes = np.array([len(x) for x in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        points, at = code_points(data)
        ends = np.cumsum(sizes)
        a, n_a = self.a.encode(data, points, at, ends)
        b, n_b = self.b.encode(data, points, at, ends)
        whose = np.arange(len(texts))
        lost = (np.bincount(np.repeat(whose, n_a)[a == LOST], minlength=len(texts)) > 0) | (np.bincount(np.repeat(whose, n_b)[b == LOST], minlength=len(texts)) > 0)
        lost[np.searchsorted(ends, at[:-1][points == ord(LOW_LINE)], side="right")] = True
        good = np.flatnonzero(~lost)
        if not len(good):
            return [None] * len(texts)
        a, b = a[np.repeat(~lost, n_a)], b[np.repeat(~lost, n_b)]
        n_a, n_b = n_a[good], n_b[good]
        link_a, link_b, begins = owners(self.a.size[a], self.b.size[b])
        group = np.cumsum(begins) - 1
        of_a = np.repeat(np.arange(len(good)), n_a)
        link_of = of_a[link_a]
        n_links, n_groups = np.bincount(link_of, minlength=len(good)), np.bincount(link_of[begins], minlength=len(good))
        # a group's tokens of A, then its tokens of B, each with the mark that stands before it
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[link_a], group_b[link_b] = group, group
        place = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        mark = np.where(first, np.where(place & 1, 1, 2), 0)
        shown = (mark * self.stride + np.concatenate([a, b])[order]).tolist()
        # each text's distinct pairs
        distinct, pair = np.unique(a[link_a].astype(np.int64) << PAIR_BITS | b[link_b], return_inverse=True)
        held, times = np.unique(link_of * len(distinct) + pair, return_counts=True)
        pairs, until = distinct[held % len(distinct)], np.searchsorted(held, np.arange(len(good) + 1) * len(distinct))
        out: list[Part | None] = [None] * len(texts)
        until_token = np.append(0, np.cumsum(n_a + n_b)).tolist()
        for k, i in enumerate(good.tolist()):
            text = b"".join(map(self.names.__getitem__, shown[until_token[k] : until_token[k + 1]]))
            out[i] = Part(int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), text, pairs[until[k] : until[k + 1]], times[until[k] : until[k + 1]])
        return out


def _joined(found: list[Part | None]) -> Part | None:
    """One text's parts as one."""
    if any(x is None for x in found):
        return None
    if len(found) == 1:
        return found[0]
    pairs, back = np.unique(np.concatenate([x.pairs for x in found]), return_inverse=True)
    times = np.bincount(back, np.concatenate([x.times for x in found])).astype(np.int64)
    return Part(*(sum(getattr(x, name) for x in found) for name in ("n_a", "n_b", "n_groups", "n_links")), b"".join(x.groups for x in found), pairs, times)


_NOTHING = Part(0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))


@cache
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker: later tasks find the pieces that earlier ones met."""
    return Aligner(a_path, b_path)


def _narrow(x: np.ndarray) -> np.ndarray:
    """x as unsigned integers of as few bytes as its values need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _to_payload(ends: np.ndarray, at: np.ndarray, times: np.ndarray) -> bytes:
    """ends of each document's links, their places in the block's pairs and how often each occurs."""
    columns = [_narrow(x) for x in (ends, at, times)]
    return struct.pack("<6I", *(v for x in columns for v in (len(x), x.itemsize))) + b"".join(x.tobytes() for x in columns)


def _from_payload(payload: bytes) -> list[np.ndarray]:
    head, out, at = struct.unpack_from("<6I", payload), [], 24
    for n, width in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(payload, f"<u{width}", n, at).astype(np.int64))
        at += n * width
    return out


def _blocks(docs: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """A row for each block of documents, written: see BLOCKS. Block numbers are the partition's and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, block = aligner_of(a_path, b_path), TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        found: list[Part] = []
        size = 0

        def row() -> pa.RecordBatch:
            pairs, at, holders = np.unique(np.concatenate([np.zeros(0, np.int64), *(x.pairs for x in found)]), return_inverse=True, return_counts=True)
            payload = _to_payload(np.cumsum([len(x.pairs) for x in found]), at, np.concatenate([np.zeros(0, np.int64), *(x.times for x in found)]))
            texts = [x.groups[1:] for x in found]
            columns = [names, *([getattr(x, name) for x in found] for name in ("n_a", "n_b", "n_groups", "n_links")), [hashlib.sha256(x).hexdigest() if x else "" for x in texts], [x.decode() for x in texts] if with_groups else None]
            kinds_ = [*[pa.list_(pa.int64())] * 5, *[pa.list_(pa.string())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], t) for x, t in zip(columns, kinds_, strict=True)), pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int32())), pa.array([payload], pa.binary())], [x.split()[0] for x in BLOCKS.split(", ")])

        for part in (x for batch in batches for x in slices(batch)):
            texts = [b" " + x if x else b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            cut = [list(parts(x)) if x else [] for x in texts]
            if all(len(x) <= 1 for x in cut):
                each = iter(align([x[0] for x in cut if x]) if any(cut) else [])
                own = [next(each) if x else _NOTHING for x in cut]
            else:
                own = [_joined([align([y])[0] for y in x]) if x else _NOTHING for x in cut]
            for name, text, what in zip(part.column("doc_id").to_pylist(), texts, own, strict=True):
                names.append(name)
                found.append(what or _NOTHING)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield row()
                    names, found, size, block = [], [], 0, block + 1
        if names:
            yield row()

    return written(in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, BLOCKS), "alignment-blocks")


def _pair_counts(blocks: DataFrame) -> DataFrame:
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a_id", F.shiftright("pair", PAIR_BITS))
    return counts.join(counts.groupBy("a_id").agg(F.max("n_docs").alias("most")), "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n_docs, best): how many rows of docs link these ids, and whether it is the most that a_id has (ties are all best)."""
    found = _pair_counts(_blocks(docs, a_path, b_path, False))
    return found.select(F.shiftright("pair", PAIR_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1).cast("int").alias("b_id"), "n_docs", "best")


def alignments(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """Aligns the tokens of space + docs.text in A (byte-level BPE, a tokenizers file) and B (a sentencepiece model).

    A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents
    as any pair of its A id), count_sum (of the documents that hold each link's pair), groups_sha256 of the groups as
    text, and groups (`a1,a2|b1;a3|b2`) if asked for. Null and empty texts, and those that either tokenizer's tokens
    don't give back byte by byte, have no tokens: zeros and ''. Rows of null or equal doc_id are rows, and documents, of
    their own; other columns are ignored; an empty table gives none. Very long texts are aligned in parts, cut before a
    space; a text takes some 150 bytes for each byte of its longest stretch without one, and 16 for each of its distinct pairs.
    """
    blocks = _blocks(docs, a_path, b_path, with_groups)
    pairs = blocks.select("block", F.explode("pairs").alias("pair"))
    valued = pairs.join(_pair_counts(blocks), "pair").select("block", F.struct("pair", (2 * F.col("n_docs") + F.col("best").cast("int")).alias("value")).alias("x"))
    values = valued.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x")).select("block", F.col("x.value").alias("counts"))  # a block's pairs, in order
    columns = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends, at, times = _from_payload(batch.column("payload")[k].as_py())
                counts = batch.column("counts")[k]
                value = counts.values.to_numpy() if counts.is_valid else np.zeros(0, np.int64)
                until = np.append(0, ends)
                total = lambda x: np.diff(np.append(0, np.cumsum(x))[until])  # noqa: B023, E731
                own = [batch.column(name)[k].values for name in columns]
                n_best, count_sum = total(times * (value & 1)[at]), total(times * (value >> 1)[at])
                yield pa.RecordBatch.from_arrays([*own[:5], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), *own[5:]], ["doc_id", *columns[1:5], "n_best", "count_sum", *columns[5:]])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return in_arrow(blocks.select("block", *columns, "payload").join(values, "block", "left").drop("block"), run, schema)
