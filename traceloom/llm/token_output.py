"""Token ids in word-aligned Simple-8b blocks.

A stored table has a row for each block of whole documents, in ascending doc_id order: shard (its place in the global
order), block (its place in the shard), first_id (ids before it in the shard), n_ids, doc_ids, payload. The payload is

    magic "S8B1" | n_docs, n_ids, n_words, n_escapes as uint32 | end of each document (ids, uint32)
    | ids before each STRIDE-th word (uint32) | words (uint64) | escapes (uint64), all little-endian

A word has a selector in its top four bits, which says how many ids of which width fill the other 60. Selector 0 is an
escape: one value of over 60 bits, which stands in the escapes. The offsets let any stretch of a block be decoded alone.
Parquet carries the rows, so Spark's committer and any Hadoop file system apply.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, joined_bytes, shared_dir, slices, span_keys, word_spans

#: Ids in a word and bits of each, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
STRIDE = 256
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
#: Pieces that an encoder holds at most (about 40 bytes each), and the bytes of the longest.
HELD_PIECES = 1 << 19
LONG = 128
#: New pieces that the tokenizer gets in one text: longer texts cost it more a piece.
TOGETHER = 64
#: Marks that may part pieces that aren't plain: the first that the tokenizer knows as one token of its own.
PARTING = "|~^`"
#: Bytes of text that are encoded in one step; the arrays of a step take about 40 times as much.
STEP_BYTES = 1 << 19
#: What the pre-tokeniser takes a byte for; ODD: not told by the byte alone.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KINDS = np.array([SPACE if chr(b) in " \t\n\r" else ODD if b < 32 or b > 126 or chr(b) == "'" else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)

STORED = "shard int, block int, first_id long, n_ids long, doc_ids array<long>, payload binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and the first value of each word. Greedy: each word takes as many values as fit."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # rounding can only make a width larger
    choice, widest, have = np.zeros(n, np.uint8), np.concatenate([width, np.full(int(COUNTS.max()), 255, np.uint8)]), 1
    for selector in (14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 15):  # ascending counts: the last that fits wins
        count = int(COUNTS[selector])
        while have < count:  # widest[i]: of the values i .. i + have - 1
            more = min(have, count - have)
            widest[:-more] = np.maximum(widest[:-more], widest[more:])
            widest[-more:], have = 255, have + more
        choice[widest[:n] <= WIDTHS[selector]] = selector
    # the value after a word that begins at each place, after 2 words, 4, ..; the walk takes the longest steps, which are then filled in
    jumps = [np.append(np.minimum(np.arange(n, dtype=np.int32) + COUNTS[choice].astype(np.int32), n), np.int32(n))]
    for _ in range(6):
        jumps.append(jumps[-1][jumps[-1]])
    far, i = [], 0
    while i < n:
        far.append(i)
        i = int(jumps[-1][i])
    first = np.array(far, np.int32)
    for jump in jumps[-2::-1]:
        first = np.stack([first, jump[first]], axis=1).ravel()
    first = first[first < n].astype(np.int64)
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        if 0 < selector < 15:
            rows = np.flatnonzero(chosen == selector)
            k, w = int(COUNTS[selector]), int(WIDTHS[selector])
            parts = values[first[rows][:, None] + np.arange(k)] << (np.arange(k, dtype=np.uint64) * np.uint64(w))
            words[rows] |= np.bitwise_or.reduce(parts, axis=1)
    return words, values[first[chosen == 0]], first


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of these words, all words of a selector at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[chosen])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - COUNTS[chosen]
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == 0:
            out[first[rows]] = escapes
        elif selector < 15:
            k, w = int(COUNTS[selector]), int(WIDTHS[selector])
            lanes = (words[rows][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(w))) & np.uint64((1 << w) - 1)
            out[first[rows][:, None] + np.arange(k)] = lanes
    return out


def to_block(documents: list[np.ndarray]) -> bytes:
    ends = np.cumsum([len(x) for x in documents], dtype=np.int64)
    words, escapes, first = pack(np.concatenate(documents)) if documents else pack(np.zeros(0))
    head = struct.pack("<4sIIII", MAGIC, len(documents), int(ends[-1]) if len(ends) else 0, len(words), len(escapes))
    return b"".join([head, ends.astype("<u4").tobytes(), first[::STRIDE].astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def from_block(payload: bytes) -> list[np.ndarray]:
    """The ids of each document of a block."""
    magic, n_docs, n_ids, n_words, n_escapes = struct.unpack_from("<4sIIII", payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    at = struct.calcsize("<4sIIII")
    ends = np.frombuffer(payload, "<u4", n_docs, at)
    at += 4 * n_docs + 4 * -(-n_words // STRIDE)
    words = np.frombuffer(payload, "<u8", n_words, at)
    ids = unpack(words, np.frombuffer(payload, "<u8", n_escapes, at + 8 * n_words))
    if len(ids) != n_ids:
        raise ValueError("damaged Simple-8b block")
    return np.split(ids, ends[:-1]) if n_docs else []


def ids_between(payload: bytes, start: int, end: int) -> np.ndarray:
    """Ids start..end of a block, decoding only the words that hold them (blocks without escapes)."""
    _, n_docs, _, n_words, n_escapes = struct.unpack_from("<4sIIII", payload)
    if n_escapes:
        return np.concatenate(from_block(payload))[start:end]
    at = struct.calcsize("<4sIIII") + 4 * n_docs
    offsets = np.frombuffer(payload, "<u4", -(-n_words // STRIDE), at)
    words = np.frombuffer(payload, "<u8", n_words, at + offsets.nbytes)
    low = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
    high = int(np.searchsorted(offsets, end, side="left"))
    part = unpack(words[low * STRIDE : high * STRIDE], np.zeros(0, np.uint64))
    return part[start - int(offsets[low]) : end - int(offsets[low])] if len(offsets) else part


class WordEncoder:
    """A tokenizer whose pre-tokeniser never joins text across white space: encodes each distinct piece once.

    Chunks are what space, tab, newline and carriage return part. Plain chunks (ASCII, without apostrophes, control
    characters or what begins an added token) are cut as the pre-tokeniser cuts them: letters, single digits, runs of marks.
    Every other chunk is a piece as it stands. Pieces are found in a table by two 64-bit hashes of their bytes; new ones
    go to the tokenizer, TOGETHER at a time: plain ones as words (each ends with a token that ends a word), others parted by a
    lone mark; those that hold the mark, or what begins an added token, alone.
    The table holds at most `most` pieces and starts afresh when full. Pieces of over LONG bytes are never held.
    """

    def __init__(self, path: str, most: int = HELD_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = {i: x.content for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.begins = sorted({x[:2].encode() for x in added.values()})
        self.parting = next(((int(ids[0]), m) for m in PARTING if len(ids := self._alone(m)) == 1 and self.closes[ids[0]]), None)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << (2 * self.most - 1).bit_length(), -1, np.int32)
        self.keys = np.zeros((2, self.most), np.uint64)
        self.first, self.count, self.n = np.zeros(self.most, np.int64), np.zeros(self.most, np.int32), 0
        self.ids, self.used = np.zeros(4 * self.most, np.uint32), 0

    def _alone(self, piece: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, np.uint32)

    def _together(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain or self.parting:
            mark = " " if plain else f" {self.parting[1]} "
            some = [mark.join([*pieces[k : k + TOGETHER], ""]) for k in range(0, len(pieces), TOGETHER)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
            last = self.closes[ids] if plain else ids == self.parting[0]
            ends = np.flatnonzero(last) + 1
            if len(ends) == len(pieces) and ends[-1] == len(ids):
                return (ids, np.diff(ends, prepend=0)) if plain else (ids[~last], np.diff(ends, prepend=0) - 1)
        each = [self._alone(x) for x in pieces]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, or -1."""
        out, mask = np.full(keys.shape[1], -1, np.int32), np.uint64(len(self.slots) - 1)
        left, at = np.arange(keys.shape[1]), (keys[0] & mask).astype(np.int64)
        while len(left):
            entry = self.slots[at]
            held = entry >= 0
            same = held & (self.keys[0, entry] == keys[0, left]) & (self.keys[1, entry] == keys[1, left])
            out[left[same]] = entry[same]
            on = held & ~same
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def _hold(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds entries whose pairs of hashes differ from each other and from those held."""
        n, mask = keys.shape[1], len(self.slots) - 1
        entry = np.arange(self.n, self.n + n, dtype=np.int32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.keys[:, entry], self.count[entry] = keys, counts
        self.first[entry] = self.used + np.cumsum(counts) - counts
        self.n, self.used = self.n + n, self.used + len(ids)
        at = (keys[0] & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            on = self.slots[at] != entry
            entry, at = entry[on], (at[on] + 1) & mask

    def _pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, which of them are plain, and the bytes with A-Z of plain ones as lower case."""
        kind = KINDS[data]
        for two in self.begins:
            kind[:-1][(data[:-1] == two[0]) & (data[1:] == two[1])] = ODD
        starts, ends = word_spans(kind, np.arange(256) != SPACE)
        odd = np.add.reduceat(kind == ODD, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
        if len(starts):  # a chunk and the space after it are summed: spaces are not odd
            inside = np.repeat(odd, np.diff(np.append(starts, len(data))))
            kind[starts[0] :][inside & (kind[starts[0] :] != SPACE)] = ODD
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        piece = kind[starts] != SPACE
        starts, ends = starts[piece], ends[piece]
        return starts, ends, kind[starts] != ODD, np.where(kind == LETTER, data | 32, data)

    def encode_bytes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, and where each text's begin (and the end)."""
        data, begin = joined_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts, ends, plain, data = self._pieces(data)
        long = ends - starts > LONG
        keys = span_keys(data, starts, np.where(long, starts, ends))
        entry = self._find(keys)
        missing = np.flatnonzero((entry < 0) & ~long)
        new = missing[np.unique(keys[0, missing], return_index=True)[1]]
        if self.n + len(new) > self.most:
            self._clear()
            entry[:] = -1
            missing = np.flatnonzero(~long)
            new = missing[np.unique(keys[0, missing], return_index=True)[1]]
        raw = data.tobytes()
        new = np.concatenate([new[plain[new]], new[~plain[new]]])[: self.most]
        for of in (new[plain[new]], new[~plain[new]]):
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)]
            begins = [] if len(of) and plain[of[0]] else [x.decode() for x in self.begins] + ([self.parting[1]] if self.parting else [])
            apart = [k for k, x in enumerate(text) if any(b in x for b in begins)] if begins else []
            if apart:
                each = [self._alone(text[k]) for k in apart]
                self._hold(keys[:, of[apart]], np.concatenate(each), np.array([len(x) for x in each]))
                of, text = np.delete(of, apart), [x for k, x in enumerate(text) if k not in set(apart)]
            self._hold(keys[:, of], *self._together(text, bool(len(of)) and bool(plain[of[0]])))
        entry[missing] = self._find(keys[:, missing])
        ids, first, count = self.ids, self.first[entry], self.count[entry].astype(np.int64)
        rest = np.flatnonzero(entry < 0)  # long, beyond what the table holds, or of equal first hashes
        if len(rest):
            each = [self._alone(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            count[rest] = [len(x) for x in each]
            first[rest] = self.used + np.cumsum(count[rest]) - count[rest]
            ids = np.concatenate([ids[: self.used], *each])
        until = np.append(0, np.cumsum(count))
        out = ids[np.repeat(first - until[:-1], count) + np.arange(until[-1])]
        return out, until[np.searchsorted(starts, begin)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_bytes([x.encode("utf-8", "replace") for x in texts])
        return np.split(ids, at[1:-1]) if texts else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_held: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of a tokenizer, one a Python worker: later tasks find what earlier ones learned."""
    if path not in _held:
        _held.clear()
        _held[path] = WordEncoder(path)
    return _held[path]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs.text (null: empty), appends end_id to each document, and writes blocks in ascending doc_id order.

    Null doc_ids come first; rows of equal doc_id follow each other, by text. A document is never split between blocks.
    Other columns of docs are ignored. Partitions are dealt by ranges of doc_id; no document's text is in two of them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        names, docs_, block, before, n = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([to_block(docs_)], pa.binary())], ["shard", "block", "first_id", "n_ids", "doc_ids", "payload"])

        for part in (x for batch in batches for x in slices(batch, most=STEP_BYTES)):
            all_ids, at = encoder.encode_bytes([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])
            for name, text in zip(part.column(0).to_pylist(), np.split(all_ids, at[1:-1]), strict=True):
                ids = np.append(text, np.uint32(end_id))
                if n and n + len(ids) > block_ids:
                    yield row()
                    names, docs_, block, before, n = [], [], block + 1, before + n, 0
                names.append(name)
                docs_.append(ids)
                n += len(ids)
        if docs_:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.transform(in_arrow, encode, STORED).write.option("parquet.block.size", 16 << 20).parquet(path)


def read_ids(stored: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row for each document of a stored table: doc_id, start, n_tokens, ids_crc32, shard, and ids (array<long>) if asked."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, names, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                documents = from_block(payload)
                sizes = np.array([len(x) for x in documents], np.int64)
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in documents]
                columns = [pa.array(names, pa.int64()), pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums, pa.int64()), pa.array([shard] * len(names), pa.int32())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(documents).astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "in_shard", "n_tokens", "ids_crc32", "shard", "ids"][: len(columns)])

    fields = "doc_id long, in_shard long, n_tokens long, ids_crc32 long, shard int" + ", ids array<long>" * with_ids
    rows = stored.select("shard", "first_id", "doc_ids", "payload").transform(in_arrow, decode, fields)
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", *["ids"] * with_ids)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes the ids of docs and reads them back: see write_ids and read_ids. Empty tables give no rows."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(spark.read.schema(STORED).parquet(path), with_ids)
