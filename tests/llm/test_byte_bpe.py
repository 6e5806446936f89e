"""Byte-level BPE against the library that defines it, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.conftest import LONG, ODD
from traceloom.llm import byte_bpe, pieces
from traceloom.llm.queries import RANKS, tokenizer_path

PATH = tokenizer_path(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec_of(PATH)


def ids_of(codec, texts):
    ids, n = codec.encode([x.encode() for x in texts])
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_queue_gives_least_ranks_first():
    rng, queue, held = random.Random(2), byte_bpe.RankQueue(300_000), {}
    for _ in range(5000):
        if held and rng.random() < 0.3:
            rank, places = queue.take()
            assert rank == min(held) and places == sorted(held.pop(rank))
        else:
            rank, place = rng.randrange(300_000) if rng.random() < 0.5 else rng.randrange(130), rng.randrange(1000)
            held.setdefault(rank, []).append(place)
            queue.put(rank, place)
    while held:
        rank, places = queue.take()
        assert rank == min(held) and places == sorted(held.pop(rank))
    assert queue.top == 0


def test_equals_the_library(codec, library):
    rng = random.Random(3)
    letters = "ab's tlredvm  \n\t 　é中1٣½!'’.́🙂"
    texts = ["", " ", "  a", "a  b\n\n c  ", "it's don't 's 'S we'll they're 'tart ''s x' 'll've", "\n's", "'", "'s", " 's", "  's", "<|endoftext|>", "\0", *(x or "" for _, x in ODD)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    assert ids_of(codec, texts) == [library.encode_ordinary(x) for x in texts]


def test_every_letter_number_and_blank_equals_the_library(codec, library):
    kinds = pieces.kinds("tiktoken")
    texts = [f"a{c}a 1{c}1 !{c}! {c} {c}a" for c in map(chr, np.flatnonzero(kinds).tolist())]
    assert ids_of(codec, texts) == library.encode_ordinary_batch(texts, num_threads=2)


def test_very_long_pieces(codec, library):
    rng = random.Random(4)
    texts = ["a" * 30_000, "ab" * 9_000, "".join(rng.choice("etaoin") for _ in range(40_000)), "!" * 5_001, " " * 4_001 + "x"]
    assert ids_of(codec, texts) == [library.encode_ordinary(x) for x in texts]


def test_merging_by_any_ranks_equals_the_plain_rule():
    """Random ranks, where merging can bring up a lower rank than the last one."""
    rng = random.Random(5)
    for _ in range(60):
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))).encode() for _ in range(12)}
        ranks = {bytes([b]): b for b in range(256)} | dict(zip(tokens, rng.sample(range(256, 9000), len(tokens)), strict=True))
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(20)]
        ids, counts = byte_bpe.RankEncoder(ranks).merged(texts)
        want = []
        for text in texts:
            parts = [bytes([b]) for b in text]
            while True:
                found = min(((ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks), default=None)
                if not found:
                    break
                parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
            want.append([ranks[x] for x in parts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_a_full_table_starts_afresh(library):
    small = byte_bpe.Codec(PATH)
    small.table.most = 40
    texts = [LONG[:3000], LONG[1000:5000], "one two", LONG[:200]]
    for _ in range(2):
        for x in texts:
            assert ids_of(small, [x]) == [library.encode_ordinary(x)]


def test_texts_in_parts():
    assert b"".join(pieces.parts(LONG.encode(), 1000)) == LONG.encode()
    assert max(map(len, pieces.parts(LONG.encode(), 1000))) < 1020
    assert list(pieces.parts(b"x" * 5000, 1000)) == [b"x" * 5000] and list(pieces.parts(b"", 10)) == [b""]


def test_round_trip(docs, library):
    rows = [*ODD, (10, LONG * 3), (None, None)]
    got = byte_bpe.round_trip(docs(rows), PATH).collect()
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.round_trip(docs([]), PATH).count() == 0


def test_encoded_and_decoded(docs, library):
    full = docs([*ODD, (10, LONG * 3)]).selectExpr("*", "text AS ids", "text AS bytes")
    rows = byte_bpe.decoded(byte_bpe.encoded(full, PATH), PATH).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode() and r["matches"] == "m"
    assert byte_bpe.decoded(byte_bpe.encoded(docs([]), PATH), PATH).count() == 0


def test_unknown_ids_are_refused(codec):
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]))
