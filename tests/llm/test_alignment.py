"""Alignment against the two libraries on whole texts, and links by comparing all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import LONG, ODD
from traceloom.llm import alignment
from traceloom.llm.queries import ALIGNED, tokenizer_path

A, B = map(tokenizer_path, ALIGNED)
RNG = random.Random(13)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, libraries):
    """Tokens of whole texts by the libraries, every pair of byte ranges compared."""
    a, b = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    found, holders = [], Counter()
    for i, text in rows:
        row = (i, [], [], [], [])
        if text:
            ta = a.encode(" " + text, add_special_tokens=False).ids
            tb = b.encode(text)
            ba = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ta]
            bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in tb]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                links, k = [], 0
                for x, (low, high) in enumerate(zip([0, *ends_a], ends_a, strict=False)):
                    for y in range(k, len(tb)):
                        begin = ends_b[y - 1] if y else 0
                        if begin >= high:
                            break
                        if ends_b[y] <= low:
                            k = y
                            continue
                        links.append((ta[x], tb[y]))
                groups, last_a, last_b = [], 0, 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a.index(cut, last_a) + 1, ends_b.index(cut, last_b) + 1
                    groups.append(",".join(map(str, ta[last_a:x])) + "|" + ",".join(map(str, tb[last_b:y])))
                    last_a, last_b = x, y
                row = (i, ta, tb, groups, links)
                holders.update(set(links))
        found.append(row)
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for i, ta, tb, groups, links in found:
        text = ";".join(groups)
        out.append((i, len(ta), len(tb), len(groups), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out


TEXTS = ["", " ", "  a ", "it's don't 's", "a▁b", "x <0x0A> <s> </s> <|endoftext|>", "tab\tnew\nline\r\n\n  end  ", "café naïve 中文字 \U0001f642\U0001f642 é", "\0nul", " nbsp　wide", "ﬁ ① ½ Ａ", "a" * 300, "!" * 50, "1234567 89", " lead", "trail   "]


def test_equals_the_libraries(docs, libraries):
    letters = "ab's tlredvm  \né中1٣!'’.<0x▁\U0001f642"
    rows = [(i, t) for i, t in ODD if t is None or len(t) < 1000] + list(enumerate(TEXTS, 20))
    rows += [(100 + k, "".join(RNG.choice(letters[:-2] if k % 5 else letters) for _ in range(RNG.randrange(40)))) for k in range(400)]
    rows += [(600 + k, LONG[a : a + 900]) for k, a in enumerate(range(0, 20_000, 700))]
    got = alignment.alignments(docs(rows), A, B).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, libraries)))
    assert sum(r["n_links"] > 0 for r in got) > 380


def test_blocks_and_parts_change_nothing(docs, libraries, monkeypatch):
    rows = [(k, LONG[a : a + 5000]) for k, a in enumerate(range(0, 30_000, 4000))] + [(50, None), (None, "a b"), (3, "a b")]
    want = brute(rows, libraries)
    aligner = alignment.aligner_of(A, B)
    for _, text in rows[:2]:
        whole = aligner([(" " + text).encode()])[0]
        cut = alignment._joined([aligner([x])[0] for x in alignment.parts((" " + text).encode(), 100)])
        assert (whole.n_a, whole.n_b, whole.n_groups, whole.n_links, whole.groups) == (cut.n_a, cut.n_b, cut.n_groups, cut.n_links, cut.groups)
        assert (whole.pairs == cut.pairs).all() and (whole.times == cut.times).all()
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 9000)
    got = alignment.alignments(docs(rows).repartition(3), A, B).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pair_counts(docs, libraries):
    rows = [(k, LONG[a : a + 300]) for k, a in enumerate(range(0, 3000, 250))]
    holders = Counter()
    for _, text in rows:
        part = alignment.aligner_of(A, B)([(" " + text).encode()])[0]
        holders.update(part.pairs.tolist())
    got = {(r["a_id"] << alignment.PAIR_BITS | r["b_id"]): r["n_docs"] for r in alignment.pair_counts(docs(rows), A, B).collect()}
    assert got == dict(holders)


def test_no_documents(docs):
    assert alignment.alignments(docs([]), A, B).count() == 0
    assert [tuple(r) for r in alignment.alignments(docs([(1, None), (2, "")]), A, B, with_groups=False).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
