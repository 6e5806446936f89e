"""Control tokens in users' text: rewritten so that a tokenizer can't take them for its own, and texts counted in tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a control token looks like, and how it is written afterwards.
CONTROL, REWRITTEN = r"<\|([A-Za-z0-9_]+)\|>", "<¦$1¦>"
MARK = "¦"


def rewritten(text: Column) -> Column:
    """`<|name|>` as `<¦name¦>`, wherever it stands."""
    return F.regexp_replace(text, CONTROL, REWRITTEN)


class Rewriter:
    """Rewrites given tokens in one pass: a mark after the first character of each, as if they were replaced one by one.

    Longer tokens come before shorter ones and, of the same length, earlier ones of the list; a token within one that is
    rewritten already, or across its edge, isn't one any more. An automaton finds all occurrences in one walk of the text.
    """

    def __init__(self, tokens: tuple[str, ...]):
        import ahocorasick

        self.tokens = sorted({x for x in tokens if x}, key=lambda x: (-len(x), tokens.index(x)))
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            self.automaton.add_word(token, rank)
        if self.tokens:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.tokens:
            return text
        found = sorted((rank, end - len(self.tokens[rank]) + 1) for end, rank in self.automaton.iter(text))
        taken, starts = bytearray(len(text)), []
        for rank, start in found:
            size = len(self.tokens[rank])
            if not any(taken[start : start + size]):
                taken[start : start + size] = b"\1" * size
                starts.append(start)
        parts, before = [], 0
        for start in sorted(starts):
            parts += [text[before : start + 1], MARK]
            before = start + 1
        return "".join([*parts, text[before:]])


@cache
def rewriter(tokens: tuple[str, ...]) -> Rewriter:
    return Rewriter(tokens)


def without_tokens(text: Column, tokens: list[str]) -> Column:
    """text with these tokens rewritten, see Rewriter; null stays null."""
    wanted = tuple(tokens)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(rewriter(wanted), na_action="ignore")

    return run(text)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_count(text: Column, tokenizer_path: str, more: int = 1) -> Column:
    """How many tokens a tokenizer file of the executors makes of text, and `more` (what begins a sequence); null for null."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(tokenizer_path)
        for part in parts:
            known = part.dropna()
            sizes = [len(x.ids) + more for x in tokenizer.encode_batch_fast(known.tolist(), add_special_tokens=False)]
            yield pd.Series(sizes, index=known.index, dtype="Int64").reindex(part.index)

    return count(text)
